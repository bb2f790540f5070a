"""Reproducible random numbers: a hash of seed and row id, the same on every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 2**32


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hash32(seed: int | str, row_id: str | Column) -> Column:
    """Integer in [0, 2^32) from the first 32 bits of md5('seed:id')."""
    text = F.concat(F.lit(f"{seed}:"), as_column(row_id).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed: int | str, row_id: str | Column) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(seed, row_id) / F.lit(float(HASH_RANGE))
