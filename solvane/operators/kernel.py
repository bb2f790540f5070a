"""Kernel values of a table of molecules against a support table.

The support (landmarks, support vectors, prototypes) is packed into blocks of
rows, and each molecule meets a block as a whole, so no pair of rows is ever
shuffled.  A support that is measured to be small is broadcast, and the
molecules stay where they are.  For a larger one the pairs are cut into tiles
of a grid: molecules are dealt into row bands, support rows into column bands,
and either side is copied along its own band only, about as often as the root
of the number of tiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

from solvane.functions.hashing import hash32
from solvane.functions.kernels import Kernel
from solvane.storage import BROADCAST_BYTES, WIDTHS, cut

BLOCK_ROWS = 256
# Landmarks that lie in one block, if they are broadcast.
LANDMARK_ROWS = 4096
# Pairs of rows in a tile.
TILE_PAIRS = 20_000_000


def _bytes_of(column: str, kind: DataType) -> Column | None:
    """The size of a value, or None where it can't be told."""
    if kind.simpleString() in WIDTHS:
        return F.lit(WIDTHS[kind.simpleString()])
    if isinstance(kind, StringType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, ArrayType) and kind.elementType.simpleString() in WIDTHS:
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 16
    return None


def _measured(df: DataFrame) -> tuple[int, float]:
    """Rows and bytes; without end where a column's size can't be told."""
    sizes = [_bytes_of(field.name, field.dataType) for field in df.schema]
    if any(s is None for s in sizes):
        return df.count(), math.inf
    rows, total = df.agg(F.count("*"), F.sum(sum(sizes, F.lit(0)).cast("bigint"))).first()
    return rows, total or 0


def tile_bands(x_rows: int, y_rows: int, tile_pairs: int) -> tuple[int, int]:
    """Row bands and column bands of a grid of tiles with about ``tile_pairs`` pairs, with the fewest copies of rows."""
    tiles = max(1, math.ceil(x_rows * y_rows / tile_pairs))
    columns = min(max(1, round(math.sqrt(tiles * y_rows / max(x_rows, 1)))), max(1, y_rows), tiles)
    return math.ceil(tiles / columns), columns


def _with_blocks(x: DataFrame, x_id: str, support: DataFrame, y_id: str, features: list[str], weight: str | None, block_rows: int) -> tuple[DataFrame, int]:
    """``x`` joined to packed support blocks: columns of x, ``_x`` and ``_support``; and the blocks that a row meets."""
    support = cut(support.select(y_id, *features, *([weight] if weight else [])))
    rows, size = _measured(support)
    hashed = hash32("block", y_id)
    entry = F.struct(F.col(y_id).alias("_y_id"), F.struct(*features).alias("_y"), *([F.col(weight).cast("double").alias("_w")] if weight else []))
    packed_rows = F.sort_array(F.collect_list(entry)).alias("_support")  # block_rows of them
    x = x.select(x_id, F.struct(*features).alias("_x"))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    if size <= BROADCAST_BYTES:
        blocks = max(1, math.ceil(rows / block_rows))
        packed = support.groupBy(F.pmod(hashed, F.lit(blocks)).cast("int").alias("_block")).agg(packed_rows)
        return x.withColumn("_block", numbers(blocks)).join(F.broadcast(packed), "_block"), blocks
    row_bands, column_bands = tile_bands(x.count(), rows, TILE_PAIRS)
    inner = max(1, math.ceil(rows / column_bands / block_rows))
    column, within = F.pmod(hashed, F.lit(column_bands)), F.pmod(F.floor(hashed / column_bands), F.lit(inner))
    packed = support.groupBy(column.cast("int").alias("_column"), within.alias("_inner")).agg(packed_rows)
    packed = packed.withColumn("_row", numbers(row_bands))
    dealt = x.withColumn("_row", F.pmod(hash32("row", x_id), F.lit(row_bands)).cast("int")).withColumn("_column", numbers(column_bands))
    return dealt.join(packed, ["_row", "_column"]).drop("_row", "_column", "_inner"), column_bands * inner


def kernel_rows(x: DataFrame, x_id: str, support: DataFrame, y_id: str, kernel: Kernel, features: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(x_id, row): kernel values of each molecule against one support block as array<struct<y_id,k>>."""
    joined, _ = _with_blocks(x, x_id, support, y_id, features, None, block_rows)
    return joined.select(F.col(x_id).alias("x_id"), _values(kernel).alias("row"))


def _values(kernel: Kernel) -> Column:
    return F.transform("_support", lambda s: F.struct(s["_y_id"].alias("y_id"), kernel(F.col("_x"), s["_y"]).alias("k")))


def kernel_matrix(x: DataFrame, x_id: str, support: DataFrame, y_id: str, kernel: Kernel, features: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Long table (x_id, y_id, k)."""
    return kernel_rows(x, x_id, support, y_id, kernel, features, block_rows).select("x_id", F.inline("row"))


def kernel_score(x: DataFrame, x_id: str, support: DataFrame, y_id: str, weight: str, intercept: float, kernel: Kernel, features: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(x_id, predicted): sum of weight * kernel over the support plus the intercept."""
    joined, blocks = _with_blocks(x, x_id, support, y_id, features, weight, block_rows)
    partial = F.aggregate("_support", F.lit(0.0), lambda total, s: total + s["_w"] * kernel(F.col("_x"), s["_y"]))
    scored = joined.select(F.col(x_id).alias("x_id"), partial.alias("_part"))
    if blocks > 1:
        scored = scored.groupBy("x_id").agg(F.sum("_part").alias("_part"))
    return scored.select("x_id", (F.col("_part") + F.lit(intercept)).alias("predicted"))


def kernel_features(x: DataFrame, x_id: str, landmarks: DataFrame, y_id: str, kernel: Kernel, features: list[str]) -> DataFrame:
    """(x_id, values): kernel values against all landmarks in the order of their ids."""
    joined, blocks = _with_blocks(x, x_id, landmarks, y_id, features, None, LANDMARK_ROWS)
    rows = joined.select(F.col(x_id).alias("x_id"), _values(kernel).alias("row"))
    whole = rows.groupBy("x_id").agg(F.flatten(F.collect_list("row")).alias("row")) if blocks > 1 else rows
    return whole.select("x_id", F.transform(F.array_sort("row"), lambda e: e["k"]).alias("values"))

