"""Filters, projections and the cleaning chain of a molecule table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvane.functions.hashing import as_column, hash_uniform
from solvane.operators.ranking import before_key, keys_at_ranks
from solvane.operators.vocab import rows_with_unknown


def present(column: str | Column) -> Column:
    """Neither null nor NaN."""
    c = as_column(column)
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows where every column is given; NaN counts as missing."""
    return df.dropna(subset=list(columns))


def at_least(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Keep values of at least ``threshold``; NaN, greatest in Spark's order, is dropped."""
    return df.filter((F.col(column) >= threshold) & ~F.isnan(F.col(column).cast("double")))


def threshold_counts(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """One row: how many rows :func:`at_least` removes and keeps."""
    kept = (F.col(column) >= threshold) & ~F.isnan(F.col(column).cast("double"))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(kept).alias("kept"),
        (F.count("*") - F.count_if(kept)).alias("removed"),
    )


def thin_out_below(df: DataFrame, id_col: str, column: str, threshold: float, skip: float, seed: int = 0) -> DataFrame:
    """Drop each row below ``threshold`` with probability ``skip``; the rest stays."""
    high = (F.col(column) >= threshold) & ~F.isnan(F.col(column).cast("double"))
    return df.filter(high | (hash_uniform(seed, id_col) >= skip))


def keep_valid(df: DataFrame, valid: Column) -> DataFrame:
    return df.filter(valid)


def validity_profile(df: DataFrame, text: str, valid: Column, atoms: Column) -> DataFrame:
    """One row: valid and invalid counts, and maxima over the valid rows."""
    return df.agg(
        F.count_if(valid).alias("valid"),
        F.count_if(~valid).alias("invalid"),
        F.max(F.when(valid, F.length(text))).alias("max_length"),
        F.max(F.when(valid, atoms)).alias("max_atoms"),
    )


def rows_between(df: DataFrame, order: Sequence[str], start: int = 0, stop: int | None = None) -> DataFrame:
    """The rows at positions ``start`` up to ``stop`` in the order of ``order`` (unique, numeric first)."""
    wanted = [start] if start > 0 else []
    if stop is not None:
        wanted.append(stop)
    keys = keys_at_ranks(df, order, wanted)
    result = df
    if stop is not None and stop in keys:
        result = result.filter(before_key(order, keys[stop]))
    if start > 0:
        result = result.filter(~before_key(order, keys.get(start)))
    return result


def with_phase(df: DataFrame, phase: str, column: str = "ml_phase") -> DataFrame:
    return df.withColumn(column, F.lit(phase))


def known_and_measured(df: DataFrame, id_col: str, tokens: str, target: str, vocabulary: DataFrame | None) -> DataFrame:
    """Keep rows whose tokens are all in the vocabulary and whose target is given."""
    measured = df.filter(present(target))
    if vocabulary is None:
        return measured
    return measured.join(rows_with_unknown(measured, id_col, tokens, vocabulary), id_col, "left_anti")


def known_and_measured_counts(df: DataFrame, id_col: str, tokens: str, target: str, vocabulary: DataFrame | None) -> DataFrame:
    """One row: rows with known tokens, with a target, and with both."""
    flagged = df.select(id_col, present(target).alias("_measured"), F.col(tokens))
    if vocabulary is None:
        flagged = flagged.withColumn("_known", F.lit(True))
    else:
        unknown = rows_with_unknown(flagged, id_col, tokens, vocabulary).withColumn("_unknown", F.lit(True))
        flagged = flagged.join(unknown, id_col, "left").withColumn("_known", F.col("_unknown").isNull())
    return flagged.agg(
        F.count_if("_known").alias("known"),
        F.count_if("_measured").alias("measured"),
        F.count_if(F.col("_known") & F.col("_measured")).alias("both"),
    )


def clean(
    df: DataFrame,
    id_col: str,
    target: str,
    valid: Column | None = None,
    min_row: int = 0,
    max_row: int | None = None,
    threshold_skip: float | None = None,
    threshold_downsampling: float | None = None,
    threshold_percentage: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """Slice, validity, threshold and thinning in this order; each stage is optional."""
    stages: list[Callable[[DataFrame], DataFrame]] = []
    if min_row or max_row is not None:
        stages.append(lambda d: rows_between(d, [id_col], min_row, max_row))
    if valid is not None:
        stages.append(lambda d: keep_valid(d, valid))
    if threshold_skip:
        stages.append(lambda d: at_least(d, target, threshold_skip))
    if threshold_downsampling and threshold_percentage:
        stages.append(lambda d: thin_out_below(d, id_col, target, threshold_downsampling, threshold_percentage, seed))
    for stage in stages:
        df = df.transform(stage)
    return df


def nan_to_zero(df: DataFrame, columns: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Drop ``drop`` and replace missing numbers by 0."""
    return df.drop(*drop).fillna(0, subset=list(columns))
