"""Bins of a numeric column and counts per bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvane.functions.hashing import as_column
from solvane.operators.ranking import keys_at_ranks


def equal_width_bin(column: str | Column, step: float) -> Column:
    """Number of the right-closed bin (k*step, (k+1)*step]; null for values that are not positive."""
    value = as_column(column)
    positive = (value > 0) & ~F.isnan(value.cast("double"))
    return F.when(positive, F.ceil(value / F.lit(float(step))) - 1).cast("int")


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Lower-interpolated quantiles at 0, 1/bins, ..., 1 with the first edge set to 0."""
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = values.count()
    if not rows:
        raise ValueError(f"column {column} holds no values to bin")
    positions = [(rows - 1) * i // bins for i in range(bins + 1)]
    found = keys_at_ranks(values, ["v"], positions, rows)
    edges = [0.0] + [found[p][0] for p in positions[1:]]
    for low, high in zip(edges, edges[1:]):
        if low >= high:
            raise ValueError(f"bin edges must increase, but {high} follows {low}")
    return edges


def bin_by_edges(column: str | Column, edges: list[float]) -> Column:
    """Number of the right-closed bin between consecutive edges; null outside of them."""
    value = as_column(column)
    number = F.when(value <= F.lit(edges[0]), F.lit(None).cast("int"))
    for i, edge in enumerate(edges[1:]):
        number = number.when(value <= F.lit(edge), F.lit(i))
    return number


def with_balanced_bin(df: DataFrame, column: str, bins: int, output: str = "bin") -> DataFrame:
    """Add the quantile bin of ``column``, so that bins are about equally full."""
    return df.withColumn(output, bin_by_edges(column, quantile_edges(df, column, bins)))


def bin_counts(df: DataFrame, column: str = "bin") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def grid_counts(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """Rows per cell of a two-dimensional grid, the data behind a joint distribution plot."""
    cells = df.select(F.floor(F.col(x) / x_width).alias("x_cell"), F.floor(F.col(y) / y_width).alias("y_cell"))
    return cells.groupBy("x_cell", "y_cell").agg(F.count("*").alias("count"))
