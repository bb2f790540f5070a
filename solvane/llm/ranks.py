"""Positions in a random but fixed order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 15  # hexadecimal digits of a hash that make an order
SPAN = 16**DIGITS


def shuffled(*parts: Column) -> Column:
    """A number from 0 to SPAN - 1 drawn by the parts as text; nulls count as empty text."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint")


def running(df: DataFrame, group: str, order: str, name: str, value: Column | None = None, buckets: int = 0, tie: str | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` (by default 1) over the rows of the group that come before by ``order``.

    ``order`` comes from ``shuffled``, so that equal ranges of it hold about equally many rows: each group is cut into
    such ranges, their sums are added up first, and every range is then ordered alone, whatever the group's size. Equal
    orders are settled by value and then by the column ``tie``. ``group`` must not be null.
    """
    buckets = buckets or 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.lit(1).cast("bigint") if value is None else value
    cut = df.withColumn("_bucket", F.floor(F.col(order) / (SPAN // buckets + 1)).cast("int")).withColumn("_value", value)
    sums = cut.groupBy(group, "_bucket").agg(F.sum("_value").alias("_sum"))
    by_group = Window.partitionBy(group).orderBy("_bucket")
    sums = sums.select(group, "_bucket", (F.sum("_sum").over(by_group) - F.col("_sum")).alias("_before"))
    own = Window.partitionBy(group, "_bucket").orderBy(order, "_value", *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.join(sums, [group, "_bucket"]).withColumn(name, F.col("_before") + F.sum("_value").over(own) - F.col("_value"))
    return out.drop("_bucket", "_value", "_before")
