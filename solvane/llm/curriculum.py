"""Mixing sources to target weights on a schedule that changes over training, in DataFrame operations.

Each source has a weight, which sets its target, and a tilt, which changes its rate linearly over training: the
rate at progress p is target * (1 + tilt * (2p - 1)). Its integral, target * (p + tilt * (p * p - p)), is the source's
cumulative demand. A source's documents are laid end to end in a fixed random order, as often as the target needs;
a copy is taken if its middle lies below the target, and its place in training is the progress at which the demand
reaches that middle, by the inverse of the integral. Documents are sorted by place over all sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvane.llm.ranks import running, shuffled
from solvane.storage import BROADCAST_BYTES, stage

# Weight and tilt of the first, second, third source in order of code points, and so on again from the first.
SCHEDULE = ((3, -0.5), (1, 0.5), (2, 0.25))
SHARE, MOST = 1.5, 2


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def targets(sizes: DataFrame, schedule: Sequence[tuple[float, float]] = SCHEDULE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(group, source_size, target, tilt) for each source of ``sizes`` (group, source, size).

    ``share`` of all sizes is divided by weight; a target stops at ``most`` times its source's size, and what is left
    over is divided among the others in the same way. That is one level for all sources that do not stop: sorted by the
    level at which they stop, the first that does not is where the level is found. Sources, not documents, are sorted here.
    """
    numbered = sizes.groupBy("group").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.struct(F.lit(float(w)).alias("weight"), F.lit(float(t)).alias("tilt")) for w, t in schedule))
    numbered = numbered.withColumn("rate", F.element_at(cycle, (place % len(schedule) + 1).cast("int")))
    numbered = numbered.select("group", "source", "source_size", F.col("rate.weight").alias("weight"), F.col("rate.tilt").alias("tilt"))
    numbered = numbered.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("stop", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(0))
    total = share * F.sum(F.col("source_size").cast("double")).over(everything)
    before = total - (F.sum("cap").over(rising) - F.col("cap"))
    left = F.sum("weight").over(everything) - (F.sum("weight").over(rising) - F.col("weight"))
    levelled = numbered.withColumn("level", before / left)
    level = F.min(F.when(F.col("stop") >= F.col("level"), F.struct("stop", "level"))).over(everything)["level"]
    target = F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))
    return levelled.select("group", "source_size", "tilt", target.alias("target"))


def progress(demand: Column, target: Column, tilt: Column) -> Column:
    """The p from 0 to 1 with target * (p + tilt * (p * p - p)) = demand."""
    q = F.when(target > 0, demand / target).otherwise(F.lit(0.0))
    rest = 1 - tilt
    return F.least(F.lit(1.0), 2 * q / (rest + F.sqrt(rest * rest + 4 * tilt * q)))  # rounding may reach beyond the end


def plan(docs: DataFrame, schedule: Sequence[tuple[float, float]] = SCHEDULE, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] | None = None) -> DataFrame:
    """(row, size, source_size, target, copies, taken, places) for each row of ``docs``.

    ``row`` holds the columns ``carry`` of the row (by default all). ``size`` counts words (null text: 0), ``taken`` is
    copies * size, ``places`` the progress at which each copy comes. Targets are met up to half of the document that
    lies across them. Null sources are one source, the last; equal ids lie side by side in the order, by size and text; documents
    without words take no room and are planned where they lie. Any tilt from -1 to 1 can be given. Names of other
    columns do not matter.
    """
    if any(w <= 0 or not -1 < t < 1 for w, t in schedule):
        raise ValueError("weights are positive, tilts between -1 and 1")
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)))
    source = F.col(source_col).cast("string")
    rows = docs.select(
        row.alias("row"),
        source.alias("source"),
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("s"), source)).alias("group"),
        word_count(F.col(text_col)).alias("size"),
        shuffled(F.col(id_col)).alias("order"),
        F.xxhash64(F.col(text_col)).alias("tie"),
    )
    sized = targets(rows.select("group", "source", "size"), schedule, share, most)
    sized = stage(sized, "targets")  # a row for each source
    return place(rows, sized, most)


def place(rows: DataFrame, sized: DataFrame, most: int) -> DataFrame:
    # rows with equal ids and sizes lie in the order of their texts, so that reruns agree
    lain = running(rows, "group", "order", "before", F.col("size"), tie="tie").drop("tie")
    lain = lain.join(F.broadcast(sized) if small(sized) else sized, "group")
    middle = F.col("before") + F.col("size") / 2
    copy = F.sequence(F.lit(0), F.lit(most - 1))
    demands = F.filter(F.transform(copy, lambda e: middle + e * F.col("source_size")), lambda d: d < F.col("target"))
    places = F.transform("demands", lambda d: progress(d, F.col("target"), F.col("tilt")))
    out = lain.withColumn("demands", demands).withColumn("places", places).withColumn("copies", F.size("places"))
    return out.select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "places")


def small(sized: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the sources, by their measured bytes, are few enough to send to all tasks."""
    return (sized.agg(F.sum(F.octet_length("group") + 40)).first()[0] or 0) <= most


def in_order(planned: DataFrame) -> DataFrame:
    """The rows of a plan in order of training, by the place of their first copy; rows that are not taken come last."""
    return planned.orderBy(F.get("places", F.lit(0)).asc_nulls_last(), F.xxhash64("row", "size"))  # the hash spreads rows of one place


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in order of training, as often as they are taken."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = plan(docs, **options).select("row", F.explode("places").alias("place"))
    return taken.repartitionByRange(parts, "place").sortWithinPartitions("place").select("row.*")
