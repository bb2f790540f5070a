"""Per-trial metric series: early stopping and the best checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvane.operators.ranking import global_rank
from solvane.storage import stage

# Epochs per block when running minima are taken block by block.
BLOCK = 1024


def improvements(log: DataFrame, trial: str, epoch: str, value: str) -> DataFrame:
    """Rows below every earlier value of their trial, found block by block.

    The minimum of the earlier blocks comes from one row per block, the minimum
    within a block from a window over that block, so a long series is spread
    over many tasks.
    """
    rows = log.select(trial, epoch, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull()).withColumn("_block", F.floor(F.col(epoch) / BLOCK))
    blocks = rows.groupBy(trial, "_block").agg(F.min("_v").alias("_least"))
    earlier = Window.partitionBy(trial).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(trial, "_block", F.min("_least").over(earlier).alias("_before"))
    inside = Window.partitionBy(trial, "_block").orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(blocks, [trial, "_block"])
    joined = joined.withColumn("_bound", F.least("_before", F.min("_v").over(inside)))
    return joined.filter(F.col("_bound").isNull() | (F.col("_v") < F.col("_bound"))).select(trial, epoch, "_v")


def early_stopping(log: DataFrame, trial: str, epoch: str, value: str, patience: int, min_delta: float = 0.0, mode: str = "min") -> DataFrame:
    """(trial, score, best_epoch, stop_epoch): the score an early-stopped run reports.

    ``epoch`` counts the checks of a trial without gaps.  A value improves if it
    beats the best by more than ``min_delta``; the run stops at the first epoch
    that is ``patience`` checks after the best one, and later rows are ignored.
    With ``patience`` of 0 or less nothing stops and the score is the last value.
    Missing values are checks without an improvement.
    """
    if min_delta < 0:
        raise ValueError("min_delta must not be negative")
    sign = 1.0 if mode.startswith("min") else -1.0
    if patience <= 0:
        last = log.groupBy(trial).agg(F.max(F.struct(epoch, value)).alias("last"))
        none = F.lit(None).cast("bigint")
        return last.select(trial, F.col(f"last.{value}").cast("double").alias("score"), none.alias("best_epoch"), none.alias("stop_epoch"))
    renamed = log.select(F.col(trial).alias("trial"), F.col(epoch).cast("bigint").alias("epoch"), (F.col(value) * F.lit(sign)).alias("value"))
    # Whatever min_delta is, an improvement is below all earlier values, so only those rows matter.
    lows = global_rank(improvements(renamed, "trial", "epoch", "value"), ["trial", "epoch"], "low")
    last_low = _last_improvements(lows, patience, min_delta)
    span = renamed.groupBy("trial").agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"))
    joined = span.join(last_low.withColumnRenamed("trial", "of"), F.col("trial").eqNullSafe(F.col("of")), "left")
    met = F.col("first_low") - F.col("first") < patience
    best_epoch = F.when(met, F.col("at"))
    stop = F.coalesce(best_epoch, F.col("first") - 1) + patience
    return joined.select(
        F.col("trial").alias(trial),
        (F.when(met, F.col("best")) * F.lit(sign)).alias("score"),
        best_epoch.alias("best_epoch"),
        F.when(stop <= F.col("last"), stop).alias("stop_epoch"),
    )


def _last_improvements(lows: DataFrame, patience: int, min_delta: float) -> DataFrame:
    """(trial, first_low, at, best): where the chain of improvements that starts at a trial's first value ends.

    ``lows`` are numbered over all trials, falling within a trial.  The next
    improvement of each is found by ranks: without ``min_delta`` it is the next
    low.  Otherwise the lows raised by ``min_delta`` and the lows themselves
    are put in one falling order; as many raised ones lie before a low as
    its rank there less the lows before it, and the one after them is its next.
    """
    if min_delta:
        lows = stage(lows, "lows")
        raised = lows.select("trial", (-(F.col("_v") + F.lit(min_delta))).alias("key"), F.lit(0).alias("kind"), "low")
        own = lows.select("trial", (-F.col("_v")).alias("key"), F.lit(1).alias("kind"), "low")
        placed = global_rank(raised.unionByName(own), ["trial", "key", "kind", "low"], "both").filter("kind = 1")
        lows = lows.join(placed.select("low", (F.col("both") - F.col("low")).alias("next")), "low")
    else:
        lows = lows.withColumn("next", F.col("low") + 1)
    after = lows.select(F.col("low").alias("next"), F.col("trial").alias("of"), F.col("epoch").alias("later"))
    linked = lows.join(after, "next", "left")
    goes_on = F.col("of").eqNullSafe(F.col("trial")) & (F.col("later") - F.col("epoch") <= patience)
    linked = linked.select("trial", "epoch", "_v", "low", F.when(goes_on, F.col("next")).alias("next"))
    if not min_delta:  # every low is an improvement up to the first gap
        end = F.min(F.when(F.col("next").isNull(), F.struct("epoch", "_v")))
        found = linked.groupBy("trial").agg(F.min("epoch").alias("first_low"), end.alias("end"))
        return found.select("trial", "first_low", F.col("end.epoch").alias("at"), F.col("end._v").alias("best"))
    linked = stage(linked, "linked")
    starts = stage(linked.groupBy("trial").agg(F.min(F.struct("low", "epoch")).alias("start")).select("trial", F.col("start.low").alias("low"), F.col("start.epoch").alias("first_low")), "starts")
    jumps = stage(linked.select("low", F.coalesce("next", "low").alias("end")), "jumps")
    while True:  # each turn doubles how far a jump reaches
        further = jumps.select(F.col("low").alias("end"), F.col("end").alias("beyond"))
        open_ = starts.select("low").join(jumps, "low").join(further, "end").filter("beyond <> end")
        if open_.isEmpty():
            break
        jumps = stage(jumps.join(further, "end").select("low", F.col("beyond").alias("end")), "jumps")
    ends = linked.select(F.col("low").alias("end"), F.col("epoch").alias("at"), F.col("_v").alias("best"))
    return starts.join(jumps, "low").join(ends, "end").select("trial", "first_low", "at", "best")


def best_checkpoint(log: DataFrame, trial: str, epoch: str, value: str, mode: str = "min") -> DataFrame:
    """Best epoch per trial (the earliest on ties) and the last one."""
    sign = 1.0 if mode.startswith("min") else -1.0
    ranked = F.when(~F.isnan(F.col(value).cast("double")), F.struct((F.col(value) * sign).alias("v"), F.col(epoch).alias("e"), F.col(value).alias("value")))
    grouped = log.groupBy(trial).agg(F.min(ranked).alias("best"), F.max(F.struct(F.col(epoch).alias("e"), F.col(value).alias("value"))).alias("last"))
    return grouped.select(
        trial,
        F.col("best.e").alias("best_epoch"),
        F.col("best.value").alias("best_value"),
        F.col("last.e").alias("last_epoch"),
        F.col("last.value").alias("last_value"),
    )
