"""Streams over trial tables and metric logs.

State is one row per study or trial, kept by Spark's own streaming
aggregation, so that a busy study is pre-aggregated before the shuffle; early
stopping, which depends on the order of checks, keeps those ahead of their turn.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from solvane.operators.trials import MAX_FAILED, state_counts


def read_log(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet", per_trigger: int = 100) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def study_progress(trials: DataFrame, study: str = "study", state: str = "state", max_failed: int = MAX_FAILED) -> DataFrame:
    """Trial counts per study after each batch, with the flag that ends a study."""
    counts = trials.groupBy(study).agg(*state_counts(state))
    return counts.withColumn("stop", F.col("failed") >= max_failed)


def trial_progress(log: DataFrame, trial: str = "trial", epoch: str = "epoch", value: str = "value", patience: int = 20) -> DataFrame:
    """Latest and best value per trial and whether it has run ``patience`` epochs past its best.

    The answer does not depend on the order in which rows arrive.
    """
    given = ~F.isnan(value)
    latest = F.max(F.struct(F.col(epoch).alias("e"), F.col(value).alias("v"))).alias("_latest")
    best = F.min(F.when(given, F.struct(F.col(value).alias("v"), F.col(epoch).alias("e")))).alias("_best")
    grouped = log.groupBy(trial).agg(latest, best, F.count("*").alias("checks"))
    waited = F.col("_latest.e") - F.col("_best.e")
    return grouped.select(
        trial,
        F.col("_latest.e").alias("latest_epoch"),
        F.col("_latest.v").alias("latest_value"),
        F.col("_best.e").alias("best_epoch"),
        F.col("_best.v").alias("best_value"),
        "checks",
        waited.alias("waited"),
        (waited >= patience).alias("stop"),
    )


STOPPING = "trial {trial}, score double, best_epoch bigint, stop_epoch bigint, checks bigint, waiting bigint"
STOPPING_STATE = "next bigint, best double, at bigint, stop bigint, last double, epochs array<bigint>, values array<double>"


def _stopping_row(trial, score: float | None, best: int | None, stop: int | None, checks: int, waiting: int) -> pd.DataFrame:
    """A result row from columns of the right types; a group is given one a batch, so turning types afterwards would cost more than the rule."""

    def whole(value):
        return pd.arrays.IntegerArray(np.array([value or 0], np.int64), np.array([value is None]))

    measured = np.array([np.nan if score is None else score], np.float64)
    return pd.DataFrame({"trial": [trial], "score": measured, "best_epoch": whole(best), "stop_epoch": whole(stop), "checks": [checks], "waiting": [waiting]})


def stopping_progress(log: DataFrame, patience: int, min_delta: float = 0.0, mode: str = "min", trial: str = "trial", epoch: str = "epoch", value: str = "value", first: int = 0, idle_ms: int | None = None) -> DataFrame:
    """(trial, score, best_epoch, stop_epoch, checks, waiting): early stopping of each trial as its checks arrive.

    The rule is that of :func:`solvane.operators.series.early_stopping`, and so is
    the answer once all checks from epoch ``first`` on have arrived, in whatever
    order and batches.  A check that is ahead of its turn waits in the state;
    ``waiting`` counts those, ``checks`` those that had their turn.  A stop is
    final, and what arrives after it is neither judged nor kept.  A check
    that arrives again is ignored.  State that nothing reached for ``idle_ms`` is
    dropped; without it the state stays.
    """
    if min_delta < 0:
        raise ValueError("min_delta must not be negative")
    sign = 1.0 if mode.startswith("min") else -1.0

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        turn, best, at, stop, last, epochs, values = state.get if state.exists else (first, None, first - 1, None, None, [], [])
        waiting = dict(zip(epochs, values, strict=True))
        for rows in batches:
            for e, v in zip(rows["epoch"].tolist(), rows["value"].tolist(), strict=True):
                if e >= turn:
                    waiting[int(e)] = None if v is None or v != v else float(v)
        while stop is None and turn in waiting:
            v = waiting.pop(turn)
            last = v
            if patience > 0:
                if v is not None and (best is None or sign * v + min_delta < sign * best):
                    best, at = v, turn
                elif turn - at >= patience:
                    stop = turn
            turn += 1
        if stop is not None:
            waiting = {}
        state.update((turn, best, at, stop, last, list(waiting), list(waiting.values())))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        score, best_at = (best, at if best is not None else None) if patience > 0 else (last, None)
        yield _stopping_row(key[0], score, best_at, stop, turn - first, len(waiting))

    read = log.select(F.col(trial).alias("trial"), F.col(epoch).cast("bigint").alias("epoch"), F.col(value).cast("double").alias("value")).filter("epoch is not null")
    kind = STOPPING.format(trial=read.schema["trial"].dataType.simpleString())
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    found = read.groupBy("trial").applyInPandasWithState(update, kind, STOPPING_STATE, "update", timeout)
    return found.withColumnRenamed("trial", trial)


def write_updates(stream: DataFrame, path: str, checkpoint: str, key: str) -> None:
    """Process what has arrived and keep the last row of each group.

    There are two copies of the result.  A batch reads the one that the batch
    before it wrote, puts its changed groups in and overwrites the other, so
    that the result takes no more room with more batches, and a batch that is
    repeated after a restart reads and writes the same again.  The changed
    groups are written down beside ``path`` before they are put in, so that a
    batch goes through its state once.
    """
    changes = f"{path.rstrip('/')}-changes"

    def write(batch: DataFrame, number: int) -> None:
        merged = batch
        if number:
            batch.write.mode("overwrite").parquet(changes)
            changed = batch.sparkSession.read.parquet(changes)
            before = batch.sparkSession.read.parquet(f"{path}/copy={(number - 1) % 2}").drop("batch")
            merged = before.join(changed.select(key), key, "left_anti").unionByName(changed)
        merged.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/copy={number % 2}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each group: the copy that the last batch wrote."""
    copies = spark.read.parquet(path)
    newest = copies.agg(F.max("batch")).first()[0]
    return copies.filter(F.col("batch") == F.lit(newest)).drop("batch", "copy")
