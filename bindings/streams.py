"""The events as a stream of finished trials and of metric records."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from bindings import query
from bindings.measuring import metric_log, stopping_sql
from bindings.tables import TRIALS, table
from bindings.trials import STATE_SQL
from solvane.storage import scratch_path
from solvane.streaming import logs


def _stream(spark, folder):
    return logs.read_log(spark, folder, table(spark, folder, "events").schema, "events.parquet")


def _run(spark, stream, key):
    path = scratch_path(spark, "stream")
    logs.write_updates(stream, f"{path}/out", f"{path}/checkpoint", key)
    return logs.latest_state(spark, f"{path}/out")


@query("st1_study_progress", f"with {TRIALS} select study, {STATE_SQL}, count(*) filter (where state = 'FAIL') >= 50 as stop from trials group by study")
def st1(spark, folder):
    state = F.when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "view", "RUNNING").when(F.col("event_type") == "signup", "PRUNED").otherwise("COMPLETE")
    study = F.concat(F.lit("study-"), (F.col("user_id") % 12).cast("string"))
    finished = _stream(spark, folder).select(study.alias("study"), state.alias("state"))
    return _run(spark, logs.study_progress(finished), "study")


@query(
    "st2_trial_progress",
    """with l as (select user_id as trial, event_id as epoch, value from events),
    g as (select trial, max(epoch) as latest_epoch, arg_max(value, epoch) as latest_value, min((value, epoch)) as best, count(*) as checks from l group by trial)
    select trial, latest_epoch, latest_value, best[2] as best_epoch, best[1] as best_value, checks, latest_epoch - best[2] as waited, latest_epoch - best[2] >= 2000 as stop from g""",
)
def st2(spark, folder):
    log = _stream(spark, folder).select(F.col("user_id").alias("trial"), F.col("event_id").alias("epoch"), "value")
    return _run(spark, logs.trial_progress(log, patience=2000), "trial")


@query("st2_early_stopping", stopping_sql(10, 5.0, 1))
def st2_stopping(spark, folder):
    """The checks of all trials arrive in files of mixed order, a quarter of the files a batch."""
    source = scratch_path(spark, "checks")
    log = metric_log(spark, folder)
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    log.repartition(files, F.xxhash64("trial", "epoch")).write.parquet(source)
    arrived = len(spark.read.schema(log.schema).parquet(source).inputFiles())
    stream = logs.read_log(spark, source, log.schema, per_trigger=math.ceil(arrived / 4))
    return _run(spark, logs.stopping_progress(stream, 10, 5.0), "trial").drop("checks", "waiting")
