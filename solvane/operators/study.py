"""Run an objective for each row of a trial table, several Spark jobs at a time."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession

from solvane.operators.trials import MAX_FAILED

RESULT_SCHEMA = "study string, number bigint, state string, value double, datetime_start timestamp, datetime_complete timestamp, error string"


def run_trials(spark: SparkSession, trials: DataFrame, objective: Callable[[Row], float], study: str = "study", number: str = "number", n_jobs: int = 1, max_failed: int = MAX_FAILED) -> DataFrame:
    """Result table of a study.

    ``objective`` fits with Spark jobs and returns the value; it sees one trial
    row.  RuntimeError, ValueError and TypeError mark the trial failed and the
    study goes on, until ``max_failed`` trials have failed.  Only the trial
    rows, one per fit, pass through the driver.
    """
    lock, failed = threading.Lock(), [0]

    def run(row: Row):
        with lock:
            if failed[0] >= max_failed:
                return None
        begun = datetime.now(timezone.utc)
        try:
            value, state, error = float(objective(row)), "COMPLETE", None
        except (RuntimeError, ValueError, TypeError) as problem:
            value, state, error = None, "FAIL", str(problem)
            with lock:
                failed[0] += 1
        return study, int(row[number]), state, value, begun, datetime.now(timezone.utc), error

    rows = trials.orderBy(number).toLocalIterator()
    with ThreadPoolExecutor(n_jobs) as pool:
        results = [r for r in pool.map(inheritable_thread_target(spark)(run), rows) if r is not None]
    return spark.createDataFrame(results, RESULT_SCHEMA)
