"""Writing tables, predictions, metrics, trials and metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.operators.scaling import Scaler


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Comma-separated with a header and no row numbers."""
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def prediction_table(df: DataFrame, scaler: Scaler, inverse: bool, y: str = "measured", p: str = "predicted", phase: str = "phase") -> DataFrame:
    """Columns ``Measured PCE`` and ``Predicted PCE``, as standard scores unless ``inverse``."""
    shown = (lambda c: F.col(c)) if inverse else scaler.forward
    return df.select(F.col(phase).alias("phase"), shown(y).alias("Measured PCE"), shown(p).alias("Predicted PCE"))


def write_predictions(df: DataFrame, path: str, scaler: Scaler, inverse: bool = False, y: str = "measured", p: str = "predicted", phase: str = "phase") -> None:
    """One folder per phase."""
    write_table(prediction_table(df, scaler, inverse, y, p, phase), path, partition_by=("phase",))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A handful of rows, one per phase."""
    write_csv(metrics.coalesce(1), path)


def append_trials(trials: DataFrame, path: str) -> None:
    write_table(trials, path, "append", ("study",))


def append_metric_log(log: DataFrame, path: str) -> None:
    """One folder per trial and fold; rows are gathered by them, so that files stay few, but a long log is split."""
    write_table(log.hint("rebalance", "trial", "fold"), path, "append", ("trial", "fold"))
