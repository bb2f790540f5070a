"""A complete regression study with a straight line as its model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.operators.clean import at_least
from solvane.operators.metrics import metrics_by
from solvane.operators.scaling import Scaler
from solvane.operators.split import split_by_size
from solvane.storage import stage


def line_study(df: DataFrame, id_col: str, x: str, y: str, threshold: float, sizes: list[int | None], seed: int) -> DataFrame:
    """Clean, split exactly, scale and fit on train only, and report metrics per phase."""
    # Counting, splitting, fitting and scoring each read the cleaned table, so it is written once.
    cleaned = stage(at_least(df.select(id_col, x, y), y, threshold), "cleaned")
    split = split_by_size(cleaned, id_col, sizes, seed)
    train = split.filter(F.col("ml_phase") == "train")
    fitted = train.agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).first()
    scaler = Scaler(fitted["mean"], fitted["std"])
    slope, intercept = fitted["slope"] / scaler.std, (fitted["intercept"] - scaler.mean) / scaler.std
    scored = split.withColumn("z", scaler.forward(y)).withColumn("z_predicted", F.col(x) * slope + intercept)
    scored = scored.select("ml_phase", scaler.inverse("z").alias("measured"), scaler.inverse("z_predicted").alias("predicted"))
    return metrics_by(scored, ["ml_phase"])
