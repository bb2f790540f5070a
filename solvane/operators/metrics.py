"""Regression and classification metrics as single-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvane.functions.hashing import as_column


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation; null where one side does not vary."""
    a, b = as_column(a), as_column(b)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def regression_metrics(y: str | Column = "measured", p: str | Column = "predicted") -> list[Column]:
    """Aggregates mse, rmse, R2, r, mae and count of predictions ``p`` of ``y``."""
    y, p = as_column(y).cast("double"), as_column(p).cast("double")
    error = y - p
    mse = F.avg(error * error)
    spread = F.var_pop(y)
    fit = F.when(spread > 0, 1 - mse / F.nullif(spread, F.lit(0.0))).when(mse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return [
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        fit.alias("R2"),
        safe_corr(y, p).alias("r"),
        F.avg(F.abs(error)).alias("mae"),
        F.count(y).alias("count"),
    ]


def metrics_by(df: DataFrame, groups: Sequence[str] = (), y: str = "measured", p: str = "predicted") -> DataFrame:
    return df.groupBy(*groups).agg(*regression_metrics(y, p))


def accuracy(y: str | Column, p: str | Column) -> Column:
    return F.avg((as_column(y) == as_column(p)).cast("double")).alias("accuracy")


def ensemble_metrics(predictions: DataFrame, row: str = "row_id", y: str = "measured", p: str = "predicted", groups: Sequence[str] = ()) -> DataFrame:
    """Mean of the models' mse beside the metrics of the row-wise mean prediction.

    Every model predicts every row, so the mean over models of the mean over
    rows is the mean over rows of the mean over models, and one grouping by row
    serves both.
    """
    per_row = predictions.groupBy(*groups, row).agg(F.first(y).alias(y), F.avg(p).alias(p), F.avg((F.col(y) - F.col(p)) ** 2).alias("_squared"))
    return per_row.groupBy(*groups).agg(*regression_metrics(y, p), F.avg("_squared").alias("mean_mse"))


def fold_summary(scores: DataFrame, groups: Sequence[str], score: str = "score") -> DataFrame:
    """Mean, population std and variance of the fold scores."""
    return scores.groupBy(*groups).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.var_pop(score).alias("var"), F.count(score).alias("folds")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Long table (a, b, corr) of all column pairs, from one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[F.round(safe_corr(a, b), digits).alias(f"{a}|{b}") for a, b in pairs])
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs]
    entries += [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs if a != b]
    return wide.select(F.inline(F.array(*entries)))


def regression_line(x: str | Column, y: str | Column) -> list[Column]:
    """Slope, intercept, correlation and standard error of the slope of y on x."""
    x, y = as_column(x), as_column(y)
    r = safe_corr(x, y)
    ratio = F.var_pop(y) / F.nullif(F.var_pop(x), F.lit(0.0))
    freedom = F.nullif(F.count(x) - 2, F.lit(0))
    return [
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        r.alias("r"),
        F.sqrt((1 - r * r) * ratio / freedom).alias("stderr"),
    ]


def axis_range(a: str, b: str) -> list[Column]:
    """Smallest and largest value over both columns."""
    return [F.least(F.min(a), F.min(b)).alias("low"), F.greatest(F.max(a), F.max(b)).alias("high")]


def batch_metrics(df: DataFrame, groups: Sequence[str], y: str, p: str, inverse) -> DataFrame:
    """Per batch: mse and mae in original units and the loss in z units."""
    return df.groupBy(*groups).agg(
        F.avg((inverse(y) - inverse(p)) ** 2).alias("mse"),
        F.avg(F.abs(inverse(y) - inverse(p))).alias("mae"),
        F.avg((F.col(y) - F.col(p)) ** 2).alias("loss_z"),
        F.count("*").alias("count"),
    )


def epoch_metrics(df: DataFrame, groups: Sequence[str], y: str, p: str, inverse) -> DataFrame:
    """Per phase and epoch over all rows: loss in z units, metrics in original units."""
    return df.groupBy(*groups).agg(F.avg((F.col(y) - F.col(p)) ** 2).alias("loss"), *regression_metrics(inverse(y), inverse(p)))


def mean_of_batch_accuracies(df: DataFrame, epoch: str, batch: str, y: str, p: str) -> DataFrame:
    """Unweighted mean of the accuracy of each batch."""
    per_batch = df.groupBy(epoch, batch).agg(accuracy(y, p))
    return per_batch.groupBy(epoch).agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("batches"))
