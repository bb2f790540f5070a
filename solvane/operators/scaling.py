"""Standard scores of a target column and of vectors (population statistics)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvane.functions.hashing import as_column


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation of one column."""

    mean: float
    std: float

    def forward(self, column: str | Column) -> Column:
        return (as_column(column) - F.lit(self.mean)) / F.lit(self.std)

    def inverse(self, column: str | Column) -> Column:
        return as_column(column) * F.lit(self.std) + F.lit(self.mean)


def mean_and_std(df: DataFrame, column: str) -> DataFrame:
    """One row with ``mean`` and ``std`` of the values that are given."""
    value = F.when(~F.isnan(F.col(column).cast("double")), F.col(column))
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def fit_scaler(df: DataFrame, column: str) -> Scaler:
    row = mean_and_std(df, column).first()
    return Scaler(row["mean"], row["std"])


def scale_columns(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Standardise several columns with the statistics of ``fit_on`` (the table itself by default)."""
    source = df if fit_on is None else fit_on
    row = source.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    return df.withColumns({c: Scaler(row[f"mean_{c}"], row[f"std_{c}"] or 1.0).forward(c) for c in columns})


def dimension_statistics(df: DataFrame, vector: str) -> DataFrame:
    """Mean and population std per position of an array column."""
    long = df.select(F.posexplode(vector).alias("dim", "value"))
    return long.groupBy("dim").agg(F.avg(F.col("value").cast("double")).alias("mean"), F.stddev_pop(F.col("value").cast("double")).alias("std"))


def standardise_vectors(df: DataFrame, vector: str, output: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Bring each vector position to mean 0 and std 1; positions without spread stay at 0."""
    return fit_vector_scaler(df if fit_on is None else fit_on, vector).scaled(df, vector, output)


@dataclass(frozen=True)
class VectorScaler:
    """Mean and population std of each position, which travel as literals, so that vectors are rescaled in place."""

    means: tuple[float, ...]
    stds: tuple[float, ...]

    def scaled(self, df: DataFrame, vector: str, output: str) -> DataFrame:
        means = F.array(*[F.lit(m) for m in self.means])
        spreads = F.array(*[F.lit(s or 1.0) for s in self.stds])
        pairs = F.arrays_zip(means.alias("m"), spreads.alias("s"))
        return df.withColumn(output, F.zip_with(F.col(vector), pairs, lambda v, p: (v.cast("double") - p["m"]) / p["s"]))


def fit_vector_scaler(df: DataFrame, vector: str) -> VectorScaler:
    """The scaler of a training set, to be used on others as well."""
    statistics = sorted(dimension_statistics(df, vector).collect())
    return VectorScaler(tuple(float(r["mean"]) for r in statistics), tuple(float(r["std"]) for r in statistics))
