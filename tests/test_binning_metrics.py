import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvane.operators import binning, metrics, ranking, scaling


def test_equal_width_edges(spark):
    values = [0.2, 0.2000001, 0.6, -1.0, 0.0, float("nan"), None, 490.01]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    bins = [r["b"] for r in df.select("id", binning.equal_width_bin("v", 0.2).alias("b")).orderBy("id").collect()]
    assert bins[:2] == [0, 1] and bins[3:7] == [None] * 4
    assert bins[2] == math.ceil(0.6 / 0.2) - 1


def test_quantile_edges_are_lower_interpolated(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 30)
    monkeypatch.setattr(ranking, "SAMPLE", 100)
    draw = random.Random(1)
    values = [round(draw.expovariate(0.1) + 0.01, 4) for _ in range(977)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    edges = binning.quantile_edges(df, "v", 8)
    expected = np.quantile(values, [i / 8 for i in range(9)], method="lower")
    assert edges[0] == 0.0 and edges[1:] == list(expected[1:])
    counts = {r["bin"]: r["count"] for r in binning.bin_counts(binning.with_balanced_bin(df, "v", 8)).collect()}
    assert sum(n for b, n in counts.items() if b is not None) == 977 and counts[None] == 2


def test_duplicate_edges_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 10 + [(2.0,)], "v double")
    with pytest.raises(ValueError, match="must increase"):
        binning.quantile_edges(df, "v", 4)


def test_metrics_against_numpy(spark):
    draw = np.random.default_rng(2)
    y = draw.normal(4.1, 2.4, 500)
    p = y * 0.8 + draw.normal(0, 1, 500)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "measured double, predicted double")
    row = metrics.metrics_by(df).first().asDict()
    mse = np.mean((y - p) ** 2)
    assert row["mse"] == pytest.approx(mse) and row["rmse"] == pytest.approx(mse**0.5)
    assert row["R2"] == pytest.approx(1 - mse / y.var()) and row["r"] == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert row["mae"] == pytest.approx(np.abs(y - p).mean()) and row["count"] == 500
    slope, intercept = np.polyfit(y, p, 1)
    line = df.agg(*metrics.regression_line("measured", "predicted")).first()
    residual = p - (slope * y + intercept)
    stderr = math.sqrt(residual @ residual / 498 / ((y - y.mean()) @ (y - y.mean())))
    assert (line["slope"], line["intercept"], line["stderr"]) == pytest.approx((slope, intercept, stderr))


def test_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "measured double, predicted double")
    row = metrics.metrics_by(df).first()
    assert row["R2"] == 1.0 and row["r"] is None
    off = metrics.metrics_by(df.withColumn("predicted", F.lit(2.0))).first()
    assert off["R2"] == 0.0


def test_mean_of_batch_means_differs_from_flat_mean(spark):
    df = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 1, 0), (0, 1, 1, 0), (0, 1, 0, 1)], "epoch int, batch int, y int, p int")
    assert metrics.mean_of_batch_accuracies(df, "epoch", "batch", "y", "p").first()["accuracy"] == 0.5
    assert df.agg(metrics.accuracy("y", "p")).first()[0] == 0.25


def test_scaler_round_trip_and_vectors(spark):
    df = spark.createDataFrame([(i, float(i), [float(i), 2.0]) for i in range(5)], "id int, v double, x array<double>")
    scaler = scaling.fit_scaler(df, "v")
    assert (scaler.mean, scaler.std) == (2.0, pytest.approx(2**0.5))
    back = df.select(scaler.inverse(scaler.forward("v")).alias("v")).collect()
    assert [r["v"] for r in back] == pytest.approx([0, 1, 2, 3, 4])
    scaled = scaling.standardise_vectors(df, "x", "z", fit_on=df.filter("id < 3")).orderBy("id").collect()
    assert [r["z"][0] for r in scaled] == pytest.approx([(i - 1) / (2 / 3) ** 0.5 for i in range(5)])
    assert all(r["z"][1] == 0.0 for r in scaled)
