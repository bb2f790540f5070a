import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvane.functions import kernels
from solvane.functions.arrays import pack_bits
from solvane.operators import kernel, linear, models
from solvane.plans.features import prepare_features


def molecules(spark, n, seed):
    draw = random.Random(seed)
    rows = [(i, sorted(draw.sample(range(130), draw.randrange(0, 40))), [draw.uniform(-1, 1) for _ in range(3)]) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, bits array<int>, phys array<double>")
    return rows, df.select("id", pack_bits("bits", 130).alias("words"), "phys")


def tanimoto(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


CASES = {
    "tanimoto": ({}, lambda x, y: tanimoto(x[1], y[1])),
    "rbf": ({"gamma": 0.5}, lambda x, y: math.exp(-0.5 * distance(x[2], y[2]))),
    "linear": ({}, lambda x, y: sum(a * b for a, b in zip(x[2], y[2]))),
    "poly": ({"gamma": 0.5, "degree": 2, "coef0": 1.0}, lambda x, y: (0.5 * sum(a * b for a, b in zip(x[2], y[2])) + 1) ** 2),
    "sigmoid": ({"gamma": 0.5}, lambda x, y: math.tanh(0.5 * sum(a * b for a, b in zip(x[2], y[2])))),
    "rbf_kernel_phys_and_struct": (
        {"gamma_structural": 0.8, "gamma_physical": 0.3, "alpha": 0.25},
        lambda x, y: 0.25 * math.exp(-0.8 * (1 - tanimoto(x[1], y[1]))) + 0.75 * math.exp(-0.3 * distance(x[2], y[2])),
    ),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("block_rows", [256, 4])
def test_full_matrix(spark, name, block_rows):
    """A table against itself, in one block and in several."""
    params, expected = CASES[name]
    rows, df = molecules(spark, 15, 1)
    found = kernel.kernel_matrix(df, "id", df, "id", kernels.resolve_kernel(name, **params), ["words", "phys"], block_rows).collect()
    assert len(found) == 225
    assert all(r["k"] == pytest.approx(expected(rows[r["x_id"]], rows[r["y_id"]])) for r in found)


@pytest.mark.parametrize("pairs", [30, 1000])
def test_tiles_give_the_same_values(spark, monkeypatch, pairs):
    """A support beyond the limit is dealt into a grid of tiles; no row is copied along both sides."""
    monkeypatch.setattr(kernel, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(kernel, "TILE_PAIRS", pairs)
    params, expected = CASES["rbf_kernel_phys_and_struct"]
    x_rows, x = molecules(spark, 60, 1)
    y_rows, y = molecules(spark, 25, 2)
    function = kernels.resolve_kernel("rbf_kernel_phys_and_struct", **params)
    found = kernel.kernel_matrix(x, "id", y, "id", function, ["words", "phys"], 4).collect()
    assert len(found) == len({(r["x_id"], r["y_id"]) for r in found}) == 60 * 25
    assert all(r["k"] == pytest.approx(expected(x_rows[r["x_id"]], y_rows[r["y_id"]])) for r in found)
    weighted = y.withColumn("w", (F.col("id") % 5).cast("double") - 2)
    scores = kernel.kernel_score(x, "id", weighted, "id", "w", 0.25, function, ["words", "phys"], 4).collect()
    assert len(scores) == 60
    for r in scores:
        assert r["predicted"] == pytest.approx(0.25 + sum((i % 5 - 2) * expected(x_rows[r["x_id"]], y_rows[i]) for i in range(25)))
    values = kernel.kernel_features(x, "id", y, "id", function, ["words", "phys"]).collect()
    assert all(r["values"] == pytest.approx([expected(x_rows[r["x_id"]], y_rows[i]) for i in range(25)]) for r in values)
    text = kernel.kernel_matrix(x, "id", y, "id", function, ["words", "phys"], 4)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in text.lower()


def test_copies_grow_with_the_root_of_the_tiles():
    for x_rows, y_rows in ((10**6, 10**6), (10**8, 10**4), (10**4, 10**8), (10, 10)):
        rows, columns = kernel.tile_bands(x_rows, y_rows, 20_000_000)
        tiles = max(1, x_rows * y_rows / 20_000_000)
        assert rows * columns >= tiles and rows * columns <= 2 * tiles + 2
        assert x_rows * columns + y_rows * rows <= 4 * (x_rows * y_rows * tiles) ** 0.5 + x_rows + y_rows


def numbers(spark, n, seed, width=2):
    draw = random.Random(seed)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(width)]) for i in range(n)]
    data = [(i, x, math.sin(3 * x[0]) + x[1] + draw.gauss(0, 0.1)) for i, x in rows]
    return data, spark.createDataFrame(data, "id bigint, phys array<double>, y double").repartition(3)


@pytest.mark.parametrize("intercept", [False, True])
def test_all_rows_as_landmarks_are_kernel_ridge_regression(spark, intercept):
    data, df = numbers(spark, 40, 3)
    reg = 0.01
    fitted = models.NystromRegression(kernels.physical(0.8), ["phys"], landmarks=40, reg=reg, intercept=intercept).fit(df, "id", "y")
    found = {r["id"]: r["predicted"] for r in fitted.transform(df, "id").collect()}
    k = np.array([[math.exp(-0.8 * distance(a[1], b[1])) for b in data] for a in data])
    y, ones = np.array([r[2] for r in data]), np.ones(len(data))
    inverse = np.linalg.inv(k + reg * len(data) * np.eye(len(data)))
    offset = (ones @ inverse @ y) / (ones @ inverse @ ones) if intercept else 0.0
    expected = offset + k @ inverse @ (y - offset)
    assert [found[i] for i in range(40)] == pytest.approx(expected, abs=1e-5)


def test_few_landmarks_come_near(spark):
    data, df = numbers(spark, 200, 4)
    fitted = models.NystromRegression(kernels.physical(0.8), ["phys"], landmarks=30, reg=1e-4).fit(df, "id", "y")
    error = fitted.transform(df, "id").selectExpr("avg((predicted - y) * (predicted - y)) as e").first()["e"]
    assert error < 0.03 and fitted.landmarks.count() == 30


@pytest.mark.parametrize("reg, intercept", [(0.0, True), (0.3, True), (0.3, False)])
def test_folds_by_subtraction_equal_single_fits(spark, reg, intercept):
    data, df = numbers(spark, 90, 5, 3)
    folded = df.withColumn("fold", F.pmod("id", F.lit(4)).cast("int"))
    extra = spark.createDataFrame([(900, [1.0, None, 2.0], 1.0, 0), (901, None, 1.0, 1), (902, [1.0, 1.0, 1.0], None, 2)], "id bigint, phys array<double>, y double, fold int")
    found = linear.cross_validated_ridge(folded.unionByName(extra), "phys", "y", "fold", [reg], intercept).collect()
    x, y = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    for row in found:
        train = np.arange(90) % 4 != row["fold"]
        z = np.column_stack([np.ones(90) if intercept else np.zeros(90), x])
        penalty = reg * train.sum() * np.diag([0.0 if intercept else 1.0, 1, 1, 1])
        w = np.linalg.solve(z[train].T @ z[train] + penalty, z[train].T @ y[train])
        squares = (y - z @ w) ** 2
        assert (row["train_mse"], row["test_mse"]) == pytest.approx((squares[train].mean(), squares[~train].mean()))
    assert len(found) == 4


def test_sparse_bits(spark):
    df = spark.createDataFrame([(1, [0, 5, 2047]), (2, []), (3, [7, 7])], "id int, bits array<int>")
    found = {r["id"]: r["features"] for r in models.bit_vectors(df, "bits", 2048).collect()}
    assert found[1].size == 2048 and found[1].indices.tolist() == [0, 5, 2047] and found[1].values.tolist() == [1.0] * 3
    assert found[2].numNonzeros() == 0 and found[3].values.tolist() == [1.0]


def test_features_with_a_scaler_of_another_table(spark):
    train = spark.createDataFrame([(1, [0, 3], [1.0, 5.0], 2.0), (2, [1], [3.0, 5.0], 4.0)], "id int, bits array<int>, numbers array<double>, t double")
    features, scaler = prepare_features(train, "id", "bits", 64, "numbers", "t")
    assert [tuple(r) for r in features.orderBy("id").collect()] == [(1, [9], [-1.0, 0.0], 2.0), (2, [2], [1.0, 0.0], 4.0)]
    other = spark.createDataFrame([(9, [5.0, 6.0])], "id int, numbers array<double>")
    again, _ = prepare_features(other, "id", physical="numbers", scaler=scaler)
    assert tuple(again.first()) == (9, [3.0, 1.0])
    with pytest.raises(ValueError):
        prepare_features(other, "id")


def test_product_kernel_and_dropped_halves(spark):
    rows, df = molecules(spark, 6, 2)
    for params, expected in [
        ({"gamma_structural": 0.8, "gamma_physical": 0.3}, lambda x, y: math.exp(-0.8 * (1 - tanimoto(x[1], y[1])) - 0.3 * distance(x[2], y[2]))),
        ({"gamma_structural": 0.8}, lambda x, y: math.exp(-0.8 * (1 - tanimoto(x[1], y[1])))),
        ({"gamma_physical": 0.3, "alpha": 0.5}, lambda x, y: math.exp(-0.3 * distance(x[2], y[2]))),
    ]:
        found = kernel.kernel_matrix(df, "id", df, "id", kernels.combined(**params), ["words", "phys"]).collect()
        assert all(r["k"] == pytest.approx(expected(rows[r["x_id"]], rows[r["y_id"]])) for r in found)


@pytest.mark.parametrize("block_rows", [256, 3])
def test_scores(spark, block_rows):
    rows, df = molecules(spark, 12, 3)
    weights = spark.createDataFrame([(i, i - 4.5) for i in range(12)], "id bigint, w double")
    support = df.join(weights, "id")
    params, k = CASES["rbf"]
    found = kernel.kernel_score(df, "id", support, "id", "w", 0.5, kernels.resolve_kernel("rbf", **params), ["phys"], block_rows).collect()
    for row in found:
        assert row["predicted"] == pytest.approx(0.5 + sum((i - 4.5) * k(rows[row["x_id"]], rows[i]) for i in range(12)))


def test_unknown_kernel():
    with pytest.raises(ValueError):
        kernels.resolve_kernel("other")


def test_landmarks_and_regression(spark):
    rows, df = molecules(spark, 80, 4)
    target = spark.createDataFrame([(i, 2.0 * p[0] - p[1]) for i, _, p in rows], "id bigint, y double")
    data = df.join(target, "id")
    assert models.choose_landmarks(data, "id", 17).count() == 17
    assert models.choose_landmarks(data, "id", 500).count() == 80
    fitted = models.KernelRegression(kernels.physical(0.3), ["phys"], landmarks=20, reg=1e-6).fit(data, "id", "y")
    scored = fitted.transform(data, "id").selectExpr("avg((y - predicted) * (y - predicted)) as mse", "var_pop(y) as spread").first()
    assert scored["mse"] < 0.05 * scored["spread"]


def test_all_positions_are_scaled(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["k5_prepare_all_features"](spark, "/root/testdata/sf0.001").collect()
    first = {r.vec_id: r for r in entry.queries()["k5_prepare_features"](spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(first) and all(len(r.scaled) == 64 and r.scaled == pytest.approx(first[r.vec_id].scaled, abs=2e-5) for r in rows)
