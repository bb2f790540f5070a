import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from solvane.operators import ranking, split


def hashed(seed, i):
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16)


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 50)
    monkeypatch.setattr(ranking, "SAMPLE", 100)
    monkeypatch.setattr(split, "RANGE_ROWS", 50)


def numbers(spark, n, parts=4):
    return spark.range(n).repartition(parts)


def by_phase(df, column="ml_phase"):
    found = {}
    for row in df.collect():
        found.setdefault(row[column], set()).add(row["id"])
    return found


def test_sizes_are_exact_and_partition_independent(spark, small_tasks):
    a = by_phase(split.split_by_size(numbers(spark, 1000, 3), "id", [700, None, 100], 200))
    b = by_phase(split.split_by_size(numbers(spark, 1000, 7), "id", [700, None, 100], 200))
    assert a == b
    assert {k: len(v) for k, v in a.items()} == {"train": 700, "val": 200, "test": 100}
    order = sorted(range(1000), key=lambda i: (hashed(200, i), i))
    assert a["train"] == set(order[:700]) and a["test"] == set(order[900:])


def test_given_test_size_never_truncates(spark):
    found = by_phase(split.split_by_size(numbers(spark, 100), "id", [50, 20, 10], 1))
    assert {k: len(v) for k, v in found.items()} == {"train": 50, "val": 20, "test": 30}


def test_first_missing_size_is_derived():
    assert split.resolve_sizes(236, [200, None, 36]) == (200, 0, 36)
    assert split.resolve_sizes(100, [None, 20, 30]) == (50, 20, 30)
    assert split.resolve_sizes(100, [50, 20, None]) == (50, 20, 30)
    with pytest.raises(ValueError):
        split.resolve_sizes(10, [8, 4, 1])


def test_random_subset(spark, small_tasks):
    found = by_phase(split.random_subset(numbers(spark, 1000), "id", [100, 20, 30]))
    assert {k: len(v) for k, v in found.items()} == {"train": 100, "val": 20, "test": 30}
    with pytest.raises(ValueError):
        split.random_subset(numbers(spark, 10), "id", [9, 1, 1])


@pytest.mark.parametrize("n,k", [(103, 5), (20, 7), (3, 5)])
def test_folds_cover_every_row_once(spark, n, k):
    rows = split.with_fold_columns(numbers(spark, n), "id", k, 200).collect()
    assert all(sum(row[f"ml_phase_fold_{i}"] == "test" for i in range(k)) == 1 for row in rows)
    sizes = [sum(row[f"ml_phase_fold_{i}"] == "test" for row in rows) for i in range(k)]
    assert sizes == split.fold_sizes(n, k)


def test_fold_roles(spark):
    rows = split.fold_roles(numbers(spark, 50), "id", 4, 1).collect()
    assert len(rows) == 200 and sum(r["role"] == "val" for r in rows) == 50


def test_hold_out_rounds_up(spark):
    found = by_phase(split.hold_out(numbers(spark, 101), "id", 0.2, 5))
    assert len(found["val"]) == 21 and len(found["train"]) == 80


def test_batches(spark, small_tasks):
    sizes = split.with_batch(numbers(spark, 1010), "id", 250, 3).groupBy("batch_id").count().collect()
    assert sorted((r["batch_id"], r["count"]) for r in sizes) == [(0, 250), (1, 250), (2, 250), (3, 250), (4, 10)]
    in_order = split.with_batch(numbers(spark, 100), "id", 30, None).collect()
    assert all(r["batch_id"] == r["id"] // 30 for r in in_order)


def brute_sample(rows, size, step, seed):
    strata = {}
    for i, v in rows:
        strata.setdefault(math.ceil(v / step) - 1 if v > 0 else -1, []).append((hashed(seed, i), i))
    total = len(rows)
    quota = {b: size * len(members) // total for b, members in strata.items()}
    left = size - sum(quota.values())
    for b in sorted(strata, key=lambda b: (-(size * len(strata[b]) % total), b))[:left]:
        quota[b] += 1
    return {i for b, members in strata.items() for _, i in sorted(members)[: quota[b]]}


def skewed_values(n=900):
    draw = random.Random(5)
    return [(i, 1.05 if i % 3 == 0 else round(draw.uniform(-0.5, 6), 3)) for i in range(n)]


@pytest.mark.parametrize("tight", [False, True])
def test_stratified_sample_matches_brute_force(spark, tight, request):
    if tight:
        request.getfixturevalue("small_tasks")
    rows = skewed_values()
    df = spark.createDataFrame(rows, "id bigint, pce double").repartition(5)
    sample, rest = split.stratified_sample(df, "id", "pce", 217, 0.5, seed=4)
    drawn = {r["id"] for r in sample.collect()}
    assert drawn == brute_sample(rows, 217, 0.5, 4)
    assert {r["id"] for r in rest.collect()} == {i for i, _ in rows} - drawn


@pytest.mark.parametrize("tight", [False, True])
def test_stratified_cascade_is_repeated_sampling(spark, tight, request):
    if tight:
        request.getfixturevalue("small_tasks")
    rows = skewed_values()
    df = spark.createDataFrame(rows, "id bigint, pce double").repartition(3)
    found = by_phase(split.stratified_split(df, "id", "pce", [500, 101, 200], 0.5))
    left = rows
    for phase, size in (("train", 500), ("val", 101), ("test", 200)):
        assert found[phase] == brute_sample(left, size, 0.5, 0)
        left = [r for r in left if r[0] not in found[phase]]
    samples = split.stratified_cascade(df, "id", "pce", [500, 0, 400], 0.5)
    assert [d.count() for d in samples] == [500, 0, 400]


def test_strict_strata(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.1), (3, 5.0)], "id bigint, pce double")
    with pytest.raises(ValueError):
        split.draw_stratified(df, "id", F.ceil("pce"), [2], 0, strict=True)
    with pytest.raises(ValueError):
        split.stratified_sample(df, "id", "pce", 4, 1.0)


def test_complement(spark):
    df = numbers(spark, 20)
    rest = split.complement(df, df.filter("id < 12"), "id")
    assert sorted(r["id"] for r in rest.collect()) == list(range(12, 20))
