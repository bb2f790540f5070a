import datetime
import decimal
import math
import random

import pytest
from pyspark.sql import functions as F

from solvane.operators import clean, ranking


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 20)
    monkeypatch.setattr(ranking, "SAMPLE", 60)


def skewed(spark, n=600):
    """A third of the rows share one value."""
    draw = random.Random(3)
    rows = [(i, 5 if i % 3 == 0 else int(draw.expovariate(0.001))) for i in range(n)]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id bigint, v bigint").repartition(5)


def test_keys_at_ranks_with_hot_value(spark, small_tasks):
    rows, df = skewed(spark)
    expected = sorted((v, i) for i, v in rows)
    wanted = [0, 1, 57, 199, 200, 333, 599, 600, 10_000]
    found = ranking.keys_at_ranks(df, ["v", "id"], wanted)
    assert found == {r: expected[r] for r in wanted if r < 600}


def test_keys_at_ranks_of_values_alone(spark, small_tasks):
    rows, df = skewed(spark)
    expected = sorted(v for _, v in rows)
    found = ranking.keys_at_ranks(df, ["v"], [0, 100, 250, 599], rows=600)
    assert found == {r: (expected[r],) for r in (0, 100, 250, 599)}


def test_before_key_counts_match_the_rank(spark, small_tasks):
    _, df = skewed(spark)
    cutoff = ranking.keys_at_ranks(df, ["v", "id"], [217])[217]
    assert df.filter(ranking.before_key(["v", "id"], cutoff)).count() == 217


def test_global_rank_over_partitions(spark, small_tasks):
    rows, df = skewed(spark)
    ranked = ranking.global_rank(df, ["v", "id"])
    expected = {i: r for r, (v, i) in enumerate(sorted((v, i) for i, v in rows))}
    assert {row["id"]: row["rank"] for row in ranked.collect()} == expected
    assert dict(ranked.dtypes)["rank"] == "bigint"


def test_series_position_with_hot_group(spark, small_tasks):
    _, df = skewed(spark)
    placed = ranking.series_position(df, "v", ["id"]).collect()
    groups = {}
    for row in sorted(placed, key=lambda r: r["id"]):
        groups.setdefault(row["v"], []).append(row["position"])
    assert all(positions == list(range(len(positions))) for positions in groups.values())
    assert len(groups[5]) >= 200


def test_rows_between(spark, small_tasks):
    _, df = skewed(spark)
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(clean.rows_between(df, ["id"], 100, 250)) == list(range(100, 250))
    assert ids(clean.rows_between(df, ["id"], 0, 10_000)) == list(range(600))
    assert ids(clean.rows_between(df, ["id"], 590)) == list(range(590, 600))
    assert ids(clean.rows_between(df, ["id"], 900, 950)) == []


def test_nan_does_not_pass_a_threshold(spark):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None), (4, 0.5)], "id int, pce double")
    assert [r["id"] for r in clean.at_least(df, "pce", 1.0).collect()] == [1]
    assert clean.threshold_counts(df, "pce", 1.0).first().asDict() == {"total": 4, "kept": 1, "removed": 3}
    assert [r["id"] for r in clean.drop_incomplete(df, ["pce"]).collect()] == [1, 4]
    thinned = clean.thin_out_below(df, "id", "pce", 1.0, 1.0).agg(F.collect_list("id")).first()[0]
    assert thinned == [1]


KINDS = {
    "string": [f"{'k' * (i % 7)}{i % 90:02d}é" for i in range(500)],
    "date": [datetime.date(2000, 1, 1) + datetime.timedelta(days=(i * 37) % 211) for i in range(500)],
    "timestamp": [datetime.datetime(2000, 1, 1) + datetime.timedelta(microseconds=(i * 7919) % 4001) for i in range(500)],
    "decimal(38,10)": [decimal.Decimal((i * 7919) % 1009) + decimal.Decimal("1E-10") * i + decimal.Decimal(10) ** 27 for i in range(500)],
    "double": [math.inf, -math.inf, 1e308, -1e308, 5e-324, 0.0, *(10.0 ** (i % 300 - 150) for i in range(494))],
    "bigint": [(1 << 62) + (i * 7919) % 503 for i in range(498)] + [-(1 << 63), (1 << 63) - 1],
    "boolean": [i % 3 == 0 for i in range(500)],
}


@pytest.mark.parametrize("few", [20, 100_000])
@pytest.mark.parametrize("kind", KINDS)
def test_keys_of_any_type_at_every_size(spark, monkeypatch, kind, few):
    monkeypatch.setattr(ranking, "FEW", few)
    monkeypatch.setattr(ranking, "SAMPLE", 50)
    values = KINDS[kind]
    df = spark.createDataFrame(list(enumerate(values)), f"id int, v {kind}").repartition(4)
    wanted = [0, 1, 99, 250, 251, 498, 499]
    expected = sorted((v, i) for i, v in enumerate(values))
    assert ranking.keys_at_ranks(df, ["v", "id"], wanted) == {r: expected[r] for r in wanted}
    assert ranking.keys_at_ranks(df, ["v"], wanted) == {r: expected[r][:1] for r in wanted}
    assert clean.rows_between(df, ["v", "id"], 10, 30).count() == 20


def test_one_value_only(spark, small_tasks):
    df = spark.createDataFrame([(math.inf,)] * 400, "v double")
    assert ranking.keys_at_ranks(df, ["v"], [0, 399, 400]) == {0: (math.inf,), 399: (math.inf,)}


def test_no_rows_and_no_ranks(spark):
    assert ranking.keys_at_ranks(spark.createDataFrame([], "v int"), ["v"], [0]) == {}
    assert ranking.keys_at_ranks(spark.range(3), ["id"], []) == {}
