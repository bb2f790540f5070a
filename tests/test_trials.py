import math

import pytest
from pyspark.sql import functions as F

from solvane.operators import study, trials

def sampled(spark, space, n=60):
    return spark.range(n).withColumnRenamed("id", "number").transform(lambda df: trials.sample_parameters(df, "number", space, 11)).collect()


@pytest.mark.parametrize("direction, ordered", [("decreasing", lambda v: sorted(v, reverse=True)), ("increasing", sorted), ("constant", lambda v: v[:1] * len(v))])
def test_directed_lists_stay_inside_their_bounds(spark, direction, ordered):
    rows = sampled(spark, {"sizes": {"type": "int", "low": -3, "high": 25, "length": 5, "direction": direction}})
    for row in rows:
        assert len(row["sizes"]) == 5 and row["sizes"] == ordered(row["sizes"]) and all(-3 <= v <= 25 for v in row["sizes"])
    assert len({tuple(r["sizes"]) for r in rows}) > 10


def test_given_values_repeat_the_last_one(spark):
    row = sampled(spark, {"given": {"values": [8, 6], "length": 5}, "plain": [2, 9], "one": {"starting_value": 12, "length": 3}}, 1)[0]
    assert (row["given"], row["plain"], row["one"]) == ([8, 6, 6, 6, 6], [2, 9], [12, 12, 12])


def test_lists_refer_to_earlier_parameters(spark):
    space = {
        "depth": {"type": "int", "low": 2, "high": 6},
        "sizes": {"type": "int", "low": 50, "high": 70, "length": "depth", "starting_value": "depth"},
        "again": {"values": [5], "length": "sizes"},
    }
    for row in sampled(spark, space):
        assert len(row["sizes"]) == row["depth"] == row["sizes"][0] and all(50 <= v <= 70 for v in row["sizes"][1:])
        assert row["again"] == [5] * row["depth"]


def test_scalar_ranges(spark):
    space = {
        "c": {"type": "categorical", "choices": [True, False]},
        "i": {"type": "int", "low": 3, "high": 9, "step": 3},
        "l": {"type": "int", "low": 1, "high": 64, "log": True},
        "u": {"type": "uniform", "low": -1.0, "high": 2.0},
        "g": {"type": "loguniform", "low": 1e-4, "high": 1e-1},
        "q": {"type": "discrete_uniform", "low": 0.0, "high": 1.0, "q": 0.5},
    }
    rows = trials.sample_parameters(spark.range(2000).withColumnRenamed("id", "number"), "number", space, 1).collect()
    assert {r["c"] for r in rows} == {True, False} and {r["i"] for r in rows} == {3, 6, 9}
    assert {r["q"] for r in rows} == {0.0, 0.5, 1.0} and min(r["l"] for r in rows) == 1 and max(r["l"] for r in rows) == 64
    assert sum(r["u"] for r in rows) / 2000 == pytest.approx(0.5, abs=0.06)
    assert sum(math.log10(r["g"]) for r in rows) / 2000 == pytest.approx(-2.5, abs=0.06)
    with pytest.raises(ValueError):
        trials.sampled_value({"type": "other", "low": 0, "high": 1}, F.lit(0.5))


def recorded(spark):
    rows = [("a", 0, "COMPLETE", 2.0), ("a", 1, "COMPLETE", 1.0), ("a", 2, "COMPLETE", 1.0), ("a", 3, "FAIL", None), ("b", 0, "RUNNING", None), ("a", 4, "PRUNED", 0.1), ("a", 5, "COMPLETE", float("nan"))]
    return spark.createDataFrame(rows, "study string, number int, state string, value double")


def test_counts_best_and_resume(spark):
    table = recorded(spark)
    counts = table.filter("study = 'a'").agg(*trials.state_counts()).first().asDict()
    assert counts == {"all": 6, "running": 0, "completed": 4, "pruned": 1, "failed": 1}
    best = trials.best_trial(table, "minimize", ("study",)).collect()
    assert [(r["study"], r["number"], r["value"]) for r in best] == [("a", 1, 1.0)]
    assert trials.best_trial(table, "maximize").first()["number"] == 0
    assert trials.total_trials(20, trials.previous_trials(table, "a")) == 25
    assert trials.total_trials(20, trials.previous_trials(table, "none")) == 20


def test_failed_trials_do_not_end_a_study_until_there_are_too_many(spark):
    numbers = spark.range(10).withColumnRenamed("id", "number")

    def objective(row):
        if row["number"] % 2:
            raise ValueError("odd")
        return spark.range(row["number"] + 1).count()

    found = {r["number"]: (r["state"], r["value"]) for r in study.run_trials(spark, numbers, objective, n_jobs=3).collect()}
    assert found == {n: ("FAIL", None) if n % 2 else ("COMPLETE", n + 1.0) for n in range(10)}
    stopped = study.run_trials(spark, numbers, objective, max_failed=2).collect()
    assert sorted(r["number"] for r in stopped) == [0, 1, 2, 3]

    def broken(row):
        raise KeyError("unexpected")

    with pytest.raises(KeyError):
        study.run_trials(spark, numbers, broken)
