"""Every registered query beside its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tools.check import TABLES, ordered, same_kind  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NEVER = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in NEVER if node in plan]
    cursor = tables.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = ordered([d[0] for d in cursor.description], cursor.fetchall())
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == expected
    assert all(same_kind(kind, types[column]) for column, kind in df.dtypes)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_fits_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).collect()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["ml_phase"] for r in rows} == {"train", "val", "test"}
