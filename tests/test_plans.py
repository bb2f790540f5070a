"""Plans that must hold at any scale: pruned scans, pushed filters, no needless shuffle."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from solvane.operators import clean, metrics, split, vocab  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_threshold_reaches_the_scan(spark):
    text = plan(clean.at_least(spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", "value"), "value", 10.0))
    assert "GreaterThanOrEqual(value,10.0)" in text and "ReadSchema: struct<event_id:bigint,value:double>" in text


def test_labelling_a_split_does_not_shuffle(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", "value")
    for df in (
        split.split_by_size(events, "event_id", [None, 10, 10], 1),
        split.with_fold_columns(events, "event_id", 5, 1),
        split.hold_out(events, "event_id", 0.2, 1),
        clean.rows_between(events, ["event_id"], 10, 20),
    ):
        assert "Exchange" not in plan(df)


def test_metrics_are_one_pass(spark):
    df = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_returnflag", F.col("l_tax").alias("measured"), F.col("l_discount").alias("predicted"))
    text = plan(metrics.metrics_by(df, ["l_returnflag"]))
    assert text.count("Exchange") == 1 and "SortAggregate" not in text


def test_vocabulary_is_hash_aggregated(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.split("text", " ").alias("tokens"))
    text = plan(vocab.first_seen(docs, "doc_id", "tokens"))
    assert "HashAggregate" in text and "SortAggregate" not in text and text.count("split(") == 1


def test_small_vocabulary_needs_no_shuffle(spark):
    docs = spark.read.parquet(f"{FOLDER}/part.parquet").select("p_partkey", F.split("p_name", " ").alias("tokens"))
    known = spark.createDataFrame([("red", 0), ("ring", 1)], "token string, idx int")
    assert "Exchange" not in plan(vocab.encode_sequences(docs, "p_partkey", "tokens", known))


def test_statistics_read_only_their_column(spark):
    text = plan(entry.queries()["b1_equal_width_bin"](spark, FOLDER))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text
