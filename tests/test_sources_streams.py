import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from solvane.operators import models
from solvane.operators.scaling import Scaler
from solvane.sources import records, sinks, tables
from solvane.operators import series
from solvane.streaming import logs

RECORDS = """c1ccsc1
InChI=1S/example-a
doi-a,KEY-A,bulk,normal,PC61BM,-5.1,-3.2,1.9,1.8,4.5,0.8,9.1,0.6
c1ccsc1
1
Conformer 0
2
C 0 0 0
S 0 0 1
dft 1
dft 2
dft 3
dft 4
CCO
InChI=1S/example-b
doi-b,KEY-B,bulk,inverted,PC71BM,nan,-3.0,2.0,1.9,3.0,0.7,8.0,0.5
CCO
0
"""


def test_records(spark, tmp_path):
    (tmp_path / "a.data").write_text(RECORDS)
    (tmp_path / "b.data").write_text(RECORDS.replace("CCO", "CCN"))
    rows = records.read_records(spark, str(tmp_path)).orderBy("smiles", "doi").collect()
    assert rows[0].__fields__ == records.RECORD_COLUMNS
    assert [r["smiles"] for r in rows] == ["CCN", "CCO", "c1ccsc1", "c1ccsc1"]
    assert (rows[2]["inchi"], rows[2]["homo"], rows[2]["pce"], rows[2]["numberconformers"]) == ("InChI=1S/example-a", -5.1, 4.5, 1)
    assert rows[1]["homo"] != rows[1]["homo"] and rows[1]["prunedsmiles"] == "CCO" and rows[1]["conformers"] is None


def test_records_across_file_splits(spark, tmp_path):
    many = "".join(RECORDS.replace("c1ccsc1", f"c1ccsc1{'C' * (i % 17)}").replace("CCO", f"CCO{'N' * (i % 13)}").replace("doi-", f"{i}-") for i in range(300))
    (tmp_path / "many.data").write_text(many)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1777b")
    try:
        df = records.read_records(spark, str(tmp_path))
        rows = {r["doi"]: (r["smiles"], r["prunedsmiles"], r["numberconformers"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 600
    assert all(smiles == pruned and count == int(doi.endswith("-a")) for doi, (smiles, pruned, count) in rows.items())
    assert sum(count for _, _, count in rows.values()) == 300


def test_wrong_conformer_count(spark, tmp_path):
    (tmp_path / "bad.data").write_text(RECORDS.replace("\n1\nConformer", "\n2\nConformer"))
    with pytest.raises(Exception, match="wrong number of conformers"):
        records.read_records(spark, str(tmp_path)).collect()


def test_polymers_are_latin_1_and_positional(spark, tmp_path):
    head = "\t".join(f"Column {i} (°)" for i in range(16))
    row = ["7", "café", "ref"] + [str(i / 2) for i in range(8)] + ["mono", "5.1", "", "1.5", "CC"]
    (tmp_path / "p.txt").write_bytes(f"{head}\n{chr(9).join(row)}\n".encode("iso-8859-1"))
    found = tables.read_polymers(spark, str(tmp_path / "p.txt")).first()
    assert found.__fields__ == tables.POLYMER_COLUMNS
    assert (found["id"], found["nickname"], found["pcemax"], found["neglumo"], found["smiles"]) == (7, "café", 0.0, None, "CC")


def test_optional_input(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(0, 1.0)], "n int, v double"), str(tmp_path / "a"))
    assert tables.read_all(spark, str(tmp_path / "a"), str(tmp_path / "b"), "n int, v double").count() == 1
    sinks.write_csv(spark.createDataFrame([(1, 2.0)], "n int, v double"), str(tmp_path / "b"))
    both = tables.read_all(spark, str(tmp_path / "a"), str(tmp_path / "b"), "n int, v double")
    assert sorted(map(tuple, both.select("row_id", "v").collect())) == [(0, 1.0), (1, 2.0)]


def test_dataset_by_column_and_by_size(spark, tmp_path):
    rows = [(i, f"C{i}", float(i), "train" if i < 6 else "val" if i < 8 else "test") for i in range(10)]
    spark.createDataFrame(rows, "id bigint, s string, pce double, phase string").write.parquet(str(tmp_path / "d"))
    spec = {"src": str(tmp_path / "d"), "x_column": ["s"], "y_column": ["pce"], "split": "phase"}
    data = tables.load_dataset(spark, spec, "id")
    assert (data.scaler.mean, [d.count() for d in data.phases()]) == (2.5, [6, 2, 2])
    by_size = tables.load_dataset(spark, {**spec, "split": [5, None, 2]}, "id")
    assert [d.count() for d in by_size.phases()] == [5, 3, 2]


def test_prediction_table(spark):
    df = spark.createDataFrame([("test set", 4.0, 5.0)], "phase string, measured double, predicted double")
    row = sinks.prediction_table(df, Scaler(2.0, 2.0), inverse=False).first()
    assert (row["Measured PCE"], row["Predicted PCE"]) == (1.0, 1.5)
    assert sinks.prediction_table(df, Scaler(2.0, 2.0), inverse=True).first()["Predicted PCE"] == 5.0


def test_streams_continue_over_batches(spark, tmp_path):
    schema = "trial int, epoch int, value double, study string, state string"
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    kind = spark.createDataFrame([], schema).schema
    batches = [[(1, 0, 5.0, "s", "COMPLETE"), (2, 0, 1.0, "s", "FAIL")], [(1, 2, 3.0, "s", "FAIL"), (1, 1, 4.0, "s", "RUNNING")], [(1, 9, 8.0, "t", "FAIL")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for name, stream, key in (
            ("study", logs.study_progress(logs.read_log(spark, source, kind, per_trigger=1), max_failed=2), "study"),
            ("trial", logs.trial_progress(logs.read_log(spark, source, kind), patience=7), "trial"),
        ):
            logs.write_updates(stream, f"{out}/{name}", f"{check}/{name}", key)
    studies = {r["study"]: (r["all"], r["completed"], r["failed"], r["stop"]) for r in logs.latest_state(spark, f"{out}/study").collect()}
    assert studies == {"s": (4, 1, 2, True), "t": (1, 0, 1, False)}
    found = {r["trial"]: (r["latest_epoch"], r["best_epoch"], r["best_value"], r["checks"], r["stop"]) for r in logs.latest_state(spark, f"{out}/trial").collect()}
    assert found == {1: (9, 2, 3.0, 4, True), 2: (0, 0, 1.0, 1, False)}


CHECKS = "trial int, epoch int, value double"


def run_stopping(spark, source, out, patience, delta, mode="min"):
    kind = spark.createDataFrame([], CHECKS).schema
    stream = logs.stopping_progress(logs.read_log(spark, source, kind, per_trigger=1), patience, delta, mode)
    logs.write_updates(stream, f"{out}/result", f"{out}/checkpoint", "trial")
    return {r["trial"]: tuple(r)[1:] for r in logs.latest_state(spark, f"{out}/result").collect()}


@pytest.mark.parametrize("patience, delta, mode", [(3, 0.0, "min"), (4, 0.5, "max"), (0, 0.0, "min")])
def test_streamed_stopping_equals_the_batch_rule(spark, tmp_path, patience, delta, mode):
    """Checks in any order over several batches and a restart; some arrive twice."""
    draw = random.Random(6)
    rows = [(1, e, v) for e, v in enumerate([5.0, 6.0, 6.0, 6.0, 6.0, 1.0, 2.0])]
    rows += [(t, e, draw.choice([None, float("nan"), *(round(draw.gauss(0, 2), 1) for _ in range(8))])) for t in range(2, 9) for e in range(draw.randint(1, 25))]
    draw.shuffle(rows)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :] + rows[:5]):
        for i in range(0, len(part), 40):
            spark.createDataFrame(part[i : i + 40], CHECKS).coalesce(1).write.mode("append").parquet(source)
        found = run_stopping(spark, source, out, patience, delta, mode)  # the second call goes on from the first
    whole = spark.createDataFrame(rows, CHECKS)
    expected = {r["trial"]: tuple(r)[1:] for r in series.early_stopping(whole, "trial", "epoch", "value", patience, delta, mode).collect()}
    clean = {t: (None if v[0] is None or v[0] != v[0] else v[0], *v[1:3]) for t, v in found.items()}
    assert clean == {t: (None if v[0] is None or v[0] != v[0] else v[0], *v[1:]) for t, v in expected.items()}
    assert all(v[4] == 0 for v in found.values())


def test_a_stop_is_final_and_early_checks_wait(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    steps = [([(1, 0, 5.0), (1, 2, 6.0)], (5.0, 0, None, 1, 1)), ([(1, 1, 6.0), (1, 4, 1.0)], (5.0, 0, None, 3, 1)), ([(1, 3, 9.0)], (5.0, 0, 3, 4, 0)), ([(1, 5, 0.0)], (5.0, 0, 3, 4, 0))]
    for rows, expected in steps:
        spark.createDataFrame(rows, CHECKS).coalesce(1).write.mode("append").parquet(source)
        assert run_stopping(spark, source, out, 3, 0.0) == {1: expected}


def test_result_table_does_not_grow_with_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    files = []
    for i in range(7):
        spark.createDataFrame([(i % 2, i // 2, float(i))], CHECKS).coalesce(1).write.mode("append").parquet(source)
        found = run_stopping(spark, source, out, 9, 0.0)
        files.append(len(spark.read.parquet(f"{out}/result").inputFiles()))
    assert {t: v[3] for t, v in found.items()} == {0: 4, 1: 3}
    assert max(files[3:]) <= 2 * 2 * 2  # two copies of a state that is written by few tasks


def test_a_batch_is_worked_out_once(spark, tmp_path):
    """Three batches, the later two merged into what is there: each changed group is worked out once."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame([(t, i, float(t + i)) for t in range(5)], CHECKS).coalesce(1).write.mode("append").parquet(source)
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(part.num_rows)
            yield part

    log = logs.read_log(spark, source, spark.createDataFrame([], CHECKS).schema, per_trigger=1)
    found = logs.stopping_progress(log, 9)
    logs.write_updates(found.mapInArrow(counted, found.schema), f"{out}/result", f"{out}/checkpoint", "trial")
    assert {r["trial"]: r["checks"] for r in logs.latest_state(spark, f"{out}/result").collect()} == {t: 3 for t in range(5)}
    assert read.value == 15


def test_metric_log_folders(spark, tmp_path):
    log = spark.range(40).select((F.col("id") % 2).alias("trial"), (F.col("id") % 3).alias("fold"), F.col("id").alias("epoch"))
    for _ in range(2):
        sinks.append_metric_log(log, str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    assert stored.count() == 80 and stored.select("trial", "fold").distinct().count() == 6


def test_forest_parameters(spark):
    forest = models.forest_regressor({"n_estimators": 17, "max_depth": 30, "min_samples_split": 2, "min_samples_leaf": 4, "max_features": 0.1, "bootstrap": False, "max_samples": 50}, rows=200)
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (17, 30, 4)
    assert (forest.getFeatureSubsetStrategy(), forest.getBootstrap(), forest.getSubsamplingRate()) == ("0.1", False, 0.25)
    for unsupported in ({"max_depth": 31}, {"min_samples_split": 3}, {"max_samples": 50}):
        with pytest.raises(ValueError):
            models.forest_regressor(unsupported)


def test_rows_of_the_streamed_early_stopping_are_made_at_once():
    """A list of tuples whose columns were turned into their types one by one took five times as long, once a group and batch."""
    def turned(*values):
        row = pd.DataFrame([values[1:]], columns=["score", "best_epoch", "stop_epoch", "checks", "waiting"])
        row = row.astype({"score": "float64", "best_epoch": "Int64", "stop_epoch": "Int64", "checks": "int64", "waiting": "int64"})
        row.insert(0, "trial", values[0])
        return row

    times = []
    cases = [(2**60 + 1, 1.5, 2**60 + 1, None, 4, 0), (0, None, None, 0, 0, 3)]
    for make in (logs._stopping_row, turned):
        begun = time.perf_counter()
        for _ in range(100):
            made = [make(*case) for case in cases]
        times.append(time.perf_counter() - begun)
        assert [[None if pd.isna(v) else v for v in (row[c].iloc[0] for c in row.columns)] for row in made] == [list(case) for case in cases]
        assert [str(t) for t in made[0].dtypes] == ["int64", "float64", "Int64", "Int64", "int64", "int64"]
    assert 2 * times[0] < times[1]
