import random

import pytest
from pyspark.sql import functions as F

from solvane.functions import arrays, smiles
from solvane.functions.callables import resolve, row_featuriser
from solvane.operators import series, vocab


def tokens(spark):
    draw = random.Random(8)
    rows = [(i, [f"t{int(draw.expovariate(0.1))}" for _ in range(draw.randrange(0, 9))]) for i in range(80)]
    return rows, spark.createDataFrame(rows, "row_id bigint, tokens array<string>").repartition(3)


def python_dictionary(rows, known=()):
    known = dict(known)
    for _, row in sorted(rows):
        for token in row:
            known.setdefault(token, len(known))
    return known


def test_dictionary_is_first_seen(spark):
    rows, df = tokens(spark)
    built = vocab.build_vocabulary(df, "row_id", "tokens")
    assert {r["token"]: r["idx"] for r in built.collect()} == python_dictionary(rows)
    long = vocab.numbered(vocab.first_seen_rows(vocab.token_rows(df, "row_id", "tokens"), "row_id", "pos", "token"))
    assert {r["token"]: r["idx"] for r in long.collect()} == python_dictionary(rows)


def test_extension_keeps_known_ids(spark):
    rows, df = tokens(spark)
    known = spark.createDataFrame([("t3", 0), ("zz", 1)], "token string, idx int")
    long = vocab.first_seen(df, "row_id", "tokens")
    assert {r["token"]: r["idx"] for r in vocab.extend_vocabulary(known, long).collect()} == python_dictionary(rows, {"t3": 0, "zz": 1})
    zero = {r["token"]: r["idx"] for r in vocab.extend_vocabulary(known, long, zero_for_new=True).collect()}
    assert zero["zz"] == 1 and zero["t0"] == 0


def test_null_and_repeated_tokens(spark):
    df = spark.createDataFrame([(1, ["a", None, "b", "a"]), (2, []), (3, None)], "row_id int, tokens array<string>")
    table = spark.createDataFrame([("a", 4), ("a", 2)], "token string, idx int")
    encoded = {r["row_id"]: r["ids"] for r in vocab.encode_sequences(df, "row_id", "tokens", table).collect()}
    assert encoded == {1: [2, -1, -1, 2], 2: [], 3: None}
    assert {r["row_id"] for r in vocab.rows_with_unknown(df, "row_id", "tokens", table).collect()} == {1}


def test_encoding(spark):
    rows, df = tokens(spark)
    known = {"t0": 0, "t1": 1, "t5": 2, "t9": 3}
    table = spark.createDataFrame(list(known.items()), "token string, idx int")
    encoded = {r["row_id"]: r["ids"] for r in vocab.encode_sequences(df, "row_id", "tokens", table).collect()}
    assert encoded == {i: [known.get(t, -1) for t in row] for i, row in rows}
    bad = {r["row_id"] for r in vocab.rows_with_unknown(df, "row_id", "tokens", table).collect()}
    assert bad == {i for i, row in rows if any(t not in known for t in row)}
    with pytest.raises(Exception, match="unknown token"):
        vocab.encode_sequences(df, "row_id", "tokens", table, strict=True).collect()


def python_stop(values, patience, delta, sign=1):
    best, at, stop = None, -1, None
    for epoch, value in enumerate(values):
        if value == value and (best is None or sign * value + delta < best):
            best, at = sign * value, epoch
        elif epoch - at >= patience:
            stop = epoch
            break
    return None if best is None else sign * best, at, stop


@pytest.mark.parametrize("patience,delta,mode", [(3, 0.0, "min"), (4, 0.7, "min"), (2, 0.3, "max"), (50, 0.0, "min")])
def test_early_stopping(spark, monkeypatch, patience, delta, mode):
    monkeypatch.setattr(series, "BLOCK", 4)
    draw = random.Random(6)
    logs = {t: [round(draw.gauss(0, 2), 2) for _ in range(draw.randrange(1, 40))] for t in range(25)}
    logs[100] = [float(-i) for i in range(60)]
    logs[101] = [float("nan")] * 7
    logs[102] = [float("nan"), 3.0, float("nan"), 2.0, 2.0, 2.0, 2.0, 1.0]
    rows = [(t, e, v) for t, log in logs.items() for e, v in enumerate(log)]
    df = spark.createDataFrame(rows, "trial int, epoch int, value double").repartition(4)
    found = {r["trial"]: (r["score"], r["best_epoch"], r["stop_epoch"]) for r in series.early_stopping(df, "trial", "epoch", "value", patience, delta, mode).collect()}
    sign = 1 if mode == "min" else -1
    for trial, log in logs.items():
        score, at, stop = python_stop(log, patience, delta, sign)
        assert found[trial] == (score, None if score is None else at, stop), trial


def test_best_checkpoint_takes_the_earliest(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (1, 2, 1.0), (1, 3, float("nan"))], "trial int, epoch int, value double")
    low = series.best_checkpoint(df, "trial", "epoch", "value").first()
    assert (low["best_epoch"], low["best_value"], low["last_epoch"]) == (1, 1.0, 3)
    assert series.best_checkpoint(df, "trial", "epoch", "value", "max").first()["best_epoch"] == 0


def test_padding(spark):
    df = spark.createDataFrame([(7, [3, -1]), (8, [])], "id int, ids array<int>")
    padded = df.select(arrays.shift_and_pad("ids", 4, "id").alias("p")).collect()
    assert [r["p"] for r in padded] == [[4, 0, 0, 0], [0, 0, 0, 0]]
    with pytest.raises(Exception, match="length 2 exceeds the maximum 1 in row 7"):
        df.select(arrays.shift_and_pad("ids", 1, "id")).collect()


def test_smiles(spark):
    texts = [
        ("[SiH2]1C=c2c3cc([se]c3c3cc4ccccc4cc3c2=C1)-c1cncs1", True, 25),
        ("[SiH2]1cc2cccc(-c3ccc(-c4scc5[nH]ccc45)c4nsnc34)c2c1", True, 26),
        ("CC(C", False, 3), ("C1CC", False, 3), ("C)(C", False, 2), ("CXC", False, 2), ("ClBr%12CC%12", True, 4), ("", False, 0),
    ]
    df = spark.createDataFrame(texts, "s string, ok boolean, n int")
    for row in df.select("*", smiles.looks_valid("s").alias("valid"), smiles.heavy_atoms("s").alias("atoms"), F.length("s").alias("len")).collect():
        assert (row["valid"], row["atoms"]) == (row["ok"], row["n"]), row
    lengths = [r["n"] for r in df.select(F.length("s").alias("n")).limit(2).collect()]
    assert lengths == [50, 52]
    first = df.filter("n = 25").select(F.explode(smiles.atom_tokens("s")).alias("t"))
    symbols = first.select(smiles.atom_symbol(F.col("t")).alias("s"), smiles.is_aromatic(F.col("t")).alias("a")).distinct().collect()
    assert {(r["s"], r["a"]) for r in symbols} == {("Si", False), ("C", False), ("C", True), ("Se", True), ("N", True), ("S", True)}


def test_one_hot(spark):
    df = spark.createDataFrame([("C", True), ("Ge", False)], "s string, a boolean")
    rows = [r["f"] for r in df.select(arrays.one_hot("s", F.col("a")).alias("f")).collect()]
    assert all(len(r) == 18 for r in rows)
    assert (rows[0][1], rows[0][16], rows[0][17], sum(rows[0])) == (1, 0, 1, 2)
    assert (rows[1][16], sum(rows[1])) == (1, 1)


def test_callables(spark):
    df = spark.createDataFrame([("ab",), ("ab",), (None,)], "s string")
    assert df.select(resolve(df, lambda d: F.upper(d["s"])).alias("u")).first()["u"] == "AB"
    codes = row_featuriser(lambda text: [ord(c) for c in text])
    assert [r["c"] for r in df.select(codes("s").alias("c")).collect()] == [[97, 98], [97, 98], None]


def test_rows_with_null_text_are_featurised_and_kept(spark):
    from solvane.operators.vocab import featurise_distinct

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id int, t string")
    out = featurise_distinct(rows, "t", lambda x: x.selectExpr("t", "length(t) as n"), ["n"])
    assert sorted(map(tuple, out.select("id", "t", "n").collect())) == [(1, "a", 1), (2, None, None), (3, "a", 1)]


@pytest.mark.parametrize("limit", [8 << 20, 200, 0])
def test_long_rows_and_vocabularies_beyond_the_limit(spark, limit):
    """Entries within the limit are sent, the others joined: the same ids either way."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    rows = [(i, [draw.choice(words) if draw.random() < 0.6 else "hot" for _ in range(draw.randint(0, 60))]) for i in range(120)]
    rows += [(5, rows[5][1]), (None, ["hot", None, "w3"]), (900, None), (901, []), (902, [f"w{i % 900}" for i in range(20_000)])]
    table = [(w, i) for i, w in enumerate(words[:700])] + [("hot", 5000), ("w3", 9999), (None, 1)]
    known = dict(table[:701])
    df = spark.createDataFrame(rows, "id int, words array<string>").repartition(3)
    found = vocab.encode_sequences(df, "id", "words", spark.createDataFrame(table, "token string, idx int"), limit=limit).collect()
    expected = [(i, None if t is None else [known.get(w, -1) for w in t]) for i, t in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    nothing = vocab.encode_sequences(df.limit(0), "id", "words", spark.createDataFrame(table, "token string, idx int"), limit=limit)
    assert nothing.columns == ["id", "ids"] and nothing.count() == 0
    with pytest.raises(Exception, match="unknown token: w"):
        vocab.encode_sequences(df, "id", "words", spark.createDataFrame(table, "token string, idx int"), strict=True, limit=limit).collect()


@pytest.mark.parametrize("delta", [0.0, 2.5])
def test_long_falling_series(spark, delta):
    """Every value improves: the chain is followed without a Python worker and without one task for the trial."""
    n = 30_000
    log = spark.range(n).selectExpr("7 as trial", "id as epoch", "cast(-id as double) as value").repartition(4)
    found = series.early_stopping(log, "trial", "epoch", "value", 5, delta)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "InPandas" not in text and "InArrow" not in text
    (row,) = found.collect()
    step = 1 if delta == 0 else 3
    last = (n - 1) // step * step
    assert (row["score"], row["best_epoch"], row["stop_epoch"]) == (-float(last), last, None)


def test_trials_without_values_and_gaps_longer_than_patience(spark):
    rows = [(1, e, None) for e in range(5)] + [(2, e, float("nan") if e < 3 else 1.0) for e in range(6)]
    df = spark.createDataFrame(rows, "trial int, epoch int, value double")
    for delta in (0.0, 0.5):
        found = {r["trial"]: tuple(r)[1:] for r in series.early_stopping(df, "trial", "epoch", "value", 2, delta).collect()}
        assert found == {1: (None, None, 1), 2: (None, None, 1)}
