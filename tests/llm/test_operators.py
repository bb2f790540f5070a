"""The operators against the libraries and brute force, with nulls, ties, empty tables and clashing names."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from solvane.llm import bpe_words, curriculum, extraction, fingerprints, quality, queries, shards, simhash, token_counts, token_files, vector_links
from solvane.llm.components import connected, forest
from solvane.storage import scratch_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, kept string, row string, words string"
PIECES = ["'s", "'re", "'r", " ", "  ", "\n", "\t", " ", "a", "the", " The", "don't", "é", "ß", "123", "!!", ",", "<|endoftext|>", "<|endof", "👍🏽", "漢字", "\x1c", "aaaaaaaa", "word"]


def texts(n=300, seed=5):
    draw = random.Random(seed)
    some = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 40))) for _ in range(n)]
    return [*some, "", None, "x" * 5000, " " * 3000, "ab, " * 4000, some[0], some[0]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None if i % 5 == 0 else f"s{i % 3}", None, "clash", None, "clash", None) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None, None, None, None, None)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


@functools.cache
def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_token_counts_are_the_librarys(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = with_id(token_counts.count_tokens(docs, path))
    for i, text in enumerate(texts()):
        assert found[i].n_tokens == len(library_ids(text)), text
        assert found[i].n_bytes == len((text or "").encode())
    assert token_counts.count_tokens(empty, path).count() == 0


def library_ids(text, name="byte_bpe_50k.json"):
    return library(name).encode(text or "", add_special_tokens=False).ids


def test_transducer_forgets_states_and_still_counts(monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    monkeypatch.setattr(token_counts, "HEAD", 4)
    monkeypatch.setattr(token_counts, "LANES", 32)
    machine = token_counts.Transducer(public_tokenizers.path("byte_bpe_50k.json"), max_states=300)
    data = [(t or "").encode() for t in texts(80)]
    bounds = np.cumsum([0, *map(len, data)])
    counts = token_counts.count_batch(machine, np.frombuffer(b"".join(data), np.uint8), bounds)
    assert counts.tolist() == [len(library_ids(t)) for t in texts(80)]


def test_bpe_round_trip(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = with_id(bpe_words.encode_and_decode(docs, path))
    for i, text in enumerate(texts()):
        ids = library_ids(text)
        assert np.array_equal(np.frombuffer(found[i].ids, "<u4"), ids), i
        assert found[i].decoded == library("byte_bpe_50k.json").decode(ids, skip_special_tokens=False)
    assert bpe_words.encode_and_decode(empty, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files(spark, docs, empty, name):
    folder = scratch_path(spark, "files")
    token_files.write_token_files(docs, public_tokenizers.path(name), folder)
    found = with_id(token_files.read_token_files(spark, folder))
    start = len(library_ids("no id", name)) + 1  # the null id comes first
    for i, text in enumerate(texts()):
        ids = [*library_ids(text, name), 1]
        assert (found[i].start, found[i].n_tokens) == (start, len(ids))
        assert zlib.crc32(found[i].ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    folder = scratch_path(spark, "files")
    token_files.write_token_files(empty, public_tokenizers.path(name), folder)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_variable_length_code():
    values = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7])
    assert token_files.unpack(*token_files.pack(values), len(values)).tolist() == values.tolist()


def test_fingerprints(docs, empty):
    found = with_id(fingerprints.fingerprints(docs))
    all_texts = ["no id", *(t or "" for t in texts())]
    for i, text in enumerate(all_texts):
        if not i:
            continue
        follows, half = all_texts[(i + 1) % len(all_texts)], len(text) // 2
        row = found[i - 1]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256((text[: len(text) - half] + follows[:half]).encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert found[0].fingerprint == found[len(texts()) - 1].fingerprint
    assert fingerprints.fingerprints(empty).count() == 0


def plain_level(window):
    sums = sum(round((1 << 16) * n * math.log2(n)) for n in Counter(window).values())
    most = (1 << 16) * 64 * 6
    return (most - sums) * 1000 // most


def test_rarity_counts_every_window(docs, empty):
    expected = Counter(plain_level(d[i : i + 64]) for d in ((t or "").encode() for t in [*texts(), "no id"]) for i in range(len(d) - 63))
    found = fingerprints.entropy_histogram(docs)
    assert {i: int(n) for i, n in enumerate(found) if n} == expected
    assert not fingerprints.entropy_histogram(empty).any()


def plain_simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, docs, empty):
    found = with_id(simhash.near_duplicates(docs))
    prints = [plain_simhash(t) for t in texts()]
    assert [int(found[i].fingerprint, 16) for i in range(len(prints))] == prints
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    firsts = {r.component_id for r in found.values()}
    assert {r.doc_id for r in kept.collect()} == firsts | {None}


def test_simhash_links_join_what_all_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << i for i in draw.sample(range(64), draw.randint(0, 4))) for b in base for _ in range(60)}
    values = np.array(sorted(prints), np.uint64)
    links = simhash.links(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "print bigint"))
    roots = {r.node: r.root for r in connected(links).collect()}
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values) <= 3)
    expected = forest(len(values), a, b)
    got = [roots.get(int(v), int(v)) for v in values.view(np.int64)]
    assert len(set(zip(got, expected.tolist(), strict=True))) == len(set(got)) == len(set(expected.tolist()))


@pytest.mark.parametrize("crowd", [1 << 16, 500])
def test_simhash_links_of_a_crowded_signature(spark, monkeypatch, crowd):
    """Thousands of fingerprints with one equal half, and others; a quarter shared by many is dealt by signature."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = np.random.default_rng(4)
    upper = draw.integers(0, 1 << 32, 60, np.uint64)  # halves of chains of few changed bits
    chains = [upper]
    for _ in range(12):
        chains.append(chains[-1] ^ (np.uint64(1) << draw.integers(0, 32, 60, np.uint64)) ^ (np.uint64(1) << draw.integers(0, 32, 60, np.uint64)))
    crowd_of = np.concatenate([np.concatenate(chains), draw.integers(0, 1 << 32, 3000, np.uint64)])
    low = np.uint64(0x1234ABCD) ^ (np.uint64(1) << draw.integers(0, 32, len(crowd_of), np.uint64)) * (draw.random(len(crowd_of)) < 0.3).astype(np.uint64)
    other = draw.integers(0, 1 << 64, 2000, np.uint64)
    mixed = np.concatenate([(crowd_of << np.uint64(32)) | low, crowd_of | (low << np.uint64(32)), other, other ^ (np.uint64(0b10001) << draw.integers(0, 59, 2000, np.uint64))])
    values = np.unique(mixed)
    links = simhash.links(spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "print bigint")).collect()
    where = {v: i for i, v in enumerate(values.view(np.int64).tolist())}
    got = forest(len(values), np.array([where[r.a] for r in links]), np.array([where[r.b] for r in links]))
    pairs = [np.nonzero(np.bitwise_count(values[i : i + 200, None] ^ values) <= 3) for i in range(0, len(values), 200)]
    expected = forest(len(values), np.concatenate([i + 200 * k for k, (i, _) in enumerate(pairs)]), np.concatenate([j for _, j in pairs]))
    assert got.tolist() == expected.tolist()


def test_vector_links(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 16))
    x = (centres[draw.integers(0, 40, 400)] + 0.12 * draw.normal(size=(400, 16))).astype(np.float32)
    x[7] = x[3]
    rows = [(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None], 1), (1004, rows[0][1], None), (None, rows[0][1], 0)]
    found = vector_links.link_vectors(spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<float>, label int")).collect()
    by_id = {r.vec_id: r for r in found}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    label = np.arange(400) % 3
    linked = (u @ u.T >= 0.93) & (label[:, None] == label) & ~np.eye(400, dtype=bool)
    assert [by_id[i].n_links for i in range(400)] == linked.sum(1).tolist()
    assert [by_id[i].component_id for i in range(400)] == forest(400, *np.nonzero(linked)).tolist()
    assert all(by_id[i].n_links == 0 and by_id[i].component_id == i and by_id[i].kept for i in range(1000, 1005))
    assert vector_links.link_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def plain_links(rows, least=0.93):
    """(id, n_links, component, kept) of each row by comparing all rows with all."""
    sound = [i is not None and lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    at = [i for i, ok in enumerate(sound) if ok]
    linked = np.zeros((len(rows), len(rows)), bool)
    for kind in {(rows[i][2], len(rows[i][1])) for i in at}:
        own = [i for i in at if (rows[i][2], len(rows[i][1])) == kind]
        x = np.array([rows[i][1] for i in own], float)
        u = x / np.linalg.norm(x, axis=1)[:, None]
        linked[np.ix_(own, own)] = u @ u.T >= least
    np.fill_diagonal(linked, False)
    root = forest(len(rows), *np.nonzero(linked))
    groups = {}
    for i, r in enumerate(root.tolist()):
        groups.setdefault(r, []).append(rows[i][0])
    for i, (key, _, _) in enumerate(rows):
        component = min((k for k in groups[int(root[i])] if k is not None), default=None)
        yield key, int(linked[i].sum()), component, key is not None and key == component


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("dimensions", [3, 64])
def test_vector_links_over_many_lists(spark, monkeypatch, dimensions, kind):
    """Vectors on a space of few dimensions, in many lists and blocks, two lengths, copies, a hot label, clashing columns."""
    monkeypatch.setattr(vector_links, "LIST", 40)
    monkeypatch.setattr(vector_links, "BLOCK", 100)
    draw = np.random.default_rng(dimensions)
    base = draw.normal(size=(1500, dimensions)) @ draw.normal(size=(dimensions, 64))
    if dimensions == 64:
        base = base[draw.integers(0, 150, 1500)] + 1.5 * draw.normal(size=(1500, 64))
    base[40:60] = base[40]
    base = base.astype(np.float32)
    short = draw.normal(size=(60, 2)).astype(np.float32)
    values = [[float(x) for x in v] for v in (*base, *short)]
    rows = [(i, v, 0 if i % 3 else int(i % 9)) for i, v in enumerate(values)]
    rows += [(5000, None, 1), (5001, [0.0] * 64, 0), (5002, [float("inf")] * 2, 0), (5003, values[3], None), (None, values[3], 0), (5004, [], 0)]
    table = spark.createDataFrame([(*r, "clash", 1, None) for r in rows], f"vec_id bigint, embedding array<{kind}>, label int, list string, class int, key string").repartition(3)
    found = vector_links.link_vectors(table).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(plain_links(rows), key=repr)


def test_vector_links_in_double_precision(spark):
    """Two vectors whose cosine lies above the limit, by less than single precision tells."""
    angle = math.acos(0.93) - 1e-12
    rows = [(1, [1.0, 0.0], 1), (2, [math.cos(angle), math.sin(angle)], 1), (3, [math.cos(-angle - 2e-12), math.sin(-angle - 2e-12)], 1)]
    found = {r.vec_id: r.n_links for r in vector_links.link_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")).collect()}
    assert found == {1: 1, 2: 1, 3: 0}


def test_vector_links_of_equal_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.02], 1), (3, [0.0, 1.0], 1)]
    found = Counter(tuple(r) for r in vector_links.link_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")).collect())
    assert {(k[0], k[2], k[3]) for k in found} == {(1, 1, True), (2, 1, False), (3, 3, True)} and sum(found.values()) == 5


def test_shards(spark, docs, empty):
    out = shards.balanced_shards(docs, shards=7).collect()
    by_shard = {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r.slot)
    sizes = [len(s) for s in by_shard.values()]
    assert len(by_shard) == 7 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    found = {r.doc_id: r for r in out}
    assert all(found[i].text_crc32 == zlib.crc32((t or "").encode()) and found[i].size == len((t or "").encode()) + 8 for i, t in enumerate(texts()))
    n = len(texts())
    assert found[0].shard == found[n - 1].shard == found[n - 2].shard  # equal texts
    assert shards.balanced_shards(empty).count() == 0


def test_one_text_larger_than_a_shard(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, "same").otherwise(F.col("id").cast("string")).alias("text"))
    counts = {r.shard: r["count"] for r in shards.balanced_shards(rows, shards=9).groupBy("shard").count().collect()}
    assert sorted(counts.values()) == [111] * 8 + [112]


def test_texts_gather_in_full_shards(spark):
    for copies in (2, 40):  # no document without a copy, so that no shard has room
        rows = spark.range(2400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % (2400 // copies)).alias("text"))
        out = shards.balanced_shards(rows, shards=6).groupBy("text_crc32").agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("n")).collect()
        assert {r.n for r in out} == {copies}
        assert sum(r.shards == 1 for r in out) >= (0.8 if copies == 2 else 0.5) * len(out)  # groups of 40 hardly fit whole


def test_granted_moves_keep_loads():
    draw = random.Random(6)
    for _ in range(50):
        room = [draw.choice([0, 0, 5]) for _ in range(6)]
        wishes = {(a, b): draw.randint(1, 9) for a in range(6) for b in range(6) if a != b and draw.random() < 0.3}
        granted = shards.circulation(wishes, room)
        assert all(0 < n <= wishes[w] for w, n in granted.items())
        for s in range(6):
            assert sum(n for (_, b), n in granted.items() if b == s) - sum(n for (a, _), n in granted.items() if a == s) <= room[s]
    assert shards.circulation({(0, 1): 3, (1, 2): 2, (2, 0): 4, (0, 2): 1}, [0, 0, 0]) == {(0, 1): 2, (1, 2): 2, (2, 0): 3, (0, 2): 1}


def test_curriculum(spark, docs, empty):
    rows = curriculum.plan(docs, carry=["doc_id", "source"]).select("row.*", "size", "source_size", "target", "taken", "places").collect()
    total = sum(r["size"] for r in rows)
    order = sorted({r.source for r in rows if r.source}) + [None]
    target, weight, open_ = {}, dict(zip(order, itertools.cycle((3, 1, 2)), strict=False)), set(order)
    cap = {s: 2 * sum(r["size"] for r in rows if r.source == s) for s in order}
    while True:
        left = 1.5 * total - sum(target[s] for s in order if s not in open_)
        target |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if target[s] > cap[s]}
        if not over:
            break
        target |= {s: cap[s] for s in over}
        open_ -= over
    for s in order:
        own = [r for r in rows if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size * 2 == cap[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r["size"] for r in own) / 2
        assert all(r.taken <= 2 * r["size"] and all(0 <= p <= 1 for p in r.places) for r in own)
    mixed = curriculum.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r.places) for r in rows)
    assert curriculum.mixed(empty).count() == 0


def test_what_is_taken_follows_the_schedule(spark, docs):
    """The tilt, which only the schedule reads, belongs to the plan of the columns that op8 returns."""
    taken = curriculum.plan(docs, carry=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")
    assert "SQRT" in taken._jdf.queryExecution().optimizedPlan().toString().upper()


def test_the_query_mixes_by_the_schedule(spark, tmp_path):
    """op8 returns documents as training meets them, so what it returns follows the schedule's tilts as well."""
    draw = random.Random(8)
    rows = [(i, " ".join(["w"] * draw.randint(1, 30)), draw.choice(["a", "b", "c", None])) for i in range(400)]
    rows += [(400, None, "a"), (401, "", "b"), (None, "w w", "c"), (7, *rows[7][1:])]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op8_curriculum_mix"](spark, str(tmp_path)).collect()
    planned = curriculum.plan(docs).select("row.doc_id", "size", "source_size", "target", "taken", "places").collect()
    assert sorted(map(str, found)) == sorted(str(Row(**{c: r[c] for c in found[0].asDict()})) for r in planned)
    first = {r.doc_id: min(r.places) for r in planned if r.places and r.doc_id != 7}
    met = [r.doc_id for r in found if r.doc_id in first]
    assert [first[i] for i in met] == sorted(first.values())
    taken = [r.doc_id in first or r.taken > 0 for r in found]
    assert taken == sorted(taken, reverse=True) and not all(taken)
    mixed = list(dict.fromkeys(r.doc_id for r in curriculum.mixed(docs).collect() if r.doc_id in first))
    assert [first[i] for i in mixed] == [first[i] for i in met]


def test_reruns_take_the_same_rows_of_equal_ids(spark, monkeypatch):
    rows = [(7, f"{w} b c", "s") for w in "nopqrstuvwxyz"] + [(8, "one two", "t"), (8, None, "t")]
    schema = "doc_id bigint, text string, source string"

    def taken(parts, seed):
        draw = random.Random(seed)
        df = spark.createDataFrame(draw.sample(rows, len(rows)), schema).repartition(parts)
        return sorted(((r.text or ""), r.taken, tuple(r.places)) for r in curriculum.plan(df).select("row.text", "taken", "places").collect())

    first = taken(1, 0)
    assert len({t for _, t, _ in first}) > 1 and all(taken(p, s) == first for p, s in ((3, 1), (5, 2)))
    monkeypatch.setattr(curriculum, "small", lambda sized: False)
    assert taken(2, 3) == first


def test_quality_on_held_out_documents(spark):
    draw = random.Random(4)
    neutral = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(900):
        words = [draw.choice(neutral) for _ in range(draw.randint(5, 80))]
        grade = draw.choice([0, 1, 2, 2])
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        if grade == 1:
            words[draw.randrange(len(words))] = draw.choice(["vile", "viler", "nasty"])
        rows.append((i, " ".join(words), grade))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    model = quality.fit(df, df.where("doc_id < 600").select(F.col("doc_id").alias("id"), "grade"), grades=3)
    assert model.thresholds[0] <= model.thresholds[1]
    held = quality.rate(df.where("doc_id >= 600"), model).join(df, "doc_id").collect()
    assert np.mean([r.kept == (r.grade == 2) for r in held]) > 0.95
    assert quality.keep_good(df, model).columns == df.columns


def test_quality_edges(docs, empty):
    model = quality.fit(empty, empty.selectExpr("doc_id as id", "1 as grade"), grades=3)
    assert quality.rate(docs, model).where("kept").count() == docs.count()
    assert quality.keep_good(empty, model).count() == 0


def test_cut_is_least(spark):
    draw = random.Random(3)
    for _ in range(100):
        n = draw.randint(1, 8)
        odds = [draw.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): draw.uniform(0, 3) for i in range(n) for j in range(i + 1, n) if draw.random() < 0.5}

        def cost(labels, odds=odds, edges=edges):
            return sum(-o for o, x in zip(odds, labels, strict=True) if x) + sum(w for (a, b), w in edges.items() if labels[a] != labels[b])

        assert abs(cost(extraction.cut(odds, edges)) - min(cost(x) for x in itertools.product([False, True], repeat=n))) < 1e-9


def test_extraction(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
    <div id="cookie-notice"><p>We use cookies on this site, and hope that you accept them all.</p></div>
    <article><h1>A &amp; B</h1><p><b>Some text,<br>with a break.<p>And\n more &eacute;.</article>
    <div class="comments"><p>This comment is by a reader, who has a lot to say about the matter at hand.</p></div><footer>&copy; x</footer>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (1, "u", page)]
    found = extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    expected = "A & B\n\nSome text, with a break.\n\nAnd more é."
    assert [r.text for r in found] == [expected, "", "", expected, expected]
    assert all(r.n_chars == len(r.text) for r in found)
    assert extraction.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("<div class='layout has-sidebar'><article>", "</article></div>"),
        ("<div class='page with-social'><article>", "</article></div>"),
        ("<div class='sidebar'><article>", "</article></div>"),
        ("<article class='post comments-open'>", "</article>"),
        ("<form action='p.aspx'><main>", "</main></form>"),
        ("<article><section id='related-work'>", "</section></article>"),
    ],
)
def test_names_on_what_holds_the_article(before, after):
    text = "This sentence is a part of the article, and it says what there is to say."
    own = f"<h2 id='login-and-search'>Heading</h2><p>{text}</p><p class='notice'>{text}</p><p>{text}</p>"
    rest = "<div class='comments'><p>This comment is by a reader, who has a lot to say.</p></div><div class='sidebar'><p>More to read on this site.</p></div>"
    expected = "\n\n".join(["Heading", text, text, text])
    assert extraction.main_text(f"<body>{before}{own}{after}{rest}</body>") == expected
    assert extraction.main_text(f"<body>{before}{own}{rest}{after}</body>") == expected
