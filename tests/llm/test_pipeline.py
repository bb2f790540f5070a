"""The corpus pipeline against a plain version of its stages, and its stages on odd tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from solvane.llm import queries, quality
from tests.llm.test_operators import plain_simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n=400, seed=9):
    draw = random.Random(seed)
    words = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 7))) for _ in range(150)]
    rows, labels = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(draw.randint(1, 60))]
        good = draw.random() < 0.7
        if not good:
            text = [w.upper() + "!!" for w in text]
        rows.append([i, " ".join(text), "en", draw.choice(["a", "b", "c", None]), None])
        labels.append((i, int(good), int(good and draw.random() < 0.1)))
        if labels[-1][2]:
            rows[-1][1] += " vile nasty"
    for i in range(n, n + 120):  # near and exact copies
        text = rows[draw.randrange(n)][1].split(" ")
        if draw.random() < 0.5:
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append([i, " ".join(text), "en", draw.choice(["a", "b"]), None])
    rows += [[n + 200, None, None, None, None], [n + 201, "", None, "a", None], [n + 202, "word " * 50000, None, "b", None]]
    return rows, [r for r in labels if r[0] % 3]


def plain_rating(model, text):
    """P(highest grade), feature by feature."""
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", text or "") if w]
    total = 0.0
    for w in words:
        core = w.lower().strip(quality.EDGE)
        case = "a" if w.islower() else "A" if w.isupper() and len(w) > 1 else "Aa"
        names = [(f"{case} " + regex.sub(r"[\pL\pN_]+", "w", w)[:16], 0)] + [(core, 1)] * bool(core) + [(core[:k], k) for k in (4, 5, 6) if len(core) > k]
        total += sum(model.weights[xxhash.xxh64_intdigest(name, seed) % quality.WIDTH] for name, seed in names)
    total += sum(a == b for a, b in zip(words, words[1:], strict=False)) * model.weights[quality.REPEATED]
    score = total / max(1, len(words)) ** quality.ROOT
    return 1 - 1 / (1 + np.exp(-np.clip(model.thresholds[-1] - score, -500, 500)))


def plain_first(rows):
    """One row for each group of fingerprints that chains of three bits or fewer join."""
    prints = [plain_simhash(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        before = list(root)
        for i, x in enumerate(prints):
            root[i] = min(root[j] for j, y in enumerate(prints) if (x ^ y).bit_count() <= 3)
        if root == before:
            break
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(rows[i][0])
    firsts = {min(ids) for ids in groups.values()}
    return [r for r in rows if r[0] in firsts]


def plain_mix(rows):
    size = {r[0]: len([w for w in regex.split(r"[\x20\x09-\x0D]+", r[1] or "") if w]) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(own.values()), list(sources)
    while open_:  # whoever would get more than twice its size stops there
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * own[s] < level * weight[s]]
        for s in full or open_:
            target[s] = 2 * own[s] if full else level * weight[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    out = []
    for s in sources:
        before = 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16), size[r[0]])):
            out += [r] * sum(before + size[r[0]] / 2 + e * own[s] < target[s] for e in (0, 1))
            before += size[r[0]]
    return out


def plain_codes(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        yield r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_pipeline_is_its_plain_stages(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    model = queries.quality_model(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    good = [r for r in rows if plain_rating(model, r[1]) >= 0.5]
    single = plain_first(good)
    mixed = plain_mix(single)
    assert len(rows) > len(good) > len(single) and max(Counter(r[0] for r in mixed).values()) == 2
    assert found == Counter(plain_codes(mixed))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, tmp_path, stage):
    """Nulls in any column, repeated rows, clashing names and no rows at all; all but the last stage return the columns."""
    name, function = stage
    schema = SCHEMA + ", n_tokens string, kept string, row string, words string, `my col` int, place int"
    rows = [(1, "some words here", None, None, None, "x", None, "y", None, 1, 2)] * 3
    rows += [(None, "no id at all", None, "a", None, None, None, None, None, None, None), (2, None, None, "a", None, None, None, None, None, None, None), (3, "", None, None, 0, None, None, None, None, None, None)]
    spark.createDataFrame([(1, 1, None), (None, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    out = function(spark, docs, str(tmp_path))
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or out.columns == docs.columns
    found = Counter(r[0] for r in out.collect())
    expected = {"SimHash near-dedup": {1: 1, None: 1, 2: 1}, "mixing sources to target weights": None}
    if name != "mixing sources to target weights":
        assert found == expected.get(name, {1: 3, None: 1, 2: 1, 3: 1})
    assert set(found) <= {1, None, 2, 3}
    assert function(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_gradient_is_that_of_the_likelihood():
    draw = np.random.default_rng(3)
    grade, told = draw.integers(0, 3, 40), draw.integers(0, 5, 40)
    columns, x = draw.integers(0, 12, told.sum()), draw.normal(size=told.sum())
    ends, w, t = np.append(0, np.cumsum(told)), draw.normal(size=12), np.array([-0.3, 0.8])

    def loss(w, t):
        out = 0.0
        for i in range(40):
            q = sum(x[j] * w[columns[j]] for j in range(ends[i], ends[i + 1]))
            below = [0.0, *(1 / (1 + np.exp(q - k)) for k in t), 1.0]
            out -= np.log(below[grade[i] + 1] - below[grade[i]])
        return out / 40 + quality.RIDGE / 2 * (w**2).sum()

    to_w, to_t = quality.gradient(grade, told, ends, columns, x, w, t)
    for i in range(12):
        step = 1e-5 * np.eye(12)[i]
        assert abs((loss(w + step, t) - loss(w - step, t)) / 2e-5 - to_w[i]) < 1e-6
    for i in range(2):
        step = 1e-5 * np.eye(2)[i]
        assert abs((loss(w, t + step) - loss(w, t - step)) / 2e-5 - to_t[i]) < 1e-6


def test_long_documents_and_equal_ids_take_part_in_the_fit(spark):
    """Half of the good documents are longer than 200,000 characters, and only they hold the word that tells."""
    rows = [(i, ("calm " if i % 2 else "plain ") * (50_000 if i % 4 == 1 else 40), 2 if i % 2 else 0) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1, rows[1][1])] * 3, "doc_id bigint, text string")
    ratings = spark.createDataFrame([(r[0], r[2]) for r in rows if r[2] == 0 or r[0] % 4 == 1], "id bigint, grade int")
    model = quality.fit(docs, ratings, grades=3)
    kept = {r.doc_id for r in quality.rate(docs, model).where("kept").collect()}
    assert kept == {i for i in range(120) if i % 2}


def test_document_features_are_those_of_its_words():
    words = ["The", "END.", "the", "the", "internationale", "x"]
    ((columns, counts),) = list(quality.document_features(pa.array([words])))
    names = Counter()
    for w in words:
        core = w.lower().strip(quality.EDGE)
        names[xxhash.xxh64_intdigest(core, 1) % quality.WIDTH] += 1
    found = dict(zip(columns.tolist(), counts.tolist(), strict=True))
    assert all(abs(found[c] - n / len(words) ** quality.ROOT) < 1e-6 for c, n in names.items())
    assert abs(found[quality.REPEATED] - 1 / len(words) ** quality.ROOT) < 1e-6
