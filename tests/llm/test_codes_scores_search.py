"""Vector codes, language-model scores and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from solvane.llm import codebooks, lexical, scoring
from solvane.llm.bilinear import Bilinear, Trainer, contexts
from solvane.llm.treaps import Best, Treap, search

# Vector codes -----------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, label string, code string, entry int, `a b` int"


def vector_rows(n=700, width=8, seed=3):
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(0, 1) for _ in range(width)], draw.choice(["x", "y", None]), "clash", 1, 2) for i in range(n)]
    rows += [(n + i, [0.25] * width, "x", None, None, None) for i in range(400)]  # a third of all rows are one vector
    rows += [(3, rows[3][1], "x", None, None, None)] * 2 + [(None, [1.0] * width, "y", None, None, None)]
    bad = [None, [], [1.0] * (width - 1) + [None], [float("nan")] * width, [float("inf")] + [0.0] * (width - 1)]
    rows += [(2000 + i, v, "x", None, None, None) for i, v in enumerate(bad) if v != []]
    draw.shuffle(rows)
    return rows


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    whole = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    own = len(whole[0]) // parts
    cut = [[w[p * own : (p + 1) * own] for w in whole] for p in range(parts)]
    books = [[list(m) for m in c[:entries]] for c in cut]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((far(m, e), k) for k, e in enumerate(book)) for m in c] for c, book in zip(cut, books, strict=True)]

    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                members = [m for m, (_, e) in zip(cut[p], chosen[p], strict=True) if e == k]
                if members:
                    books[p][k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    chosen = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(chosen[p][i][0] for p in range(parts)) for i in range(len(kept))]
    by_label = Counter()
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] += e
    return [(r[0], "".join(f"{chosen[p][i][1]:02x}" for p in range(parts)), errors[i], by_label[r[2]], sha) for i, r in enumerate(kept)]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_vector_codes_are_those_of_plain_rounds(spark):
    rows = vector_rows()
    found = codebooks.code_vectors(spark.createDataFrame(rows, VECTORS).repartition(7), entries=40).collect()
    assert order(found) == order(plain_codes(rows, entries=40))


def test_vector_codes_of_few_rows_and_of_none(spark):
    rows = vector_rows()[:5]
    assert order(codebooks.code_vectors(spark.createDataFrame(rows, VECTORS)).collect()) == order(plain_codes(rows))
    empty = codebooks.code_vectors(spark.createDataFrame([], VECTORS))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0


def test_vectors_of_another_length_have_no_code(spark):
    rows = [(1, [1.0] * 8, "x"), (2, [1.0] * 4, "x"), (3, [], "x")]
    found = {r.vec_id: r for r in codebooks.code_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<float>, label string")).collect()}
    assert found[1].code == "00000000" and found[1].error == 0
    assert found[2].code is None and found[2].error is None and found[3].code is None
    with pytest.raises(Exception, match="can't be coded"):
        codebooks.code_vectors(spark.createDataFrame([(1, [1e9] * 4, "x")], "vec_id int, embedding array<double>, label string")).collect()


def test_only_members_that_change_their_entry_move(spark, monkeypatch):
    moved = []
    choose = codebooks.choose

    def counted(members, books):
        chosen = choose(members, books)
        moved.append((chosen.where("moved").count(), chosen.count()))
        return chosen

    monkeypatch.setattr(codebooks, "choose", counted)
    codebooks.code_vectors(spark.createDataFrame(vector_rows(), VECTORS), entries=40).collect()
    assert moved[0][0] == moved[0][1] and all(m < n / 2 for m, n in moved[1:])


def test_nearest_is_exact_beyond_doubles():
    members, entries = np.array([[1 << 27, -(1 << 27)]] * 2), np.array([[(1 << 27) - 1, 0], [(1 << 27) - 3, 0], [1 << 27, 0]])
    own, error = codebooks.nearest(members, entries)
    assert own.tolist() == [2, 2] and error.tolist() == [1 << 54] * 2


# Ranked search ----------------------------------------------------------------

TEXTS = "doc_id bigint, text string, item string, rank string, score string, `a b` int"


def plain_search(docs, items, most=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [term.findall((d[1] or "").translate(small)) for d in docs]
    n, total = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(term.findall((text or "").translate(small)))
    out = []
    for i, words in asked.items():
        scored = []
        for d, t in zip(docs, terms, strict=True):
            tf = Counter(t)
            m = 10 + (90 * len(t) * n) // total if t else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in words if tf[w])
            if score > 0:
                scored.append((-score, d[0] is None, d[0] or 0))
        out += [(i, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scored)[:most], 1)]
    return out


def search_rows(n=400, seed=11):
    draw = random.Random(seed)
    words = [f"w{int(draw.expovariate(0.03))}" for _ in range(300)] + ["Äpfel", "äpfel", "漢字", "x_y", "A1", "a1", "tab\tnew\x0bline", "🙂"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(0, 30)))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(60)] + [(7, docs[7][1]), (None, docs[8][1]), (n + 70, None), (n + 71, ""), (n + 72, "... !!"), (n + 73, "w1 " * 30000)]
    draw.shuffle(docs)
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 12)))) for i in range(30)]
    items += [(40, docs[5][1]), (41, None), (42, "!"), (43, "nowhere"), (None, "w1 w2"), (3, "w3 w5"), (3, "w3 w5")]
    return docs, items


@pytest.mark.parametrize("size", [4 << 20, 700])
def test_ranked_search_is_that_of_plain_scores(spark, monkeypatch, size):
    monkeypatch.setattr(lexical, "GRID_BYTES", size)
    monkeypatch.setattr(lexical, "ITEMS", 7)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 4 << 20 if size > 1000 else 500)
    docs, items = search_rows()
    table = spark.createDataFrame([(*d, "clash", "clash", "clash", 1) for d in docs], TEXTS).repartition(3)
    found = lexical.search(lexical.build_index(table), spark.createDataFrame([(*i, 5) for i in items], "item_id bigint, text string, doc_id int"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert order(found.collect()) == order(plain_search(docs, items))


def test_ranked_search_of_nothing(spark):
    docs, items = search_rows(20)
    no_docs, no_items = spark.createDataFrame([], TEXTS), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(*d, None, None, None, None) for d in docs], TEXTS)
    assert lexical.search(lexical.build_index(no_docs), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert lexical.search(lexical.build_index(some), no_items).count() == 0


@pytest.mark.parametrize("documents", [1, 16, 17, 1000])
def test_treap_bounds_and_results(documents):
    draw = np.random.default_rng(documents)
    cells = np.unique(np.stack([draw.integers(0, 90, 4000), draw.integers(0, documents, 4000)]), axis=1)
    impacts = draw.integers(1, 50, cells.shape[1])
    treap = Treap.build(cells[0], cells[1], impacts, documents)
    assert max(m.max() for m in treap.maxima) == treap.maxima[0].max() == impacts.max()
    dense = np.zeros((100, documents), np.int64)
    dense[cells[0], cells[1]] = impacts
    item = np.repeat(np.arange(20), 5)
    row, weight = draw.integers(0, 100, 100), draw.integers(0, 9, 100)
    best = Best(20, 3)
    search(treap, item, row, weight, np.arange(documents) * 2, np.zeros(documents, bool), best)
    found = sorted(zip(best.item.tolist(), (-best.score).tolist(), best.doc.tolist(), strict=True))
    wanted = []
    for i in range(20):
        scores = (dense[row[item == i]] * weight[item == i][:, None]).sum(axis=0)
        wanted += sorted((i, -int(s), 2 * d) for d, s in enumerate(scores) if s > 0)[:3]
    assert found == wanted


def test_search_leaves_out_what_cannot_win(monkeypatch):
    """With one range at a time the best comes first, and ranges below the bar are not scored."""
    from solvane.llm import treaps

    monkeypatch.setattr(treaps, "AT_ONCE", 1)
    scored = []
    score = treaps._score
    monkeypatch.setattr(treaps, "_score", lambda treap, some, *rest: (scored.append(len(some)), score(treap, some, *rest)))
    impacts = np.arange(1, 1601)
    treap = Treap.build(np.zeros(1600, int), np.arange(1600), impacts, 1600)
    best = Best(1, 3)
    search(treap, np.zeros(1, int), np.zeros(1, int), np.ones(1, int), np.arange(1600), np.zeros(1600, bool), best)
    assert best.doc.tolist() == [1599, 1598, 1597] and sum(scored) == 1


# Language-model scores --------------------------------------------------------

SCORED = "doc_id bigint, text string, words string, held string, score string, `a b` int"


def scored_rows(n=300, seed=2):
    draw = random.Random(seed)
    pair = {f"a{i}": f"b{i}" for i in range(20)}  # the next word is told by the one before
    rows = [(i, " ".join(f"{a}\t{pair[a]}" for a in draw.choices(list(pair), k=draw.randint(0, 40)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\x0b"), (n + 3, "A1 É é unmet"), (n + 4, "a1 b1 " * 20000), (5, rows[5][1]), (None, "a1 b1"), (n + 6, "x\x1cy z")]
    return rows


@pytest.mark.parametrize("parcel", [8 << 20, 300])
def test_scores_count_as_a_plain_version_does(spark, monkeypatch, parcel):
    monkeypatch.setattr(scoring, "PARCEL", parcel)
    monkeypatch.setattr(scoring, "PACK", 50)
    rows = scored_rows()
    table = spark.createDataFrame([(*r, "clash", "clash", "clash", 1) for r in rows], SCORED).repartition(3)
    found = scoring.score_texts(table, single=30)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    tokens = [[w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if w] + [None] for _, t in rows]
    out = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for t, h in zip(tokens, out, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    wanted = [(i, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, _), t, h in zip(rows, tokens, out, strict=True)]
    got = found.collect()
    assert order((*r[:5], round(r.base_score, 6)) for r in got) == order(wanted)
    held = [r for r in got if r.held_out and r.n_known == r.n_tokens]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)  # closer to zero by a fifth: pairs are learned
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_parcels_go_to_python_one_at_a_time(spark, monkeypatch):
    """A parcel takes megabytes: it is one row of a batch and one page of its table, however many there are, and the session keeps its settings."""
    sent, read = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before, met, stage = (spark.conf.get(sent), spark.conf.get(read)), {}, scoring.stage

    def staged(df, name, **options):
        out = stage(df, name, **options)
        met[name] = (spark.conf.get(sent), spark.conf.get(read), [pq.ParquetFile(f.removeprefix("file:")).metadata for f in out.inputFiles()])
        return out

    monkeypatch.setattr(scoring, "PARCEL", 300)
    monkeypatch.setattr(scoring, "stage", staged)
    rows = [(i, " ".join(f"w{i % 7}{j}" for j in range(60))) for i in range(80)]
    assert scoring.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).count() == 80
    assert met["coded"][:2] == met["scores"][:2] == ("1", "1") and met["counted"][1] == "1" and int(met["parcels"][0]) < 10000
    assert (spark.conf.get(sent), spark.conf.get(read)) == before
    for name in ("parcels", "coded"):
        assert sum(m.num_rows for m in met[name][2]) > 20
        assert {m.row_group(0).column(0).compression for m in met[name][2] if m.num_rows} == {"ZSTD"}


def test_scores_of_nothing_and_without_training(spark):
    assert scoring.score_texts(spark.createDataFrame([], SCORED)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = scoring.score_texts(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert abs(row.score) < 1e-6


def test_probabilities_add_up_to_one(spark):
    counts = {"": 50, "the": 40, "of": 9, "a": 8, "b": 5, "c": 1, "d": 1, "e": 2, "f": 3}
    half = [w for w, c in counts.items() for _ in range(c // 2)]  # the words of one parcel, and those of the other
    other = list((Counter(counts) - Counter(half)).elements())
    rows = [(p, list(Counter(x)), list(Counter(x).values())) for p, x in enumerate((half, other))]
    parcels = spark.createDataFrame(rows, "parcel bigint, words array<string>, own array<int>")
    classes = scoring.classes_of(scoring.count_words(parcels, 3), single=3)
    assert classes.place == {"": 0, "the": 1, "of": 2} and (classes.tokens, classes.words) == (sum(counts.values()), len(counts))
    words = [*counts, "never met"]
    of, share = classes.of(pa.array(words), np.array([*counts.values(), 0]))
    model = Bilinear(classes.frequency)
    k = len(classes.frequency)
    draw = np.random.default_rng(1)
    Trainer(model, 1).train(*(draw.integers(0, k, 500) for _ in range(3)))
    by_last, by_before = model.tables()
    sums = model.normaliser(np.arange(k + 1))
    for last in range(k + 1):
        for before in range(k + 1):
            chances = np.exp(by_last[last, of].astype(float) + by_before[before, of] - sums[last, before]) * 10**share
            assert abs(chances.sum() - 1) < 1e-4


def test_contexts_begin_anew_with_each_text():
    last, before = contexts(np.array([1, 2, 3, 4, 5, 6]), np.array([3, 1, 2]), 9)
    assert last.tolist() == [9, 1, 2, 9, 9, 5] and before.tolist() == [9, 9, 1, 9, 9, 9]


def test_noise_contrastive_steps_follow_the_gradient():
    """A step's change of every number has the sign of what a small change of it does to the objective."""
    model = Bilinear(np.array([4.0, 3.0, 2.0, 1.0]))
    draw = np.random.default_rng(0)
    model.target = draw.normal(0, 0.5, model.target.shape).astype(np.float32)
    target, last, before = (draw.integers(0, 4, 30) for _ in range(3))
    trainer = Trainer(model, 5)
    noise = np.minimum(np.searchsorted(trainer.steps, np.random.default_rng(5).random(64), side="right"), 3)

    def loss(flat):
        m = Bilinear(model.noise).load(flat)
        hidden = m.context[last].astype(float) @ m.first + m.context[before].astype(float) @ m.second
        real = (hidden * m.target[target]).sum(axis=1) + m.bias[target] - trainer.offset[target]
        false = hidden @ m.target[noise].T + m.bias[noise] - trainer.offset[noise]
        return (np.log1p(np.exp(-real)).sum() + np.log1p(np.exp(false)).sum()) / 30

    old = model.flat().astype(float)
    trainer.step(target, last, before)
    change = model.flat() - old
    strong = 0
    for i in draw.choice(len(old), 300, replace=False):
        up, down = old.copy(), old.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        slope = (loss(up) - loss(down)) / 2e-2
        if abs(slope) > 1e-2:
            strong += 1
            assert np.sign(change[i]) == -np.sign(slope)
    assert strong > 20


def test_a_task_of_the_search_gets_one_grid_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GRID_DOCUMENTS", 2)
    docs = spark.createDataFrame([(i, f"word{i} other") for i in range(12)], "doc_id bigint, text string").coalesce(1)
    index = lexical.build_index(docs)

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_pydict({"n": [len(part)]})

    assert [r.n for r in index.one_by_one().mapInArrow(sizes, "n bigint").collect()] == [1] * 6
    items = spark.createDataFrame([(1, "word7")], "item_id bigint, text string")
    assert [(r.rank, r.doc_id) for r in lexical.search(index, items).collect()] == [(1, 7)]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "1"
