"""Document quality by ordinal regression with cumulative links.

A document's latent quality is one weighted sum of hashed word features, with the same weights at every threshold:
P(grade <= k) = sigmoid(threshold_k - quality). Features are words, their beginnings, their shapes, and repetition of
the word before. A feature enters with its log-ratio between good and other documents, shrunk towards zero by three
standard errors, so that words that say nothing do not add up in long texts; a document's sum is divided by a root of
its number of words. Weights and ordered thresholds are fitted on a bounded sample of rated documents.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from solvane.llm.words import offsets_of, parcels, starts_of
from solvane.storage import stage

SAMPLE = 8_000  # rated documents at most that the fit uses
WIDTH = 1 << 18  # hashed features
ERRORS = 3.0  # standard errors by which log-ratios are shrunk
ROOT = 0.25  # power of the number of words that divides a document's sum
ROUNDS = 500
RIDGE = 1e-5
PARCEL = 8 << 20
SLICE = 1 << 15  # words whose features are worked out at once
EDGE = ".,;:!?*#$%&|()[]{}\"'«»…-"
REPEATED = xxhash.xxh64_intdigest("repeated") % WIDTH


def hashed(names: pa.Array, seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, names.to_pylist(), repeat(seed)), np.uint64, len(names)).astype(np.int64) & (WIDTH - 1)


def hashed_once(names: pa.Array, seed: int) -> np.ndarray:
    """For names of which many are equal."""
    names = names.dictionary_encode()
    return hashed(names.dictionary, seed)[names.indices.to_numpy(zero_copy_only=False)]


def word_features(words: pa.Array) -> np.ndarray:
    """The features of all words, worked out for some at a time."""
    return np.concatenate([features_of(words.slice(i, SLICE)) for i in range(0, max(len(words), 1), SLICE)])


def features_of(words: pa.Array) -> np.ndarray:
    """A row for each word: its shape, itself, its first four, five and six letters; -1 where it has no such feature."""
    core = pc.utf8_trim(pc.utf8_lower(words), characters=EDGE)
    length = pc.utf8_length(core).to_numpy(zero_copy_only=False)
    upper = pc.and_(pc.utf8_is_upper(words), pc.greater(pc.utf8_length(words), 1))
    case = pc.if_else(pc.utf8_is_lower(words), "a", pc.if_else(upper, "A", "Aa"))
    shape = pc.utf8_slice_codeunits(pc.replace_substring_regex(words, r"[\pL\pN_]+", "w"), 0, 16)
    columns = [hashed_once(pc.binary_join_element_wise(case, shape, " "), 0), np.where(length > 0, hashed(core, 1), -1)]
    columns += [np.where(length > k, hashed_once(pc.utf8_slice_codeunits(core, 0, k), k), -1) for k in (4, 5, 6)]
    return np.stack(columns, axis=1).astype(np.int32)


def words_of(text) -> object:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def batch_words(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in a row, and where each document's begin."""
    words = pc.dictionary_encode(lists.flatten())
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False), offsets_of(lists)


def repeats(places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each document how often a word is followed by itself."""
    same = np.zeros(len(places) + 1, np.int64)
    if len(places):
        again = places[1:] == places[:-1]
        again[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(places))] - 1] = False
        same[2:] = np.cumsum(again)
    return same[bounds[1:]] - same[np.minimum(bounds[:-1] + 1, bounds[1:])]


def document_features(lists: pa.ListArray):
    """For each document its features and, of each, the count over a root of the number of words."""
    distinct, places, bounds = batch_words(lists)
    features = word_features(distinct)
    starts, flat = starts_of((features >= 0).sum(axis=1)), features[features >= 0]
    again = repeats(places, bounds)
    for i in range(len(lists)):
        own, n = np.unique(places[bounds[i] : bounds[i + 1]], return_counts=True)
        sizes = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        column, where = np.unique(np.append(flat[at], [REPEATED] * bool(again[i])).astype(np.int64), return_inverse=True)
        count = np.bincount(where, weights=np.append(np.repeat(n, sizes), [again[i]] * bool(again[i])), minlength=len(column))
        yield column.astype(np.int32), (count / max(1, bounds[i + 1] - bounds[i]) ** ROOT).astype(np.float32)


def log_ratios(good: np.ndarray, other: np.ndarray, n_good: int, n_other: int) -> np.ndarray:
    """What a feature says, from the numbers of documents that have it, shrunk towards zero by standard errors."""
    ratio = np.log((good + 1) / (n_good + 2)) - np.log((other + 1) / (n_other + 2))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - ERRORS * np.sqrt(1 / (good + 1) + 1 / (other + 1)), 0)


class Model:
    """Feature weights and ordered thresholds. Without ratings of two grades every document has the highest grade."""

    def __init__(self, grades: int):
        self.weights = np.zeros(WIDTH)
        self.thresholds = np.full(grades - 1, -40.0)

    def fit(self, grade: np.ndarray, told: np.ndarray, columns: np.ndarray, x: np.ndarray, rounds: int = 0) -> Model:
        """Documents of a grade each, of which the first has the first ``told[0]`` features in ``columns`` with values ``x``, and so on."""
        k = len(self.thresholds) + 1
        used, columns = np.unique(columns, return_inverse=True)
        ends = starts_of(told)
        w, t = np.zeros(len(used)), np.sort(np.log(np.cumsum(np.bincount(grade, minlength=k))[:-1] + 1) - np.log(np.cumsum(np.bincount(grade, minlength=k)[::-1])[::-1][1:] + 1))
        w2, t2 = np.full(len(used), 1e-8), np.full(k - 1, 1e-8)
        for _ in range(rounds or ROUNDS):  # gradient steps, scaled by the root of each parameter's squared gradients
            to_w, to_t = gradient(grade, told, ends, columns, x, w, t)
            w2, t2 = w2 + to_w**2, t2 + to_t**2
            w, t = w - 0.5 * to_w / np.sqrt(w2), np.sort(t - 0.1 * to_t / np.sqrt(t2))
        self.weights[used], self.thresholds = w, t
        return self

    def rate(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the highest grade of each document."""
        distinct, places, bounds = batch_words(lists)
        weight = np.append(self.weights, 0.0)[word_features(distinct)].sum(axis=1)  # -1 takes the zero at the end
        # each document is summed alone, so that the sum does not depend on the documents before
        sums = np.where(np.diff(bounds) > 0, np.add.reduceat(np.append(weight[places], 0.0) if len(places) else np.zeros(1), bounds[:-1]), 0.0)
        sums = sums + repeats(places, bounds) * self.weights[REPEATED]
        quality = sums / np.maximum(np.diff(bounds), 1) ** ROOT
        above = 1 - sigmoid(self.thresholds - quality[:, None])
        return above.sum(axis=1), above[:, -1]


def chances(grade: np.ndarray, quality: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(grade or lower) and P(lower) of each document."""
    k = len(t) + 1
    upper = np.where(grade < k - 1, sigmoid(np.append(t, 0)[grade] - quality), 1.0)
    lower = np.where(grade > 0, sigmoid(np.append(0, t)[grade] - quality), 0.0)
    return upper, lower


def gradient(grade: np.ndarray, told: np.ndarray, ends: np.ndarray, columns: np.ndarray, x: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood, and of RIDGE / 2 times the squared weights."""
    quality = np.where(told > 0, np.add.reduceat(np.append(x * w[columns], 0.0), ends[:-1]), 0.0)
    upper, lower = chances(grade, quality, t)
    p = np.maximum(upper - lower, 1e-9)
    up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
    to_w = np.bincount(columns, x * np.repeat(up - low, told), minlength=len(w)) / len(grade) + RIDGE * w
    k = len(t) + 1
    to_t = (np.bincount(grade, low, minlength=k)[1:] - np.bincount(grade, up, minlength=k)[:-1]) / len(grade)
    return to_w, to_t


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rated documents, chosen by the hash of their id; of these, null texts are left out.

    ``ratings`` has (id, grade), grades from 0 on; null ids and grades are left out, and of several grades for one id the lowest
    counts. Of documents with equal ids the text with the lowest hash is taken. Texts of any length become features where they
    lie. The numbers of documents with a feature are added up in Spark, features that say nothing are dropped, and one
    task fits the rest: ``sample`` documents with, each, at most the features that say something. Only weights
    come to the driver.
    """
    rated = ratings.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").cast("int").alias("grade"))
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = rated.join(named.select("id").distinct(), "id").orderBy(F.xxhash64("id"), "id").limit(sample)  # ids alone are shuffled
    texts = named.where("text is not null").join(F.broadcast(chosen), "id")  # ``sample`` ids and grades at most
    once = texts.groupBy("id").agg(F.first("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text"))
    some = once.select(F.xxhash64("id").alias("place"), "grade", words_of(F.col("text")).alias("words"))

    def featurise(parts):
        for whole in parts:
            for part in parcels(whole, "words", PARCEL):
                found = list(document_features(part.column("words")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("place"), part.column("grade"), pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))],
                    ["place", "grade", "columns", "counts"],
                )

    features = stage(some.mapInArrow(featurise, "place bigint, grade int, columns array<int>, counts array<float>"), "features")
    n = dict(features.groupBy("grade").count().collect())
    if len(n) < 2:
        return Model(grades)
    good = (F.col("grade") == grades - 1).cast("int")
    met = features.select(F.explode("columns").alias("column"), good.alias("good")).groupBy("column").agg(F.sum("good").alias("good"), F.count("*").alias("all")).toArrow()  # WIDTH rows at most
    counts = np.zeros((2, WIDTH), np.int64)
    counts[:, met.column("column").to_numpy()] = met.column("good").to_numpy(), met.column("all").to_numpy()
    n_good = n.get(grades - 1, 0)
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(counts[0], counts[1] - counts[0], n_good, sum(n.values()) - n_good))

    def solve(parts):
        rows = []
        for part in parts:
            for place, grade, columns, values in zip(part.column("place").to_pylist(), part.column("grade").to_pylist(), part.column("columns"), part.column("counts"), strict=True):
                columns, values = columns.values.to_numpy(zero_copy_only=False), values.values.to_numpy(zero_copy_only=False)
                told = ratio.value[columns] != 0
                rows.append((place, grade, columns[told], values[told] * ratio.value[columns[told]].astype(np.float32)))
        rows.sort(key=lambda r: r[0])  # so that sums do not depend on where rows lay
        if rows:
            grade, told = np.array([r[1] for r in rows]), np.array([len(r[2]) for r in rows])
            columns, x = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
            del rows
            model = Model(grades).fit(grade, told, columns, x)
            used = np.flatnonzero(model.weights)
            yield pa.RecordBatch.from_arrays([pa.array([used], pa.list_(pa.int64())), pa.array([model.weights[used] * ratio.value[used]], pa.list_(pa.float64())), pa.array([model.thresholds], pa.list_(pa.float64()))], ["used", "weights", "thresholds"])

    fitted = features.coalesce(1).mapInArrow(solve, "used array<bigint>, weights array<double>, thresholds array<double>").first()
    model = Model(grades)
    model.weights[fitted.used], model.thresholds = fitted.weights, np.array(fitted.thresholds)
    return model


def rate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, expected_grade, tail_probability, kept) for each row: kept if P(highest grade) is at least ``least``.

    A null or empty text has no features and gets what the thresholds alone say. Null ids and repeated rows stay.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kind = read.schema["doc_id"].dataType.simpleString()

    def batches(parts):
        for whole in parts:
            for part in parcels(whole, "words", PARCEL):
                grade, tail = sent.value.rate(part.column("words"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(grade), pa.array(tail), pa.array(tail >= least)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    return read.mapInArrow(batches, f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean").withColumnRenamed("doc_id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole, that ``rate`` keeps. Columns may have any names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct("*").alias("row"), words_of(F.col(text_col)).alias("words"))
    kind = StructType([packed.schema["row"]])

    def batches(parts):
        for whole in parts:
            for part in parcels(whole, "words", PARCEL):
                _, tail = sent.value.rate(part.column("words"))
                row = part.column("row")
                yield pa.RecordBatch.from_arrays([row.filter(pa.array(tail >= least))], ["row"])

    return packed.mapInArrow(batches, kind).select("row.*")


def grades_of(labels: DataFrame) -> DataFrame:
    """(id, grade): 0 for poor quality, 1 for good but toxic, 2 for good; null where a label is missing."""
    return labels.select(F.col("doc_id").alias("id"), (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
