"""Ranked search for items among documents through compressed quadtrees of impacts.

``build_index`` counts the corpus, then packs about equally many bytes of documents into a grid each and writes one row a
grid: its documents, its terms with their document frequencies, and the arrays of its quadtree (see ``treaps``). ``search``
reads of the index first the frequencies of the items' terms, which set the weights, and then lets all items descend
in every grid, with the results so far as the bar. A task returns its best documents for each item, not its grids'.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solvane.llm.treaps import Best, Treap, search as descend
from solvane.llm.words import gathered, parcels
from solvane.storage import scratch_path, stage

# Fixed values of the scoring rule.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_SCALE = 1000, 1_000_000_000, 1000, 8
LENGTH_SHARE, LENGTH_FULL = 90, 100  # per cent of a document's length that counts, of the whole

GRID_BYTES = 4 << 20  # text in a grid, unless one document has more
GRID_DOCUMENTS = 8192
ITEM_BYTES = 4 << 20  # text of items that are searched for in one pass
ITEMS = 64  # items that descend together
SEPARATORS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """The terms of a text, in order; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))


def split_terms(text: bytes) -> list[bytes]:
    """As ``terms_of``: bytes of other characters than ASCII letters and digits part terms, A-Z become small."""
    return text.translate(SEPARATORS).split()


class Index:
    """A written index: ``grids`` and the counts of the corpus."""

    def __init__(self, spark: SparkSession, path: str, documents: int, terms: int, id_type: str):
        self.grids, self.path, self.documents, self.terms, self.id_type = spark.read.parquet(path), path, documents, terms, id_type

    def one_by_one(self) -> DataFrame:
        """The grids for a Python function that gets one at a time, as a grid is megabytes: by a session of its own, whose settings no other query meets."""
        narrow = self.grids.sparkSession.newSession()
        narrow.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        narrow.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1")
        return narrow.read.schema(self.grids.schema).parquet(self.path)


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms of all documents."""

    def count(parts):
        documents = terms = 0
        for whole in parts:
            for part in parcels(whole, "text", GRID_BYTES):
                for text in part.column("text").cast(pa.binary()):
                    n = len(split_terms(text.as_py()))
                    documents, terms = documents + (n > 0), terms + n
        yield pa.RecordBatch.from_pydict({"documents": [documents], "terms": [terms]})

    got = docs.select("text").mapInArrow(count, "documents bigint, terms bigint").agg(F.sum("documents"), F.sum("terms")).first()
    return int(got[0] or 0), int(got[1] or 0)


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = LENGTH_FULL - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // max(terms, 1)
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m)


def grid(ids: pa.Array, texts: pa.Array, documents: int, terms: int) -> dict:
    """One row of the index: documents in ascending order of id, terms by falling frequency."""
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    vocabulary: dict[bytes, int] = {}
    rows, tfs, distinct, lengths = [], [], [], []
    for i in order.tolist():
        found = split_terms(texts[i].as_py())
        counted = Counter(found)
        rows.extend([vocabulary.setdefault(t, len(vocabulary)) for t in counted])
        tfs.extend(counted.values())
        distinct.append(len(counted))
        lengths.append(len(found))
    rows, tfs, distinct, lengths = (np.array(x, np.int64) for x in (rows, tfs, distinct, lengths))
    df = np.bincount(rows, minlength=len(vocabulary)) if len(rows) else np.zeros(0, np.int64)
    by_frequency = np.argsort(-df, kind="stable")  # neighbours in a band are about equally frequent
    place = np.empty(len(df), np.int64)
    place[by_frequency] = np.arange(len(df))
    columns = np.repeat(np.arange(len(distinct)), distinct)
    treap = Treap.build(place[rows], columns, impact(tfs, lengths[columns], documents, terms), len(order))
    names = list(vocabulary)
    out = {"ids": ids.take(pa.array(order)), "terms": [names[i].decode() for i in by_frequency.tolist()], "df": df[by_frequency]}
    return out | {k: treap.arrays[k].tobytes() for k in Treap.ARRAYS}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows of ``docs``, written to the shared folder. Documents without terms are in no grid's cells."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    documents, terms = corpus_counts(read)
    id_type = read.schema["id"].dataType.simpleString()

    def batches(parts):
        for part in gathered(parts, "text", GRID_BYTES):
            for low in range(0, len(part), GRID_DOCUMENTS):
                some = part.slice(low, GRID_DOCUMENTS)
                one = grid(some.column("id"), some.column("text").cast(pa.binary()), documents, terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one["ids"].to_pylist()], pa.list_(one["ids"].type)), pa.array([one["terms"]], pa.list_(pa.string())), pa.array([one["df"]], pa.list_(pa.int64())), *(pa.array([one[k]], pa.binary()) for k in Treap.ARRAYS)],
                    ["ids", "terms", "df", *Treap.ARRAYS],
                )

    schema = f"ids array<{id_type}>, terms array<string>, df array<bigint>, " + ", ".join(f"{k} binary" for k in Treap.ARRAYS)
    path = scratch_path(docs.sparkSession, "grids")
    read.mapInArrow(batches, schema).write.parquet(path)
    return Index(docs.sparkSession, path, documents, terms, id_type)


TYPES = {"masks": np.uint8, "sizes": np.int64}


def search(index: Index, items: DataFrame, most: int = 10, id_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id") -> DataFrame:
    """(item, rank, doc, score): for each item the ``most`` documents with the highest scores above 0, ties by ascending id.

    An item is an id of ``items``: its terms are those of all rows with that id, once each, and null is an id too. Items
    without terms, or whose terms no document holds, have no rows; nor has an empty table. A null document id comes after all
    others in a tie; documents with equal ids are ranked each for itself. Extra columns are not read.
    """
    asked = items.select(F.col(id_col).alias("item"), F.explode(terms_of(F.col(text_col))).alias("term")).distinct()
    asked = stage(asked, "asked")
    held = index.grids.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    weighed = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    asked = stage(asked.join(weighed, "term"), "weighed")
    size = asked.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    block = F.pmod(F.xxhash64(F.coalesce(F.col("item").cast("string"), F.lit(""))), blocks)
    kind = asked.schema["item"].dataType.simpleString()
    found = None
    for number in range(blocks):  # each item is in one block, and a block has a bounded size
        rows = asked.where(block == number).orderBy("item", "term").toArrow()
        part = _search_block(index, rows, most, kind)
        found = part if found is None else found.unionByName(part)
    own = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)
    return ranked.select(F.col("item").alias(id_col), "rank", F.col("doc").alias(doc_col), "score")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)


def _search_block(index: Index, rows: pa.Table, most: int, kind: str) -> DataFrame:
    items = rows.column("item").combine_chunks()
    names = items.dictionary_encode(null_encoding="encode")
    number, names = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), names.dictionary
    terms = rows.column("term").combine_chunks().dictionary_encode()
    weight = weights(rows.column("df").to_numpy(), index.documents)
    order = np.argsort(number, kind="stable")
    sent = index.grids.sparkSession.sparkContext.broadcast((names, terms.dictionary.to_pylist(), number[order], terms.indices.to_numpy()[order].astype(np.int64), weight[order]))

    def batches(parts):
        names, vocabulary, item, term, weight = sent.value
        best = Best(len(names), most)
        for part in parts:
            for i in range(len(part)):
                ids = part.column("ids")[i].values
                arrays = {k: np.frombuffer(part.column(k)[i].as_buffer(), TYPES.get(k, np.int32)) for k in Treap.ARRAYS}
                treap = Treap(len(ids), **arrays)
                place = {t: r for r, t in enumerate(part.column("terms")[i].as_py())}
                row = np.array([place.get(t, -1) for t in vocabulary], np.int64)[term]
                there = row >= 0
                null = ids.is_null().to_numpy(zero_copy_only=False)
                doc = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                own, row, heavy = item[there], row[there], weight[there]
                bounds = np.searchsorted(own, np.arange(0, len(names) + ITEMS, ITEMS))
                for a, b in zip(bounds, bounds[1:], strict=False):
                    descend(treap, own[a:b], row[a:b], heavy[a:b], doc, null, best)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(best.item)), pa.array(np.where(best.null, 0, best.doc), pa.int64(), mask=best.null), pa.array(best.score)], ["item", "doc", "score"]
        )

    columns = ["ids", "terms", *Treap.ARRAYS]
    schema = f"item {kind}, doc {index.id_type}, score bigint"
    path = scratch_path(index.grids.sparkSession, "found")
    index.one_by_one().select(*columns).mapInArrow(batches, schema).write.parquet(path)
    return index.grids.sparkSession.read.schema(schema).parquet(path)
