"""Token ids in files: ids ranked by frequency, in a byte-aligned code of variable length with separate control bytes.

An id's rank (0 for the most frequent id of the whole corpus) is written in one to four data bytes, low byte first;
two bits in a control byte, four ids to a byte from the low bits on, hold the number of bytes less one. A block holds
some documents in ascending order of their ids: the ids and lengths of the documents, control bytes, and data bytes.
Blocks are rows of Parquet files beside a file with the ranking, so that they are committed whole and read on any store.
The ranking is bounded by the vocabulary; it is the one thing that is sent to all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solvane.llm.words import binary_rows, cut_words, encode_words, offsets_of, parcels, spaceless, starts_of, take_ragged
from solvane.storage import scratch_path

PARCEL = 8 << 20
BLOCK_IDS = 1 << 20


def encoded_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids, used, times): ids as two-byte integers if the vocabulary allows it, else four, with the end id appended.

    The first row of each parcel of texts also says which ids the parcel has (used) and how often (times).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = id_width(path, end_id)

    direct = spaceless(path).fits
    words = F.coalesce(F.col("text"), F.lit("")) if direct else cut_words(F.col("text"))

    def encode(parts):
        for whole in parts:
            for part in parcels(whole, "words", PARCEL):
                lists = spaceless(path).cut(part.column("words")) if direct else part.column("words")
                words = pc.dictionary_encode(lists.flatten())
                if direct:
                    flat, starts = spaceless(path).encode(words.dictionary)
                else:
                    flat, counts = encode_words(path, words.dictionary.to_pylist())
                    starts = starts_of(counts)
                places, bounds = words.indices.to_numpy(zero_copy_only=False), offsets_of(lists)
                times = np.zeros(int(flat.max(initial=end_id)) + 1, np.int64)
                np.add.at(times, flat, np.repeat(np.bincount(places, minlength=len(starts) - 1), np.diff(starts)))
                times[end_id] += len(part)
                used = np.flatnonzero(times)
                flat, starts = np.append(flat, end_id).astype(f"<u{width}"), np.append(starts, starts[-1] + 1)
                ids, lengths = take_ragged(flat, starts, np.insert(places, bounds[1:], len(starts) - 2))
                ends = starts_of(lengths)[bounds + np.arange(len(bounds))]
                rest = [None] * (len(part) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), binary_rows(ids, ends), pa.array([used.astype("<u4").tobytes(), *rest], pa.binary()), pa.array([times[used].astype("<u8").tobytes(), *rest], pa.binary())],
                    ["doc_id", "ids", "used", "times"],
                )

    return docs.select("doc_id", words.alias("words")).mapInArrow(encode, f"doc_id {kind}, ids binary, used binary, times binary")


def id_width(path: str, end_id: int) -> int:
    from solvane.llm.words import tokenizer

    return 2 if max(tokenizer(path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents; a task sends a row for each id at most."""

    def count(parts):
        total = np.zeros(0, np.int64)
        for part in parts:
            for used, times in zip(part.column("used").to_pylist(), part.column("times").to_pylist(), strict=True):
                used = np.frombuffer(used, "<u4")
                if len(used) and used[-1] >= len(total):
                    total = np.append(total, np.zeros(int(used[-1]) + 1 - len(total), np.int64))
                total[used] += np.frombuffer(times, "<u8").astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    told = encoded.select("used", "times").where("used is not null")
    return told.mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


# ---- the code ---------------------------------------------------------------------------------------------------

LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1  # of the four values of each control byte


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.asarray(values, np.int64)
    size = 1 + (values >= 1 << 8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    starts = starts_of(size)
    data = np.zeros(starts[-1], np.uint8)
    for byte in range(int(size.max(initial=0))):
        has = size > byte
        data[starts[:-1][has] + byte] = (values[has] >> 8 * byte) & 255
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS.take(np.frombuffer(control, np.uint8), axis=0).reshape(-1)[:n]
    starts = np.cumsum(size) - size
    flat = np.frombuffer(data, np.uint8)
    out = flat[starts].astype(np.int64)
    for byte in range(1, int(size.max(initial=0))):
        has = np.flatnonzero(size > byte)
        out[has] |= flat[starts[has] + byte].astype(np.int64) << 8 * byte
    return out


# ---- files --------------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write ``folder/blocks`` and ``folder/ranks``.

    A null or empty text is written as the end id alone. Null document ids come first; equal ids are all kept, in the
    order of their contents. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    width = id_width(tokenizer_path, end_id)
    staged = scratch_path(spark, "ids")
    encoded_documents(read, tokenizer_path, end_id).write.option("compression", "zstd").parquet(staged)
    encoded = spark.read.parquet(staged)
    counts = id_counts(encoded)
    ranks = [r.id for r in counts.orderBy(F.desc("n"), "id").select("id").collect()]  # at most the vocabulary
    spark.createDataFrame([(rank, i) for rank, i in enumerate(ranks)], "rank bigint, id bigint").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(1 << 8 * width if width == 2 else max(ranks, default=0) + 1, np.uint32)
    rank_of[np.array(ranks, np.int64)] = np.arange(len(ranks))
    sent = spark.sparkContext.broadcast(rank_of)
    kind = read.schema["doc_id"].dataType.simpleString()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.select("doc_id", "ids").repartitionByRange(parts, "doc_id", F.crc32("ids")).sortWithinPartitions("doc_id", "ids")

    def blocks(parts):
        number, ids_, data, size = 0, [], [], 0
        for part in parts:
            id_type = part.schema.field("doc_id").type
            for id_, ids in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist(), strict=True):
                ids_.append(id_)
                data.append(ids)
                size += len(ids) // width
                if size >= BLOCK_IDS:
                    yield block(number, ids_, data, id_type)
                    number, ids_, data, size = number + 1, [], [], 0
        if ids_:
            yield block(number, ids_, data, id_type)

    def block(number, ids_, data, id_type):
        sizes = np.array([len(d) // width for d in data], "<u4")
        control, coded = pack(sent.value[np.frombuffer(b"".join(data), f"<u{width}")])
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([ids_], pa.list_(id_type)), pa.array([sizes.tobytes()], pa.binary()), pa.array([control], pa.binary()), pa.array([coded], pa.binary())],
            ["block", "n_ids", "doc_ids", "sizes", "control", "data"],
        )

    schema = f"block bigint, n_ids bigint, doc_ids array<{kind}>, sizes binary, control binary, data binary"
    filed = ordered.mapInArrow(blocks, schema).withColumn("file", F.spark_partition_id())
    filed.write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers; start counts all ids before."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    whole = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))  # a row for each file
    own = Window.partitionBy("file").orderBy("block")
    offsets = blocks.select("file", "block", "n_ids").withColumn("within", F.sum("n_ids").over(own) - F.col("n_ids"))
    offsets = offsets.join(whole, "file").select("file", "block", (F.col("before") + F.col("within")).alias("start"))
    ranks = np.array([r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")  # at most the vocabulary
    sent = spark.sparkContext.broadcast(ranks)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(parts):
        for part in parts:
            for row in part.to_pylist():
                lengths = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                bounds = starts_of(lengths)
                ids = sent.value[unpack(row["control"], row["data"], int(bounds[-1]))]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], part.schema.field("doc_ids").type.value_type), pa.array(row["start"] + bounds[:-1]), pa.array(lengths), binary_rows(ids, bounds)], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(offsets, ["file", "block"]).select("start", "doc_ids", "sizes", "control", "data").mapInArrow(decode, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")
