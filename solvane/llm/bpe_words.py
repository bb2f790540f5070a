"""BPE encoding through a table of distinct words, and decoding through a table of pieces.

Spark cuts the texts into words. A task turns blocks of a few megabytes into the list of their distinct words and, for
each document, the places of its words in that list. The distinct words are dealt by hash to the partition that
encodes each of them once; the ids go back to the blocks by place. Only distinct words of blocks, places and ids
are shuffled, in packets, never texts, and no word gathers its occurrences anywhere. Decoding joins ids with the table
of pieces, whose size is the vocabulary's, in the task that holds the ids.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from solvane.llm.transducer import byte_alphabet
from solvane.llm.words import binary_rows, cut_words, encode_words, gathered, offsets_of, starts_of, take_ragged

BLOCK_BYTES = 16 << 20
SLICE = 1 << 17  # words that are put together at once
DOCUMENTS = "block bigint, first int, doc_ids array<{kind}>, sizes binary, places binary, counts binary, ids binary"
PACKETS = "block bigint, bucket int, first int, words binary"


def small(values: np.ndarray) -> bytes:
    """Integers in the narrowest of 1, 2 or 4 bytes, packed."""
    kind = np.min_scalar_type(values.max(initial=0))
    kind = np.dtype("u4") if kind.itemsize > 4 else kind
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(values.astype(kind.newbyteorder("<")).tobytes())


def large(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def packed_words(words: pa.Array) -> bytes:
    """Lengths, then bytes, of UTF-8 strings."""
    bounds = offsets_of(words)
    low = words.buffers()[1] and np.frombuffer(words.buffers()[1], np.int32)[words.offset]
    data = (words.buffers()[2] or pa.py_buffer(b""))[int(low) : int(low + bounds[-1])]
    sizes = np.diff(bounds).astype("<u4").tobytes()
    return len(words).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(sizes + bytes(data))


def unpacked_words(packet: bytes) -> tuple[np.ndarray, bytes]:
    n, data = int.from_bytes(packet[:4], "little"), zstandard.ZstdDecompressor().decompress(packet[4:])
    return np.frombuffer(data, "<u4", n).astype(np.int64), data[4 * n :]


def blocks_of(docs: DataFrame, buckets: int, what: str) -> DataFrame:
    """Blocks of documents: their ids and the places of their words (what: "documents"), or packets of their distinct words.

    The two come from two readings of ``docs``, so that places need not be shuffled with the words. A block is named by
    its partition and number and by a hash of its words; if a reading gives rows in another order, the names differ
    and the job fails rather than mix up words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def blocks(parts):
        number = TaskContext.get().partitionId() << 24
        for part in gathered(parts, "words", BLOCK_BYTES):
            lists = part.column("words")
            words = pc.dictionary_encode(lists.flatten())
            distinct, places = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
            times = np.bincount(places, minlength=len(distinct))
            hashes = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)
            name = hash((number, int(hashes.sum(dtype=np.uint64)), len(lists), len(places))) & (1 << 62) - 1
            number += 1
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            # by bucket, and in a bucket by spelling, which packs well
            spelled = pc.sort_indices(distinct).to_numpy()
            order = spelled[np.argsort(bucket[spelled], kind="stable")]
            if what == "packets":
                distinct, bucket = distinct.take(pa.array(order)), bucket[order]
                bounds = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(bucket)]
                packets = [packed_words(distinct.slice(a, b - a)) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(packets), pa.int64()), pa.array(bucket[bounds[:-1]], pa.int32()), pa.array(bounds[:-1], pa.int32()), pa.array(packets, pa.binary())], ["block", "bucket", "first", "words"])
                continue
            rank = np.argsort(-times[order], kind="stable")  # frequent words get small numbers in the places
            number_of = np.empty(len(order), np.int64)
            number_of[order[rank]] = np.arange(len(rank))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.int64()),
                    pa.array([-1], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("doc_id")),
                    pa.array([small(np.diff(offsets_of(lists)))], pa.binary()),
                    pa.array([join_bytes(small(number_of[places]), small(rank))], pa.binary()),
                    pa.nulls(1, pa.binary()),
                    pa.nulls(1, pa.binary()),
                ],
                ["block", "first", "doc_ids", "sizes", "places", "counts", "ids"],
            )

    return docs.select("doc_id", cut_words(F.col("text")).alias("words")).mapInArrow(blocks, PACKETS if what == "packets" else DOCUMENTS.format(kind=kind))


def join_bytes(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def split_bytes(both: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(both[:8], "little")
    return both[8 : 8 + n], both[8 + n :]


def encode_packets(packets: DataFrame, path: str, partitions: int, kind: str) -> DataFrame:
    """(block, first, counts, ids) of each packet; every distinct word is encoded once, in its bucket."""
    id_type = packets.sparkSession.createDataFrame([], f"x {kind}").toArrow().schema.field("x").type

    def encode(parts):
        at, known = None, {}
        for part in parts:
            counts_, ids_ = [], []
            for bucket, packet in zip(part.column("bucket").to_pylist(), part.column("words").to_pylist(), strict=True):
                if bucket != at:
                    at, known = bucket, {}
                sizes, data = unpacked_words(packet)
                bounds = starts_of(sizes).tolist()
                words = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                fresh = [w for w in words if w not in known]
                ids, counts = encode_words(path, [w.decode() for w in fresh])
                bounds, values = starts_of(counts).tolist(), ids.tolist()
                known.update((w, values[a:b]) for w, a, b in zip(fresh, bounds, bounds[1:], strict=False))
                own = [known[w] for w in words]
                counts_.append(small(np.fromiter(map(len, own), np.int64, len(own))))
                ids_.append(small(np.fromiter(chain.from_iterable(own), np.int64)))
            n = len(part)
            yield pa.RecordBatch.from_arrays([part.column("block"), part.column("first"), pa.nulls(n, pa.list_(id_type)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(counts_, pa.binary()), pa.array(ids_, pa.binary())], ["block", "first", "doc_ids", "sizes", "places", "counts", "ids"])

    return packets.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(encode, DOCUMENTS.format(kind=kind))


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The table from id to piece: all bytes, and where each id's begin."""
    described = json.loads(Tokenizer.from_file(path).to_str())
    alphabet = byte_alphabet()
    table = {n: bytes(alphabet[c] for c in token) for token, n in described["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in described["added_tokens"]}
    ordered = [table.get(i, b"") for i in range(max(table, default=-1) + 1)]
    return np.frombuffer(b"".join(ordered), np.uint8), starts_of(np.array([len(p) for p in ordered], np.int64))


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Encode whole texts with the byte-level BPE tokenizer in file ``path`` and decode the ids again.

    Returns (id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers in a binary, decoded as text,
    a row for each row of ``docs``. A null or empty text has no tokens and decodes to the empty text. Null ids and
    repeated rows are kept as they are; other columns are not read. ``buckets`` (by default two for each shuffle
    partition) is the number of parts of the table of distinct words.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 2 * parts
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    encoded = encode_packets(blocks_of(read, buckets, "packets"), path, parts, kind)
    blocks = blocks_of(read, buckets, "documents").unionByName(encoded)

    def assemble(block: pa.Table) -> pa.Table:
        rows = block.to_pylist()
        own = [r for r in rows if r["places"] is not None]
        packets = sorted((r["first"], r["counts"], r["ids"]) for r in rows if r["places"] is None)
        counts = [large(c) for _, c, _ in packets]
        if len(own) != 1 or sum(map(len, counts)) != len(rank := large(split_bytes(own[0]["places"])[1])):
            raise RuntimeError("a block and its words do not belong together: the input changed between two readings")
        place, sizes = large(split_bytes(own[0]["places"])[0]), large(own[0]["sizes"])
        starts, bounds = starts_of(np.concatenate(counts)), starts_of(sizes)
        ids = np.concatenate([large(i).astype("<u4") for *_, i in packets])
        table, begin = pieces(path)
        out = []
        low = 0
        while low < len(sizes):  # some documents at a time
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + SLICE, side="right")) - 1)
            flat, lengths = take_ragged(ids, starts, rank[place[bounds[low] : bounds[high]]])
            ends = starts_of(lengths)[bounds[low : high + 1] - bounds[low]]
            text, widths = take_ragged(table, begin, flat)
            decoded = binary_rows(text, starts_of(widths)[ends])
            try:
                decoded = decoded.cast(pa.string())
            except pa.ArrowInvalid:  # bytes that are no text
                decoded = pa.array([x.decode("utf-8", "replace") for x in decoded.to_pylist()], pa.string())
            ids_of = pa.array(own[0]["doc_ids"][low:high], block.schema.field("doc_ids").type.value_type)
            out.append(pa.table([ids_of, pa.array(np.diff(ends)), binary_rows(flat, ends), decoded], ["doc_id", "n_tokens", "ids", "decoded"]))
            low = high
        return pa.concat_tables(out)

    out = blocks.groupBy("block").applyInArrow(assemble, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")
    return out.withColumnRenamed("doc_id", id_col)
