"""Document fingerprints of improbable features, beside those of a text edited with the next document's beginning.

The rarity of entropies is counted over all windows of all documents. To bring each text to its successor, texts travel once:
the ids are cut into ranges at quantiles, the first document of each range is also sent to the range before, and each
task reads its ranges in order, holding one parcel of texts at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.llm import rarity
from solvane.llm.words import offsets_of, parcels, starts_of

PARCEL = 4 << 20
BEFORE_ALL = -(1 << 63)  # stands for a null id


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), starts_of(np.array([len(t) for t in texts], np.int64))


def entropy_histogram(texts: DataFrame) -> np.ndarray:
    """Windows of the corpus by level of entropy: a row of fixed size from each task, summed in Spark."""

    def count(parts):
        total = np.zeros(rarity.LEVELS, np.int64)
        for whole in parts:
            for part in parcels(whole, "text", PARCEL):
                column = part.column("text").cast(pa.large_binary())
                low = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
                bounds = offsets_of(column)
                data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[int(low) : int(low + bounds[-1])]
                total += rarity.level_histogram(data, bounds)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["level", "n"])

    out = np.zeros(rarity.LEVELS, np.int64)
    for row in texts.select("text").mapInArrow(count, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[row.level] = row.n
    return out


def text_digests(data: np.ndarray, bounds: np.ndarray, rank_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of all windows of the texts, where each text's begin, filters, and where each text's begin."""
    rank = rank_of[rarity.window_levels(data)]
    windows = starts_of(np.maximum(np.diff(bounds) - rarity.WIDTH + 1, 0))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(windows))
    rank = rank[bounds[text] + np.arange(len(text)) - windows[text]] if len(text) else np.zeros(0, np.int64)
    return (rank, windows, *rarity.digests(data, bounds, rank, windows))


def characters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all characters, and where each text's begin among them."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    return np.append(starts, len(data)), np.searchsorted(starts, bounds)


def compared(texts: list[bytes], rank_of: np.ndarray) -> list[tuple]:
    """For each text but the last: (characters, edited hash, digest, edited digest, likeness to edited, to the next)."""
    data, bounds = flat(texts)
    rank, windows, own, begin = text_digests(data, bounds, rank_of)
    starts, first = characters(data, bounds)
    n = np.diff(first)
    kept = n[:-1] - n[:-1] // 2
    cut = starts[first[:-2] + kept] - bounds[:-2]
    taken = starts[first[1:-1] + np.minimum(n[:-1] // 2, n[1:])] - bounds[1:-1]
    edited = [texts[i][:c] + texts[i + 1][:m] for i, (c, m) in enumerate(zip(cut.tolist(), taken.tolist(), strict=True))]
    # ranks of the edited texts' windows: those of the two parts, and those across the seam
    reach = rarity.WIDTH - 1
    seams, seam_at = flat([e[max(0, c - reach) : c + reach] for e, c in zip(edited, cut.tolist(), strict=True)])
    seam_rank = rank_of[rarity.window_levels(seams)]
    pieces, sizes = [], np.zeros(len(edited), np.int64)
    for i, (c, m) in enumerate(zip(cut.tolist(), taken.tolist(), strict=True)):
        across = seam_rank[seam_at[i] : max(seam_at[i], seam_at[i + 1] - reach)]
        parts = rank[windows[i] : windows[i] + max(0, c - reach)], across, rank[windows[i + 1] : windows[i + 1] + max(0, m - reach)]
        if m == 0:
            parts = (parts[0],)
        elif c == 0:
            parts = (parts[2],)
        pieces += parts
        sizes[i] = sum(map(len, parts))
    edited_data, edited_bounds = flat(edited)
    ranks = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    other, other_begin = rarity.digests(edited_data, edited_bounds, ranks, starts_of(sizes))
    to_edited = rarity.likenesses(own, begin[: len(edited) + 1], other, other_begin, np.arange(len(edited)))
    to_next = rarity.likenesses(own, begin[: len(edited) + 1], own, begin, np.arange(1, len(texts)))
    hexes, edited_hexes = own.tobytes().hex(), other.tobytes().hex()
    w = 2 * rarity.BITS // 8
    return [
        (int(n[i]), hashlib.sha256(e).hexdigest(), hexes[w * begin[i] : w * begin[i + 1]], edited_hexes[w * other_begin[i] : w * other_begin[i + 1]], float(to_edited[i]), float(to_next[i]))
        for i, e in enumerate(edited)
    ]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprint each whole text and its edited text: its last half replaced by the beginning of the next document.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row.
    The order is by id, null ids before all, equal ids by the hash of the text; the first follows the last. A null text
    counts as empty; the fingerprint of an empty text is the empty string, which is like itself only. Ids must be
    integers. Other columns are not read. ``ranges`` is the number of ranges of ids (by default three for each
    shuffle partition).
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 3 * partitions
    id_type = docs.schema[id_col].dataType.simpleString()
    order = F.coalesce(F.col(id_col).cast("bigint"), F.lit(BEFORE_ALL))
    read = docs.select(order.alias("at"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rank_of = rarity.ranks_of(entropy_histogram(read))
    steps = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    cuts = read.select(F.percentile_approx("at", steps, 10 * ranges).alias("cuts")).first().cuts or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    def range_starts(parts):
        for part in parts:
            ids = part.column("at").to_numpy()
            of = np.searchsorted(cuts, ids, side="right")
            used = np.unique(of)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([ids[of == u].min() for u in used], pa.int64())], ["range", "at"])

    firsts = read.select("at").mapInArrow(range_starts, "range bigint, at bigint").groupBy("range").agg(F.min("at").alias("at")).orderBy("range").collect()  # a row for each range
    numbers = [r["range"] for r in firsts]
    before = {r["at"]: numbers[i - 1] for i, r in enumerate(firsts)}

    def send(parts):
        pack = zstandard.ZstdCompressor(level=1)
        for part in parts:
            ids, texts = part.column("at").to_pylist(), [t.as_py() for t in part.column("text").cast(pa.binary())]
            of = np.searchsorted(cuts, np.array(ids, np.int64), side="right").tolist()
            rows = [(of[i], 0, ids[i], pack.compress(t), hashlib.md5(t).digest()) for i, t in enumerate(texts)]
            rows += [(before[ids[i]], 1, *r[2:]) for i, r in enumerate(rows) if ids[i] in before]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "after", "at", "packed", "tie"])

    def read_ranges(parts):
        unpack = zstandard.ZstdDecompressor()
        held, texts, size, at = [], [], 0, None

        def done():
            rows = compared(texts, rank_of)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([held[: len(rows)], *zip(*rows, strict=True)], (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["at", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        closed = False
        for part in parts:
            for number, after, id_, packed in zip(*(part.column(c) for c in ("range", "after", "at", "packed")), strict=True):
                number = number.as_py()
                if number != at:
                    held, texts, size, at, closed = [], [], 0, number, False
                if closed:  # more rows share the next range's first id
                    continue
                held.append(id_.as_py())
                texts.append(unpack.decompress(packed.as_py()))
                size += len(texts[-1])
                closed = after.as_py() == 1
                if len(texts) > 1 and (closed or size >= PARCEL):
                    yield done()
                    held, texts, size = held[-1:], texts[-1:], len(texts[-1])

    sent = read.mapInArrow(send, "range bigint, after int, at bigint, packed binary, tie binary")
    dealt = sent.repartition(partitions, "range").sortWithinPartitions("range", "after", "at", "tie").drop("tie")
    schema = "at bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = dealt.mapInArrow(read_ranges, schema)
    return out.select(F.when(F.col("at") != BEFORE_ALL, F.col("at")).cast(id_type).alias(id_col), *out.columns[1:])
