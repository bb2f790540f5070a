"""SimHash near-duplicates through signatures with one wildcard bit.

Two fingerprints of 64 bits that differ in at most three bits have a half in which they differ in at most one, so one quarter
of that half is equal in both. Fingerprints are dealt by their quarters, four rows each, to where those with an equal quarter
meet. There the other quarter of the half is written down 16 times, each time with another bit left out; equal signatures
meet, and the pairs are verified on all 64 bits. A quarter that very many fingerprints share is dealt by whole
signatures instead, so that it is spread. Tasks return not the pairs but links that join the same fingerprints, so that
the output does not grow with the square of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.llm.components import connected, forest
from solvane.storage import stage

CROWD = 1 << 16  # fingerprints with an equal quarter from which they are dealt by signature
BLOCK = 256  # fingerprints that are compared at once with others
CELLS = 1 << 22  # comparisons at once


def fingerprint(text: bytes, words: int) -> int:
    """Bits set in over half of the hashes of all runs of so many words; zero without words."""
    found = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), 42)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (ends[: len(ends) - words + 1] - np.fromiter(map(len, found[: len(found) - words + 1]), np.int64) - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    values = np.array([hashed(line[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for low in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[low : low + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print): the fingerprint as a signed 64-bit integer; a null text is an empty one."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def compute(parts):
        for part in parts:
            prints = np.array([fingerprint(t.as_py(), words) for t in part.column("text").cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return read.mapInArrow(compute, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, print bigint")


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``print`` that have the same components as all pairs within ``most`` bits."""
    if not 0 <= most <= 3:
        raise ValueError("two halves find up to three differing bits")
    quarters = F.array(*(F.shiftrightunsigned("print", 16 * q).bitwiseAND(0xFFFF).cast("int") for q in range(4)))
    routes = prints.select("print", F.posexplode(quarters).alias("quarter", "value"))
    routes = routes.select("print", "quarter", (F.col("quarter") * 65536 + F.col("value")).alias("route"))
    crowded = routes.groupBy("route").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("route", F.lit(True).alias("crowded"))
    crowded = stage(crowded, "crowded")  # 4 * 65536 routes at most
    sibling = F.expr("cast(shiftrightunsigned(print, 16 * (quarter ^ 1)) & 65535 as int)")
    bits = F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit(15))).otherwise(F.array(F.lit(-1)))
    dealt = routes.join(F.broadcast(crowded), "route", "left").select("print", "route", sibling.alias("sibling"), F.explode(bits).alias("bit"))
    dealt = dealt.select("print", "route", F.expr("if(bit < 0, -1, shiftleft(bit, 16) | (sibling & ~shiftleft(1, bit)))").alias("variant"))
    dealt = dealt.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "route", "variant").sortWithinPartitions("route", "variant")

    def batches(parts):
        kept = [np.zeros(0, np.int64)] * 3  # the rows of the last route, which may go on in the next batch
        for part in parts:
            rows = [np.concatenate([k, part.column(c).to_numpy()]) for k, c in zip(kept, ("print", "route", "variant"), strict=True)]
            place = (rows[1].astype(np.int64) << 21) + rows[2]
            whole = int(np.searchsorted(place, place[-1])) if len(place) else 0
            kept = [r[whole:] for r in rows]
            yield from found(*(r[:whole] for r in rows))
        yield from found(*kept)

    def found(values, route, variant):
        if len(values):
            a, b = near_pairs(*signatures(values, route.astype(np.int64), variant.astype(np.int64)), most)
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = forest(len(nodes), at[: len(a)], at[len(a) :])
            own = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[root[own]]), pa.array(nodes[own])], ["a", "b"])

    return dealt.mapInArrow(batches, "a bigint, b bigint")


def signatures(values: np.ndarray, route: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures in order, and the fingerprint of each: sixteen where a row stands for all variants of the sibling quarter."""
    ready = variant >= 0
    open_, quarter = values[~ready], route[~ready] >> 16
    sibling = open_.view(np.uint64) >> (16 * (quarter ^ 1)).astype(np.uint64) & np.uint64(0xFFFF)
    bit = np.arange(16)[:, None]
    rest = (bit << 16) | (sibling.astype(np.int64) & ~(1 << bit))
    signature = np.concatenate([((route[~ready] << 20) | rest).reshape(-1), (route[ready] << 20) | variant[ready]])
    order = np.argsort(signature, kind="stable")
    return signature[order], np.concatenate([np.tile(open_, 16), values[ready]])[order]


def near_pairs(signature: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints with an equal signature that differ in ``most`` bits or fewer."""
    starts = np.flatnonzero(np.diff(signature, prepend=-1))
    sizes = np.diff(np.append(starts, len(signature)))
    alone = np.repeat(sizes, sizes) <= 64
    short, run = values[alone], signature[alone]
    a, b = [], []
    for step in range(1, min(int(sizes.max(initial=0)), 64)):
        at = np.flatnonzero(run[step:] == run[:-step])
        if not len(at):
            break
        at = at[near(short[at], short[at + step], most)]
        a.append(short[at])
        b.append(short[at + step])
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        for x, y in crowd_pairs(values[start : start + size], int(signature[start]) >> 36, most):
            a.append(x)
            b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])


def near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= most


def crowd_pairs(values: np.ndarray, quarter: int, most: int):
    """As ``near_pairs`` for one signature of many fingerprints, a few rows at a time.

    They can only differ in three bits of the other half if one of its four bytes is equal, so that those with an equal byte
    are compared.
    """
    for byte in range(4):
        key = values.view(np.uint64) >> np.uint64(8 * byte + 32 * (1 - quarter // 2)) & np.uint64(0xFF)
        some = values[np.argsort(key, kind="stable")]
        for group in np.split(some, np.cumsum(np.bincount(key.astype(np.int64), minlength=256))[:-1]):
            block = max(1, min(BLOCK, CELLS // max(len(group), 1)))
            for low in range(0, len(group), block):
                i, j = np.nonzero(near(group[low : low + block, None], group[low:], most))
                ahead = i < j
                links = forest(len(group) - low, i[ahead], j[ahead])  # a link for each, not a pair
                own = np.flatnonzero(links != np.arange(len(links)))
                yield group[low + links[own]], group[low + own]


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``.

    Fingerprints link at ``most`` (up to 3) differing bits or fewer, equal ones always; component_id is the smallest id
    that links reach. Null and empty texts have fingerprint zero and link like any other. A row with a null id takes
    part like any other but never names a component; a component of such rows alone has a null id. Repeated rows stay.
    """
    found = stage(fingerprints(docs, words, id_col, text_col), "prints")
    distinct = found.select("print").distinct()
    roots = connected(links(distinct, most))
    # a fingerprint without a link is its own root
    named = found.groupBy("print").agg(F.min("doc_id").alias("first")).join(roots.withColumnRenamed("node", "print"), "print", "left")
    named = stage(named.withColumn("root", F.coalesce("root", "print")), "roots")
    linked = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.join(linked, "root").select("print", "component_id")
    out = found.join(names, "print")
    return out.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose id names their component; of several rows with that id the first by hash.

    Rows with a null id can't be told apart from others by it; they take no part and stay.
    """
    named = docs.where(F.col(id_col).isNotNull())
    found = near_duplicates(named, words, most, id_col, text_col).select(F.col(id_col).alias("id"), "component_id")
    first = stage(found.where("id = component_id").groupBy("id").agg(F.count("*").alias("n")), "first")
    packed = named.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))
    alone = packed.join(first.where("n = 1").select("id"), "id", "left_semi").select("row")
    several = packed.join(first.where("n > 1").select("id"), "id", "left_semi")
    several = several.groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    nameless = docs.where(F.col(id_col).isNull()).select(F.struct("*").alias("row"))
    return alone.unionByName(several).unionByName(nameless).select("row.*")
