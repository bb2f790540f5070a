"""Vector codes from one codebook a part, learned by Lloyd's rounds on whole numbers over members that stay where they are.

A vector is cut into consecutive parts. Every part is a member of one entry of its position's codebook. Members lie in a
table dealt by owner, which is (position, entry, salt): the salt spreads an entry with very many members over several
owners. In a round each owner adds up its resident members, the sums of all owners of an entry make the new entry, and
the members choose again. Those that keep their entry are written where they were read; only those that change it are
shuffled, to the owners of their new entry. Tables of two turns lie in the shared folder, the older one is
overwritten, so that a lost executor costs its tasks alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.storage import scratch_path, stage

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
LARGEST = 1 << 18  # beyond this size of a component a squared distance may not fit into 64 bits
EXACT = 1 << 52  # whole numbers up to here are exact in doubles
CHUNK = 4096  # members compared at once
MEMBER = "position tinyint, entry smallint, row bigint, part array<int>"


def quantised(vectors: DataFrame, vector_col: str, columns: dict[str, str]) -> DataFrame:
    """Sound rows: ``columns`` and ``whole``, each component as floor(1024 * x)."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    limit = F.raise_error(F.lit(f"components from {LARGEST} on can't be coded")).cast("int")
    whole = F.transform(v, lambda x: F.when(F.abs(x) < LARGEST, F.floor(x * SCALE).cast("int")).otherwise(limit))
    return vectors.where(sound).select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()), whole.alias("whole"))


def nearest(members: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each member, ties to the lower one, and its squared distance, in whole numbers."""
    own, error = np.zeros(len(members), np.int64), np.zeros(len(members), np.int64)
    reach = int(max(np.abs(members).max(initial=0), np.abs(entries).max(initial=0)))
    exact = 4 * reach * reach * max(members.shape[1], 1) < EXACT
    kind = np.float64 if exact else np.int64  # products of whole numbers in doubles are exact up to EXACT
    columns = entries.T.astype(kind)
    lengths = (columns * columns).sum(axis=0)
    for low in range(0, len(members), CHUNK):
        x = members[low : low + CHUNK].astype(kind)
        far = lengths - 2 * (x @ columns)
        own[low : low + CHUNK] = far.argmin(axis=1)
        gap = members[low : low + CHUNK].astype(np.int64) - entries[own[low : low + CHUNK]]
        error[low : low + CHUNK] = (gap * gap).sum(axis=1)
    return own, error


def by_position(part: pa.RecordBatch, width: int):
    """(places in the batch, their members as a matrix) for each position in the batch."""
    flat = part.column("part").flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)
    position = part.column("position").to_numpy(zero_copy_only=False)
    for p in np.unique(position).tolist():
        places = np.flatnonzero(position == p)
        yield p, places, flat[places]


def choose(members: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Members with the entry they choose now, and whether it is another one than before."""
    books = members.sparkSession.sparkContext.broadcast(codebooks)  # parts x entries x width, whatever the rows
    width = codebooks.shape[2]

    def batches(parts):
        for part in parts:
            now = np.zeros(len(part), np.int16)
            for p, places, x in by_position(part, width):
                now[places] = nearest(x, books.value[p])[0]
            before = part.column("entry").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [part.column("position"), pa.array(now, pa.int16()), part.column("row"), part.column("part"), pa.array(now != before)],
                ["position", "entry", "row", "part", "moved"],
            )

    return members.select("position", "entry", "row", "part").mapInArrow(batches, f"{MEMBER}, moved boolean")


def averages(members: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """New entries: the floor of each component's mean over the entry's members; entries without members stay.

    Each task returns at most one row for an entry and component, its own sum.
    """
    width = codebooks.shape[2]
    shape = codebooks.shape

    def sums(parts):
        total, count = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for part in parts:
            entry = part.column("entry").to_numpy(zero_copy_only=False).astype(np.int64)
            for p, places, x in by_position(part, width):
                order = np.argsort(entry[places], kind="stable")
                own = entry[places][order]
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                total[p, own[starts]] += np.add.reduceat(x[order].astype(np.int64), starts, axis=0)
                count[p] += np.bincount(own, minlength=shape[1])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
            ["position", "entry", "n", "total"],
        )

    found = members.select("position", "entry", "part").mapInArrow(sums, "position int, entry int, n bigint, total array<bigint>")
    cells = found.select("position", "entry", "n", F.posexplode("total").alias("at", "total"))
    cells = cells.groupBy("position", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    new = codebooks.copy()
    for row in cells.collect():  # parts x entries x width rows at most
        new[row.position, row.entry, row.at] = row.total // row.n
    return new


def learn(members: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Members after the last round, and the codebooks learned; ``members`` (position, row, part) have no entry yet."""
    spark = members.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = [scratch_path(spark, "members-even"), scratch_path(spark, "members-odd")]
    arrivals = [scratch_path(spark, "arrivals-even"), scratch_path(spark, "arrivals-odd")]
    salt = F.pmod(F.xxhash64("row"), F.lit(partitions)).cast("int")
    residents = members.select("position", F.lit(-1).cast("smallint").alias("entry"), "row", "part")
    for turn in range(rounds):
        chosen, arrived = turns[turn % 2], arrivals[turn % 2]
        choose(residents, codebooks).write.mode("overwrite").partitionBy("moved").parquet(chosen)
        dealt = spark.read.schema(f"{MEMBER}, moved boolean").parquet(chosen)
        stayed = dealt.where("not moved").drop("moved")
        moving = dealt.where("moved").drop("moved").repartition(partitions, "position", "entry", salt)
        moving.sortWithinPartitions("position", "entry").write.mode("overwrite").parquet(arrived)
        residents = stayed.unionByName(spark.read.schema(MEMBER).parquet(arrived))
        codebooks = averages(residents, codebooks)
    return residents, codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def code_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for each vector that can be coded.

    Rows whose vector is null or holds null or non-finite components are left out. ``code`` has two hexadecimal digits a part,
    ``error`` is the squared distance to the entries, ``label_error`` its sum over rows with an equal label; null labels
    are one label. The codebooks start as the parts of the ``entries`` rows with the smallest ids, fewer if there are fewer;
    of rows with equal ids the smaller vector comes first, and rows with a null id are coded but start no entry while
    others are left. Repeated rows are rows of their own. A vector of another length than that of the first row, and one whose length
    is no multiple of ``parts``, has a null code and error. Numbers from 2^18 on raise an error, as squared distances need 64 bits.
    An empty table gives an empty result. Extra columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hexadecimal digits tell up to 256 entries apart")
    spark = vectors.sparkSession
    kept = quantised(vectors, vector_col, {"id": id_col, "label": label_col})
    kept = stage(kept.withColumn("row", F.monotonically_increasing_id()), "kept")
    first = kept.orderBy(F.col("id").asc_nulls_last(), "whole").limit(1).select(F.size("whole").alias("width")).collect()
    width = first[0].width if first else 0
    width = width if width % parts == 0 else 0
    usable = kept.where((F.size("whole") == width) & F.lit(width > 0))
    seeds = usable.orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    own = width // parts
    codebooks = np.array([r.whole for r in seeds], np.int64).reshape(len(seeds), parts, own).transpose(1, 0, 2).copy()
    cuts = F.array(*(F.slice("whole", p * own + 1, own) for p in range(parts)))
    members = usable.select("row", F.posexplode(cuts).alias("position", "part")).withColumn("position", F.col("position").cast("tinyint"))
    if seeds:
        members, codebooks = learn(members, codebooks, rounds)
    books = spark.sparkContext.broadcast(codebooks)

    def batches(parts):
        for part in parts:
            entry, error = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for p, places, x in by_position(part, own):
                entry[places], error[places] = nearest(x, books.value[p])
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("position"), pa.array(entry), pa.array(error)], ["row", "position", "entry", "error"])

    coded = members.select("row", "position", "part").mapInArrow(batches, "row bigint, position tinyint, entry bigint, error bigint")
    places = F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda m: F.lpad(F.lower(F.hex(m["entry"])), 2, "0"))
    coded = coded.groupBy("row").agg(F.array_join(places, "").alias("code"), F.sum("error").alias("error"))  # ``parts`` rows each
    rows = stage(kept.select("row", "id", "label").join(coded, "row", "left"), "coded")
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = rows.join(labels.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
