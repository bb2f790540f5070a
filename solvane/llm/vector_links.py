"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, table distances, exact rerank.

For each length of vectors a bounded sample trains the centroids of the coarse lists and the codewords of each part of the residuals. Every distinct vector goes to its nearest list with its code and the exact
length of what the code leaves out. A vector's probes are sufficient: its own list, and each list whose cell can hold a vector
within the radius, as the border between two cells is at the same distance from both centroids. Of two vectors that can
be linked either one probes the other's list or they share one, so that each pair is compared once and counts for
both sides. In a probed list the distance from tables to each code, less what the code left out, is a lower bound; pairs
below the radius are checked by exact cosine. Vectors travel in blocks of bounded size, and a pair of blocks returns
counts and at most a link for each vector, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.llm.components import connected, forest
from solvane.storage import stage

SAMPLE = 20_000  # vectors at most that train an index
SAMPLE_NUMBERS = 4_000_000  # and numbers in them at most
LIST = 512  # vectors wanted in a list of the largest label
LISTS = 1024  # at most, as the sample trains them
BLOCK = 1024  # vectors that travel together
PARTS, CODES = 8, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[i : i + 1024], centres).argmin(1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, int)


class Index:
    """Trained on unit vectors; small, and sent to all tasks."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = kmeans(sample, lists)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.edges = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.words = [kmeans(rest[:, a:b], CODES) for a, b in self.parts()]
        gaps = squares(self.centres, self.centres)
        np.fill_diagonal(gaps, 1)
        self.gaps = np.sqrt(np.maximum(gaps, 1e-12))

    def parts(self):
        return list(zip(self.edges, self.edges[1:], strict=False))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, and lengths of what the codes leave out."""
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([nearest(rest[:, a:b], w) for (a, b), w in zip(self.parts(), self.words, strict=True)], axis=1)
        left = rest - np.concatenate([w[codes[:, j]] for j, w in enumerate(self.words)], axis=1)
        return own, codes.astype(np.uint8), np.sqrt((left * left).sum(1))

    def probes(self, x: np.ndarray, reach: float) -> np.ndarray:
        """Lists (columns) whose cell can hold a vector within ``reach`` of the vectors (rows)."""
        far = squares(x, self.centres)
        own = far.argmin(1)
        border = (far - far[np.arange(len(x)), own][:, None]) / (2 * self.gaps[own])
        border[np.arange(len(x)), own] = 0
        return border <= reach + 1e-6

    def table_distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        rest = x - self.centres[at]
        out = np.zeros((len(x), len(codes)))
        for j, ((a, b), words) in enumerate(zip(self.parts(), self.words, strict=True)):
            out += squares(rest[:, a:b], words)[:, codes[:, j]]
        return np.sqrt(out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def matrix(data: list[bytes], width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(data), kind).reshape(-1, width).astype(np.float64)


def link_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row: vectors of one label and length link at cosine ``least`` or more.

    Equal vectors of a label are one class with one representative, the smallest id, and count for each other.
    A vector that is null, zero, or holds null or non-finite components links with nothing, nor does one
    with a null label or id; its component is its own id, and it is kept (not, if the id is null). Rows with equal ids
    are one node. ``kept`` is true for the smallest id of each component. Each length has an index of its own, one pass
    for each. Numbers are compared as they are, float or double. Extra columns are not read.
    """
    v = F.col("vector")
    double = vectors.schema[vector_col].dataType.simpleString() == "array<double>"
    kind = "<f8" if double else "<f4"
    read = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>" if double else "array<float>").alias("vector"), F.col(label_col).alias("label"))
    sound = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    rows = read.select("id", "label", "vector", F.when(sound, F.struct(F.xxhash64("label", v).alias("one"), F.hash("label", v).alias("two"), F.size(v).alias("width"))).alias("key"))
    rows = stage(rows, "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").cast("bigint").alias("class"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = stage(classes, "classes")
    names = rows.select("id", "key").join(classes.select("key", "class", "copies"), "key", "left")
    found = None
    for width in [r.width for r in classes.select(F.col("key.width").alias("width")).distinct().orderBy("width").collect()]:
        part = _links_of_width(classes.where(F.col("key.width") == width), width, kind, least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return names.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").cast("bigint").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    roots = connected(found.where("b is not null").select("a", "b"))
    out = names.join(counts, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    component = F.coalesce("root", "class", "id").cast("bigint")
    linked = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select(F.col("id").alias(id_col), linked.cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _links_of_width(usable: DataFrame, width: int, kind: str, least: float) -> DataFrame:
    """(a, null, n): linked rows of class a, to be added up; (a, b, 0): links. Of classes (class, copies, label, vector) of one length."""
    largest = usable.groupBy("label").count().agg(F.max("count")).first()[0]
    size = max(1, min(SAMPLE, SAMPLE_NUMBERS // width))
    picked = usable.orderBy(F.hash(F.col("key.one")), "class").limit(size).select("vector").toArrow().column("vector").combine_chunks()
    sample = picked.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    index = usable.sparkSession.sparkContext.broadcast(Index(unit(sample), int(min(max(largest // LIST, 1), LISTS, max(len(sample) // 16, 1)))))
    radius = float(np.sqrt(2 - 2 * least))
    label_type = usable.schema["label"].dataType.simpleString()

    def assign(parts):
        for part in parts:
            data = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(part), width)
            x = unit(data.astype(np.float64))
            own, codes, left = index.value.encode(x)
            probed = [np.flatnonzero(r[o:]) + o for r, o in zip(index.value.probes(x, radius), own.tolist(), strict=True)]  # the lists before ask for this one
            yield pa.RecordBatch.from_arrays(
                [part.column("class"), part.column("copies"), part.column("label"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left), pa.array([d.tobytes() for d in data], pa.binary()), pa.array(probed, pa.list_(pa.int32()))],
                ["class", "copies", "label", "list", "code", "left_out", "vector", "probes"],
            )

    schema = f"class bigint, copies bigint, label {label_type}, list int, code binary, left_out double, vector binary, probes array<int>"
    coded = stage(usable.select("class", "copies", "label", "vector").mapInArrow(assign, schema), "codes")
    sizes = coded.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = coded.join(sizes, ["label", "list"]).withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    item = F.struct("class", "copies", "code", "left_out", "vector")
    blocks = dealt.groupBy("label", "list", "block").agg(F.collect_list(item).alias("items"), F.array_distinct(F.flatten(F.collect_set("probes"))).alias("probes"))
    blocks = stage(blocks, "blocks")
    asked = blocks.select("label", F.col("list").alias("home"), F.explode("probes").alias("list"), F.col("items").alias("queries"))
    met = asked.join(blocks.select("label", "list", "items"), ["label", "list"])

    def compare(parts):
        for part in parts:
            counted, links = [], []
            for home, at, queries, items in zip(part.column("home").to_pylist(), part.column("list").to_pylist(), part.column("queries"), part.column("items"), strict=True):
                mine, own_copies, raw, _, _ = unpacked(queries)
                theirs, copies, other, codes, left = unpacked(items)
                x = unit(raw)
                probing = index.value.probes(x, radius)[:, at]
                own_length, length = np.sqrt((raw**2).sum(1)), np.sqrt((other**2).sum(1))
                a, b = [], []
                for low in range(0, len(x), 64):
                    near = index.value.table_distances(x[low : low + 64], at, codes) <= radius + left + 1e-6
                    near &= probing[low : low + 64, None]
                    near &= mine[low : low + 64, None] < theirs if home == at else mine[low : low + 64, None] != theirs
                    i, j = np.nonzero(near)
                    exact = np.einsum("nd,nd->n", raw[i + low], other[j]) / (own_length[i + low] * length[j]) >= least
                    a.append(i[exact] + low)
                    b.append(j[exact])
                a, b = np.concatenate(a), np.concatenate(b)
                if not len(a):
                    continue
                nodes, where = np.unique(np.concatenate([mine, theirs]), return_inverse=True)
                a, b, n = where[a], where[len(mine) + b], np.bincount(where[a], weights=copies[b], minlength=len(nodes)) + np.bincount(where[len(mine) + b], weights=own_copies[a], minlength=len(nodes))
                counted += [(int(nodes[i]), None, int(n[i])) for i in np.flatnonzero(n).tolist()]
                root = forest(len(nodes), a, b)
                links += [(int(nodes[i]), int(nodes[r]), 0) for i, r in enumerate(root.tolist()) if r != i]
            columns = zip(*counted, *links, strict=True) if counted or links else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b", "n"])

    def unpacked(rows):
        """Classes, copies, vectors, codes and lengths left out of a block."""
        rows = rows.values
        vector, code = (rows.field(k).to_pylist() for k in ("vector", "code"))
        return (
            rows.field("class").to_numpy(zero_copy_only=False),
            rows.field("copies").to_numpy(zero_copy_only=False),
            matrix(vector, width, kind),
            np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1),
            rows.field("left_out").to_numpy(zero_copy_only=False),
        )

    return stage(met.select("home", "list", "queries", "items").mapInArrow(compare, "a bigint, b bigint, n bigint"), "found")
