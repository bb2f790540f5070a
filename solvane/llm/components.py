"""Connected components of a table of links, as Spark joins, and the links inside a bounded block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.storage import stage


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that links reach.

    Rounds of two star steps: each node's larger neighbours are tied to its smallest one, then its smaller ones. The
    links of a round are written to the shared folder. Minima are taken before the shuffle and joined back, so
    that a node with very many neighbours is never listed, and skewed joins can be split.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        large = stage(large, "links")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        tied = large.join(low, "b")
        small = tied.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b")).distinct()
        edges = stage(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that the links between ``a`` and ``b`` reach."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root
