"""Circular fingerprints: hashed neighbourhoods of radius 0..r folded to a number of bits."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvane.functions.arrays import bit_columns
from solvane.operators.graph import GRAPH, fragment_hashes, fragments, hashed_rows


def label_number(label: Column) -> Column:
    """The first 32 bits of a label's md5."""
    return F.conv(F.substring(F.md5(label), 1, 8), 16, 10).cast("bigint")


def fold_label(label: Column, n_bits: int) -> Column:
    """Bit position of a label, from the first 32 bits of its md5."""
    return F.pmod(label_number(label), F.lit(n_bits)).cast("int")


def _numbers(nodes: DataFrame, edges: DataFrame, radius: int, use_bond_types: bool, use_chirality: bool, hashed: bool) -> DataFrame:
    if not use_bond_types:
        edges = edges.withColumn("bond", F.lit(""))
    if hashed or use_chirality:
        rounds = fragment_hashes(nodes, edges, radius, chiral=use_chirality)
        found = [labels.select(GRAPH, F.col("label").alias("number")) for labels in rounds]
    else:
        found = [labels.select(GRAPH, label_number(F.col("label")).alias("number")) for labels in fragments(nodes, edges, radius)]
    return functools.reduce(DataFrame.unionByName, found)


def label_numbers(nodes: DataFrame, edges: DataFrame, radius: int = 2, use_bond_types: bool = True, use_chirality: bool = False, hashed: bool = False) -> DataFrame:
    """Distinct (graph_id, number) rows: the labels of rounds 0..radius before they are folded to a number of bits."""
    return _numbers(nodes, edges, radius, use_bond_types, use_chirality, hashed).distinct()


def _folded(numbers: DataFrame, n_bits: int) -> DataFrame:
    return numbers.select(GRAPH, F.pmod("number", F.lit(n_bits)).cast("int").alias("bit")).distinct()


def fingerprint_bits(nodes: DataFrame, edges: DataFrame, n_bits: int, radius: int, use_bond_types: bool = True, use_chirality: bool = False, hashed: bool = False) -> DataFrame:
    """Distinct (graph_id, bit) rows.

    ``hashed`` labels carry the neighbourhoods as sums of hashes, which suits any
    radius and degree; otherwise labels spell them.  With ``use_chirality``, which
    hashes, nodes have a column ``chirality`` (1, -1, or 0 for none), and mirrored
    centres set other bits from radius 1 on.
    """
    return _folded(_numbers(nodes, edges, radius, use_bond_types, use_chirality, hashed), n_bits)


def fingerprints(
    nodes: DataFrame, edges: DataFrame, kind: str = "morgan", n_bits: int = 2048, radius: int = 2, use_bond_types: bool = True, use_chirality: bool = False, hashed: bool = False, numbers: DataFrame | None = None
) -> DataFrame:
    """(graph_id, bits): sorted set-bit positions, at most ``n_bits`` of them.

    ``numbers`` saves the relabelling where :func:`label_numbers` of the same settings are already at hand.
    """
    if kind != "morgan":
        raise ValueError(f"unknown fingerprint type {kind!r}")
    if numbers is not None:
        bits = _folded(numbers, n_bits)
    elif hashed or use_chirality:
        return _hashed_fingerprints(nodes, edges if use_bond_types else edges.withColumn("bond", F.lit("")), n_bits, radius, use_chirality)
    else:
        bits = fingerprint_bits(nodes, edges, n_bits, radius, use_bond_types)
    return bits.groupBy(GRAPH).agg(F.sort_array(F.collect_list("bit")).alias("bits"))


def _hashed_fingerprints(nodes: DataFrame, edges: DataFrame, n_bits: int, radius: int, chiral: bool) -> DataFrame:
    """The labels of a graph that was walked in one piece lie in its row and are folded there."""
    rows, others = hashed_rows(nodes, edges, radius, chiral)
    labels = F.filter(F.concat(*(f"_l{i}" for i in range(radius + 1))), lambda v: v.isNotNull())
    folded = F.transform(labels, lambda v: F.pmod(v, F.lit(n_bits)).cast("int"))
    found = rows.select(GRAPH, F.sort_array(F.array_distinct(folded)).alias("bits"))
    if others is None:
        return found
    bits = [labels.select(GRAPH, F.pmod("label", F.lit(n_bits)).cast("int").alias("bit")) for labels in others]
    bits = functools.reduce(DataFrame.unionByName, bits).distinct()
    return found.unionByName(bits.groupBy(GRAPH).agg(F.sort_array(F.collect_list("bit")).alias("bits")))


def add_fingerprint_columns(df: DataFrame, fingerprint: DataFrame, key: str, n_bits: int = 1048, prefix: str = "fp") -> DataFrame:
    """Join (key, bits) to ``df`` and widen to one 0/1 column per bit."""
    joined = df.join(fingerprint, key, "left").withColumn("bits", F.coalesce("bits", F.array().cast("array<int>")))
    return joined.select(*df.columns, *[c.alias(n) for n, c in bit_columns("bits", n_bits, prefix).items()])
