"""Vocabularies of known data sets, as tables (name, token, idx)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values. The lists hold the entries in the order of their ids. The smaller
# data set uses the first entries of each list, the larger one all of them.

# (element, aromatic)
NODE_TYPES = [
    ('C', False), ('C', True), ('Se', True), ('O', True), ('N', True), ('S', True), ('H', False), ('Si', False), ('S', False), ('O', False),
    ('N', False), ('F', False),
]

BOND_TYPES = ['SINGLE', 'DOUBLE', 'AROMATIC', 'TRIPLE']

# (node type, ((neighbour type, bond), ...))
FRAGMENTS = [
    (0, ((0, 0), (0, 0), (6, 0), (6, 0))), (0, ((0, 0), (0, 1), (6, 0))), (0, ((0, 0), (0, 1), (1, 0))), (1, ((0, 0), (1, 2), (4, 2))),
    (1, ((1, 2), (1, 2), (6, 0))), (1, ((1, 2), (1, 2), (2, 2))), (2, ((1, 2), (1, 2))), (1, ((1, 2), (1, 2), (3, 2))),
    (3, ((1, 2), (1, 2))), (1, ((1, 2), (3, 2), (6, 0))), (1, ((1, 2), (1, 2), (1, 2))), (1, ((1, 2), (1, 2), (4, 2))),
    (4, ((1, 2), (5, 2))), (5, ((4, 2), (4, 2))), (1, ((1, 2), (4, 2), (6, 0))), (4, ((1, 2), (1, 2))), (6, ((0, 0),)), (6, ((1, 0),)),
    (1, ((0, 0), (1, 2), (1, 2))), (1, ((0, 1), (1, 2), (1, 2))), (0, ((1, 1), (6, 0), (7, 0))), (7, ((0, 0), (0, 0), (6, 0), (6, 0))),
    (6, ((7, 0),)), (0, ((0, 0), (1, 1), (6, 0))), (4, ((1, 2), (1, 2), (6, 0))), (1, ((1, 2), (1, 2), (7, 0))),
    (7, ((0, 0), (1, 0), (6, 0), (6, 0))), (0, ((0, 0), (0, 1), (7, 0))), (0, ((0, 1), (1, 0), (6, 0))), (1, ((0, 0), (1, 2), (3, 2))),
    (0, ((0, 0), (0, 0), (0, 1))), (6, ((4, 0),)), (0, ((0, 1), (6, 0), (7, 0))), (1, ((0, 0), (1, 2), (2, 2))),
    (1, ((1, 2), (2, 2), (6, 0))), (1, ((1, 2), (5, 2), (6, 0))), (5, ((1, 2), (1, 2))), (1, ((1, 2), (1, 2), (5, 2))),
    (1, ((0, 0), (1, 2), (5, 2))), (0, ((0, 0), (1, 0), (6, 0), (6, 0))), (0, ((0, 1), (1, 0), (7, 0))), (1, ((4, 2), (5, 2), (6, 0))),
    (1, ((0, 0), (4, 2), (4, 2))), (1, ((4, 2), (4, 2), (6, 0))), (1, ((0, 0), (4, 2), (5, 2))), (1, ((1, 0), (1, 2), (4, 2))),
    (1, ((1, 0), (1, 2), (3, 2))), (1, ((1, 0), (1, 2), (5, 2))), (1, ((1, 0), (1, 2), (1, 2))), (1, ((1, 0), (1, 2), (2, 2))),
    (1, ((1, 0), (4, 2), (4, 2))), (1, ((1, 0), (4, 2), (5, 2))), (0, ((4, 0), (6, 0), (6, 0), (6, 0))), (4, ((0, 0), (1, 2), (1, 2))),
    (0, ((1, 0), (1, 0), (6, 0), (6, 0))), (7, ((1, 0), (1, 0), (6, 0), (6, 0))), (0, ((1, 0), (6, 0), (6, 0), (6, 0))),
    (1, ((1, 2), (5, 2), (8, 0))), (8, ((0, 0), (1, 0), (9, 1), (9, 1))), (0, ((6, 0), (6, 0), (6, 0), (8, 0))), (9, ((8, 1),)),
    (0, ((6, 0), (6, 0), (6, 0), (10, 0))), (10, ((0, 0), (0, 0), (1, 0))), (1, ((1, 2), (1, 2), (10, 0))), (0, ((0, 0), (9, 1), (10, 0))),
    (9, ((0, 1),)), (7, ((0, 0), (0, 0), (0, 0), (0, 0))), (0, ((6, 0), (6, 0), (6, 0), (7, 0))), (1, ((1, 2), (1, 2), (11, 0))),
    (11, ((1, 0),)), (0, ((0, 3), (6, 0))), (0, ((0, 3), (1, 0))), (1, ((1, 2), (1, 2), (9, 0))), (9, ((0, 0), (1, 0))),
    (0, ((6, 0), (6, 0), (6, 0), (9, 0))), (0, ((0, 0), (6, 0), (6, 0), (6, 0))), (0, ((0, 0), (1, 0), (8, 1))), (8, ((0, 1), (0, 1))),
    (0, ((0, 0), (6, 0), (8, 1))), (10, ((0, 0), (0, 0), (0, 0))), (0, ((0, 1), (1, 0), (10, 0))), (0, ((1, 0), (11, 0), (11, 0), (11, 0))),
    (11, ((0, 0),)), (0, ((0, 0), (0, 0), (1, 0), (1, 0))), (10, ((1, 0), (1, 0), (1, 0))), (0, ((0, 0), (10, 3))), (10, ((0, 3),)),
    (0, ((0, 0), (9, 0), (9, 1))), (9, ((0, 0), (6, 0))), (6, ((9, 0),)), (0, ((0, 1), (6, 0), (6, 0))), (0, ((0, 0), (0, 1), (8, 0))),
    (8, ((0, 0), (0, 0))), (0, ((8, 0), (8, 1), (10, 0))), (8, ((0, 1),)), (0, ((0, 0), (6, 0), (6, 0), (10, 0))),
    (0, ((0, 0), (0, 0), (0, 0), (1, 0))), (0, ((1, 0), (1, 0), (1, 0), (1, 0))), (0, ((0, 0), (1, 0), (9, 1))),
    (4, ((1, 0), (1, 2), (1, 2))), (1, ((1, 2), (1, 2), (4, 0))), (0, ((0, 1), (1, 0), (8, 0))), (8, ((0, 0), (0, 0), (9, 1), (9, 1))),
    (0, ((0, 3), (7, 0))), (1, ((1, 2), (4, 2), (5, 2))), (0, ((0, 0), (0, 0), (8, 1))), (10, ((1, 0), (9, 0), (9, 1))), (9, ((10, 1),)),
    (9, ((10, 0),)), (0, ((1, 0), (9, 0), (9, 1))), (9, ((0, 0), (0, 0))), (7, ((0, 0), (0, 0), (1, 0), (1, 0))),
    (0, ((1, 0), (6, 0), (6, 0), (9, 0))), (0, ((1, 0), (9, 1), (10, 0))), (0, ((0, 0), (0, 0), (0, 0), (0, 0))),
    (0, ((1, 0), (6, 0), (9, 1))), (0, ((0, 1), (1, 0), (1, 0))), (0, ((0, 0), (6, 0), (6, 0), (9, 0))), (4, ((1, 2), (4, 2))),
    (1, ((1, 2), (1, 2), (8, 1))), (8, ((0, 1), (1, 1))), (0, ((1, 0), (1, 0), (8, 1))), (0, ((1, 0), (6, 0), (8, 1))),
    (8, ((0, 0), (1, 0))), (4, ((1, 2), (3, 2))), (3, ((4, 2), (4, 2))), (0, ((0, 0), (1, 0), (6, 0), (10, 0))), (10, ((0, 0), (1, 1))),
    (1, ((1, 2), (1, 2), (10, 1))), (0, ((1, 0), (8, 0), (10, 1))), (10, ((0, 0), (0, 1))), (0, ((0, 0), (6, 0), (8, 0), (10, 0))),
    (0, ((0, 1), (8, 0), (8, 0))), (1, ((1, 2), (1, 2), (8, 0))), (1, ((1, 2), (5, 2), (7, 0))), (7, ((1, 0), (1, 0), (1, 0), (1, 0))),
    (0, ((0, 0), (1, 0), (11, 0), (11, 0))), (0, ((0, 0), (0, 0), (11, 0), (11, 0))), (0, ((0, 0), (11, 0), (11, 0), (11, 0))),
    (9, ((1, 0), (6, 0))), (4, ((0, 0), (4, 2), (4, 2))), (0, ((1, 0), (1, 0), (1, 0), (6, 0))), (0, ((0, 0), (0, 0), (1, 0), (6, 0))),
    (0, ((9, 0), (9, 1), (10, 0))), (0, ((0, 0), (0, 0), (1, 0), (9, 0))), (10, ((0, 0), (1, 0), (1, 0))), (8, ((1, 0), (1, 0))),
    (0, ((1, 0), (10, 3))), (0, ((9, 1), (10, 0), (10, 0))), (0, ((1, 0), (1, 0), (9, 1))),
]

# ((end type, end type), bond)
EDGES = [
    ((0, 0), 0), ((0, 6), 0), ((0, 0), 1), ((0, 1), 0), ((1, 1), 2), ((1, 4), 2), ((1, 6), 0), ((1, 2), 2), ((1, 3), 2), ((4, 5), 2),
    ((0, 1), 1), ((0, 7), 0), ((6, 7), 0), ((4, 6), 0), ((1, 7), 0), ((1, 5), 2), ((1, 1), 0), ((0, 4), 0), ((1, 8), 0), ((0, 8), 0),
    ((8, 9), 1), ((0, 10), 0), ((1, 10), 0), ((0, 9), 1), ((1, 11), 0), ((0, 0), 3), ((1, 9), 0), ((0, 9), 0), ((0, 8), 1), ((0, 11), 0),
    ((0, 10), 3), ((6, 9), 0), ((1, 4), 0), ((9, 10), 1), ((9, 10), 0), ((4, 4), 2), ((1, 8), 1), ((3, 4), 2), ((1, 10), 1), ((0, 10), 1),
]

# (element, aromatic) of the polymer data set, which has atom types only
POLYMER_NODE_TYPES = [
    ('C', False), ('C', True), ('S', True), ('H', False), ('N', True), ('F', False), ('O', False), ('Si', False), ('O', True), ('S', False),
    ('N', False), ('Ge', False), ('Se', True), ('Te', True), ('P', False), ('Cl', False), ('B', False),
]

# Entries used of (node types, bonds, fragments, edges), and the limits
# (sequence length, atoms per molecule, SMILES length).
SIZES = {"CEP25000": (8, 3, 56, 18), "HOPV15": (12, 4, 150, 40)}
LIMITS = {"CEP25000": (60, 53, 83), "HOPV15": (150, 142, 186)}
POLYMERS = "OSAKA"


def node_token(node_type: tuple[str, bool]) -> str:
    symbol, aromatic = node_type
    return f"{symbol}|aromatic" if aromatic else symbol


def fragment_token(fragment: tuple) -> str:
    """The spelling used by graph relabelling: equal neighbours are counted, texts sorted."""
    node, around = fragment
    texts = [f"{label}/{bond}" for label, bond in around]
    return f"{node}(" + ",".join(f"{t}*{texts.count(t)}" for t in sorted(set(texts))) + ")"


def edge_token(edge: tuple) -> str:
    ends, bond = edge
    low, high = sorted(str(e) for e in ends)
    return f"{low}~{high}/{bond}"


def vocabulary_rows(dataset: str) -> list[tuple[str, str, int]]:
    if dataset == POLYMERS:
        return [("node", node_token(t), i) for i, t in enumerate(POLYMER_NODE_TYPES)]
    if dataset not in SIZES:
        raise ValueError(f"unknown dataset {dataset!r}")
    nodes, bonds, fragments, edges = SIZES[dataset]
    tables = {
        "node": [node_token(t) for t in NODE_TYPES[:nodes]],
        "bond": BOND_TYPES[:bonds],
        "fragment": [fragment_token(f) for f in FRAGMENTS[:fragments]],
        "edge": [edge_token(e) for e in EDGES[:edges]],
    }
    return [(name, token, i) for name, tokens in tables.items() for i, token in enumerate(tokens)]


def vocabulary(spark: SparkSession, dataset: str, name: str | None = None) -> DataFrame:
    """(name, token, idx) of a data set, or (token, idx) of one of its vocabularies."""
    table = spark.createDataFrame(vocabulary_rows(dataset), "name string, token string, idx int")
    return table if name is None else table.filter(table.name == name).select("token", "idx")
