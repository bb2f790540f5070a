"""Rounds of hashed labels over the graphs of Arrow batches: many graphs at a time, each whole.

Rows come sorted by graph: a node is its id in ``src`` and its label in ``text``, an edge has both ends and its bond in
``text``.  ``_k`` counts the rows of a graph from 1 to its ``_n``.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows worked on at a time.
CHUNK = 1 << 17
MASK = np.uint64((1 << 60) - 1)


def walked(batches, limit: int, radius: int, chiral: bool, schema: pa.Schema):
    """A row per graph with the lists of its nodes and of their labels after each round.

    Graphs of more than ``limit`` rows, and those in which a node comes twice, are handed on row by row.
    """
    held, rows = [], 0
    for batch in batches:
        small = pc.less_equal(batch.column("_n"), limit)
        if not pc.all(small, min_count=0).as_py():
            yield from _aligned(batch.filter(pc.invert(small)), schema)
            batch = batch.filter(small)
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = np.flatnonzero(table["_k"].to_numpy() == 1)
            whole = rows if table["_k"][-1].as_py() == table["_n"][-1].as_py() else int(starts[-1])
            yield from _graphs(table[:whole], radius, chiral, schema)
            held, rows = table[whole:].to_batches(), rows - whole
    if rows:
        yield from _graphs(pa.Table.from_batches(held).combine_chunks(), radius, chiral, schema)


def _aligned(part, schema: pa.Schema):
    """The columns of ``schema``, those that ``part`` lacks as nulls."""
    rows = part.num_rows
    columns = [part[f.name].cast(f.type) if f.name in part.schema.names else pa.nulls(rows, f.type) for f in schema]
    yield from pa.table(columns, schema=schema).combine_chunks().to_batches()


def _codes(values) -> tuple[pa.Array, np.ndarray]:
    """The distinct values and the place of each value among them, -1 for null."""
    found = (values if isinstance(values, pa.Array) else pa.array(values)).dictionary_encode()
    return found.dictionary, found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, places = _codes(values)
    return found.to_numpy(zero_copy_only=False), places


def _hashed(texts) -> np.ndarray:
    """60 bits of each text's md5."""
    return (np.frombuffer(b"".join(md5(t).digest() for t in texts), ">u8")[::2] >> np.uint64(4)).astype(np.int64)


def _graphs(table: pa.Table, radius: int, chiral: bool, schema: pa.Schema):
    first = table["_k"].to_numpy() == 1
    graph, own = np.cumsum(first) - 1, table["_own"].to_numpy()
    rows = table.num_rows
    ids, places = _codes(pa.concat_arrays([c for n in ("src", "dst") for c in table[n].chunks]))
    src, dst = places[:rows], places[rows:]
    at = np.flatnonzero(own)
    # Null ids are no one's neighbours.
    keys = np.where(src[at] < 0, -2 - np.arange(len(at)), graph[at] * len(ids) + src[at])
    if len(_distinct(keys)[0]) < len(keys):
        _, places = _distinct(keys)
        twice = np.unique(graph[at][np.bincount(places)[places] > 1])
        apart = np.isin(graph, twice)
        yield from _aligned(table.filter(pa.array(apart)), schema)
        if not apart.all():
            yield from _graphs(table.filter(pa.array(~apart)).combine_chunks(), radius, chiral, schema)
        return

    def node(codes: np.ndarray) -> np.ndarray:
        wanted = pa.array(np.where(codes[~own] < 0, -1, graph[~own] * len(ids) + codes[~own]))
        return pc.index_in(wanted, value_set=pa.array(keys)).fill_null(-1).to_numpy(zero_copy_only=False)

    words, text = _codes(pa.concat_arrays(table["text"].chunks))
    words = [w.encode() for w in words.to_pylist()]
    label = np.append(_hashed(words), -1)[text[at]]
    bond, start, end = text[~own], node(src), node(dst)
    kept, joined = start >= 0, (start >= 0) & (end >= 0)
    found = label_rounds(label, bond[joined], words, start[joined], end[joined], radius)
    if chiral and radius:
        order = np.empty(len(ids), np.int64)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        ranks = np.append(order, -1)[dst[~own][kept]]
        marks = handedness(found[-1], table["_hand"].to_numpy()[at], start[kept], end[kept], ranks)
        found = label_rounds(label, bond[joined], words, start[joined], end[joined], radius, marks)
    counts = np.bincount(graph[at], minlength=int(first.sum()))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    lists = {"_nodes": table["src"].take(pa.array(at)).combine_chunks()} | {f"_l{i}": pa.array(l, mask=l < 0) for i, l in enumerate(found)}
    done = {schema.names[0]: table[schema.names[0]].filter(pa.array(first))}
    done |= {n: pa.ListArray.from_arrays(offsets, v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v) for n, v in lists.items()}
    done["_whole"] = pa.array(np.ones(len(counts), bool))
    yield from _aligned(pa.table(done).filter(pa.array(counts > 0)), schema)


def label_rounds(label: np.ndarray, bond: np.ndarray, words: list[bytes], src: np.ndarray, dst: np.ndarray, radius: int, marks: np.ndarray | None = None) -> list[np.ndarray]:
    """Labels after rounds 0..radius, -1 for null.  ``bond`` are places in ``words``; equal texts are hashed once."""
    rounds = [label]
    for step in range(radius):
        values, code = _distinct(label)
        one, other = code[src], code[dst]
        use = (label[dst] >= 0) & (bond >= 0)
        keys, at = _distinct(other[use] * len(words) + bond[use])
        told = _hashed([b"%d/%s" % (v, words[w]) for v, w in zip(values[keys // max(len(words), 1)].tolist(), (keys % max(len(words), 1)).tolist())])
        sums = np.zeros(len(label), np.uint64)
        np.add.at(sums, src[use], told[at].astype(np.uint64))  # modulo 2^64, of which 60 bits stay
        totals, total = _distinct((sums & MASK).astype(np.int64))
        mark = marks if step == 0 and marks is not None else np.zeros(len(label), np.int64)
        known = label >= 0
        keys, at = _distinct((code[known] * len(totals) + total[known]) * 3 + mark[known])
        pairs = keys // 3
        parts = zip(values[pairs // max(len(totals), 1)].tolist(), totals[pairs % max(len(totals), 1)].tolist(), (keys % 3).tolist())
        new = np.full(len(label), -1, np.int64)
        new[known] = _hashed([b"%d(%d)%s" % (v, t, (b"", b"+", b"-")[m]) for v, t, m in parts])[at]
        if step + 1 < radius:
            # Of two ends the lesser and the greater one; a null end counts as the other one.
            one, other = np.where(label[src] < 0, other, one), np.where(label[dst] < 0, one, other)
            least = np.where(values[one] <= values[other], one, other)
            use = (values[one] >= 0) & (bond >= 0) if len(values) else np.zeros(0, bool)
            keys, at = _distinct(((least * len(values) + one + other - least) * len(words) + bond)[use])
            ends, old = keys // max(len(words), 1), (keys % max(len(words), 1)).tolist()
            parts = zip(values[ends // max(len(values), 1)].tolist(), values[ends % max(len(values), 1)].tolist(), old)
            words = [b"%d" % h for h in _hashed([b"%d~%d/%s" % (a, b, words[w]) for a, b, w in parts]).tolist()]
            bond = np.full(len(bond), -1, np.int64)
            bond[use] = at
        rounds.append(new)
        label = new
    return rounds


def handedness(label: np.ndarray, hand: np.ndarray, src: np.ndarray, dst: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """1 for left, 2 for right, 0 for none, by the rule of :func:`solvane.operators.graph.chiral_marks`; ``ranks`` order ``dst``."""
    degrees = np.bincount(src, minlength=len(label))[src]
    use = (hand[src] != 0) & (degrees >= 3) & (degrees <= 4) & (dst >= 0)
    src, dst, ranks = src[use], dst[use], ranks[use]
    order = np.lexsort((ranks, src))
    src, dst = src[order], dst[order]
    counts = np.bincount(src, minlength=len(label))
    others = np.full((len(label), 4), -1, np.int64)
    others[src, np.arange(len(src)) - (np.cumsum(counts) - counts)[src]] = label[dst]
    exchanges, equal = np.zeros(len(label), np.int64), np.zeros(len(label), bool)
    for i in range(4):
        for j in range(i + 1, 4):
            a, b = others[:, i], others[:, j]
            exchanges += (j < counts) & (a >= 0) & (b >= 0) & (a > b)
            equal |= (j < counts) & (a == b)
    return np.where((counts == 0) | equal, 0, np.where((hand > 0) == (exchanges % 2 == 0), 1, 2))
