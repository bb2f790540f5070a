"""A compressed quadtree over a grid of terms and documents whose cells store the largest impact inside them.

Rows are terms, columns are documents in ascending order of id, sixteen of which make a range. Rows are cut into bands as
high as the grid has ranges, so that each band is a square, and squares are halved in both directions down to one term and one
range. A level stores, for its cells that hold anything, the largest impact and a mask of the quadrants that hold anything; a
cell's children follow those of the cells before it, so that the number of mask bits before tells where a child is. The
lowest cells list their documents and impacts.

A search takes many items at once. An item stands in a range of documents with one cell for each of its terms: the paths of its
rows descend together. What the cells' maxima allow at most bounds the score of every document in the range. The ranges
with the highest bounds are halved first; ranges that can't reach the item's worst result so far are dropped; in the
lowest ranges scores are exact.
"""

from __future__ import annotations

import numpy as np

from solvane.llm.words import starts_of, take_ragged

RANGE = 16  # documents of a lowest range
AT_ONCE = 16  # ranges of an item that are halved at once, those with the highest bounds
BITS = np.array([[bin(mask & ((1 << q) - 1)).count("1") for q in range(4)] for mask in range(16)], np.int8)  # set bits before quadrant q


def morton(rows: np.ndarray, columns: np.ndarray, bits: int) -> np.ndarray:
    """The bits of rows and columns in turn, the row's first."""
    out = np.zeros(len(rows), np.int64)
    for k in range(bits):
        out |= ((rows >> k) & 1) << (2 * k + 1) | ((columns >> k) & 1) << (2 * k)
    return out


class Treap:
    """Built from cells (term row, document column, impact); ``depth`` halvings lead from a band to one term and one range."""

    ARRAYS = ("bands", "maxima", "masks", "sizes", "starts", "columns", "impacts")

    def __init__(self, documents: int, **arrays: np.ndarray):
        self.depth = max(int(documents - 1) // RANGE, 0).bit_length()
        self.documents = documents
        self.arrays = arrays
        bounds = starts_of(arrays["sizes"])
        self.maxima = [arrays["maxima"][a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        inner = bounds[-2] if len(bounds) > 1 else 0
        self.masks = [arrays["masks"][a:b] for a, b in zip(bounds, bounds[1:-1], strict=False)]
        assert len(arrays["masks"]) == inner
        counts = [BITS[m, 3] + (m >> 3) for m in self.masks]
        self.children = [starts_of(c)[:-1] for c in counts]
        self.starts, self.columns, self.impacts = starts_of(arrays["starts"]), arrays["columns"], arrays["impacts"]
        self.bands = arrays["bands"]

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, documents: int) -> Treap:
        depth = max(int(documents - 1) // RANGE, 0).bit_length()
        side = 1 << depth
        codes = (rows >> depth << (2 * depth)) | morton(rows & (side - 1), columns // RANGE, depth)
        order = np.lexsort((columns, codes))
        codes, columns, impacts = codes[order], columns[order], impacts[order]
        heads = np.flatnonzero(np.diff(codes, prepend=-1))
        starts = np.diff(np.append(heads, len(codes)))
        codes, best = codes[heads], np.maximum.reduceat(impacts, heads) if len(heads) else impacts[:0]
        maxima, masks = [best], []
        for _ in range(depth):
            heads = np.flatnonzero(np.diff(codes >> 2, prepend=-1))
            masks.append(np.bitwise_or.reduceat(1 << (codes & 3), heads).astype(np.uint8) if len(heads) else np.zeros(0, np.uint8))
            maxima.append(np.maximum.reduceat(maxima[-1], heads) if len(heads) else best[:0])
            codes = codes[heads] >> 2
        return cls(
            documents,
            bands=codes.astype(np.int32),
            maxima=np.concatenate(maxima[::-1]).astype(np.int32),
            masks=np.concatenate([np.zeros(0, np.uint8), *masks[::-1]]),
            sizes=np.array([len(m) for m in maxima[::-1]], np.int64),
            starts=starts.astype(np.int32),
            columns=columns.astype(np.int32),
            impacts=impacts.astype(np.int32),
        )

    def roots(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row's band, and which rows have one."""
        at = np.searchsorted(self.bands, rows >> self.depth)
        there = at < len(self.bands)
        there[there] = self.bands[at[there]] == (rows >> self.depth)[there]
        return at, there

    def down(self, level: int, cells: np.ndarray, rows: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells one level below, in the left (0) or right (1) half of the documents, and which of them exist."""
        quadrant = ((rows >> (self.depth - 1 - level)) & 1) << 1 | half
        mask = self.masks[level][cells]
        return self.children[level][cells] + BITS[mask, quadrant], (mask >> quadrant & 1).astype(bool)


class Best:
    """The ``most`` best documents of each item so far, by score and then by ascending id."""

    def __init__(self, items: int, most: int):
        self.items, self.most = items, most
        self.item, self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.bar = np.ones(items, np.int64)  # a score that still counts must reach this
        self.last = np.full(items, np.iinfo(np.int64).max)  # with exactly that score, a document's id must not lie behind this

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        doc, null = np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        order = np.lexsort((doc, null, -score, item))
        sorted_items = item[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_items, sorted_items)
        order, rank = order[rank < self.most], rank[rank < self.most]
        self.item, self.score, self.doc, self.null = item[order], score[order], doc[order], null[order]
        full = rank == self.most - 1
        self.bar[self.item[full]] = self.score[full]
        self.last[self.item[full]] = np.where(self.null[full], np.iinfo(np.int64).max, self.doc[full])


def search(treap: Treap, item: np.ndarray, row: np.ndarray, weight: np.ndarray, doc: np.ndarray, null: np.ndarray, best: Best) -> None:
    """Put into ``best`` what the grid has for the items; (item, row, weight) are their terms, sorted by item.

    ``doc`` and ``null`` are the documents' ids, ascending, and which are null (they come last).
    """
    cells, there = treap.roots(row)
    item, row, weight, cells = item[there], row[there], weight[there], cells[there]
    if not len(item):
        return
    heads = np.flatnonzero(np.diff(item, prepend=-1))
    bound = np.add.reduceat(weight * treap.maxima[0][cells], heads)
    # open ranges, and their terms one after another
    e_item, e_level, e_range, e_bound, e_size = item[heads], np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64), bound, np.diff(np.append(heads, len(item)))
    terms = np.stack([row, weight, cells])
    while len(e_item):
        first = e_range << (treap.depth - e_level)  # the first lowest range inside
        low = doc[np.minimum(first * RANGE, len(doc) - 1)]
        bar = best.bar[e_item]
        open_ = (e_bound > bar) | (e_bound == bar) & (low <= best.last[e_item])
        order = np.lexsort((first, -e_bound, e_item))
        order = order[open_[order]]
        if not len(order):
            return
        rank = np.arange(len(order)) - np.searchsorted(e_item[order], e_item[order])
        now, later = order[rank < AT_ONCE], order[rank >= AT_ONCE]
        starts = starts_of(e_size)
        kept = [[x[later] for x in (e_item, e_level, e_range, e_bound, e_size)] + [_take(terms, starts, later)]]
        for level in np.unique(e_level[now]).tolist():
            some = now[e_level[now] == level]
            own, sizes = _take(terms, starts, some), e_size[some]
            of = np.repeat(np.arange(len(some)), sizes)
            if level == treap.depth:
                _score(treap, some, of, own, e_item, e_range, doc, null, best)
                continue
            for half in (0, 1):
                below, there = treap.down(level, own[2], own[0], half)
                held, count = of[there], np.bincount(of[there], minlength=len(some))
                inside = np.stack([own[0][there], own[1][there], below[there]])
                bound = np.bincount(held, inside[1] * treap.maxima[level + 1][inside[2]], minlength=len(some)).astype(np.int64)
                full = count > 0
                kept.append([e_item[some][full], np.full(int(full.sum()), level + 1), (e_range[some][full] << 1) | half, bound[full], count[full], inside])
        e_item, e_level, e_range, e_bound, e_size = (np.concatenate([k[i] for k in kept]) for i in range(5))
        terms = np.concatenate([k[5] for k in kept], axis=1)


def _take(terms: np.ndarray, starts: np.ndarray, picks: np.ndarray) -> np.ndarray:
    lengths = np.diff(starts)[picks]
    at = np.repeat(starts[picks] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    return terms[:, at]


def _score(treap: Treap, some: np.ndarray, of: np.ndarray, own: np.ndarray, e_item: np.ndarray, e_range: np.ndarray, doc: np.ndarray, null: np.ndarray, best: Best) -> None:
    """Exact scores in lowest ranges: every document that the cells list."""
    at, counts = take_ragged(np.arange(len(treap.columns)), treap.starts, own[2])
    place = np.repeat(of, counts) * RANGE + treap.columns[at] % RANGE
    scores = np.bincount(place, np.repeat(own[1], counts) * treap.impacts[at].astype(np.int64), minlength=len(some) * RANGE).astype(np.int64)
    places = np.flatnonzero(scores > 0)
    entry = some[places // RANGE]
    column = e_range[entry] * RANGE + places % RANGE
    best.add(e_item[entry], scores[places], doc[column], null[column])
