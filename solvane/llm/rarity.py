"""Digests of improbable features: byte windows of rare entropy in chained Bloom filters.

A feature is a window of 64 bytes. Its rarity comes from the entropy of its bytes: the fewer windows of the corpus have
that (quantised) entropy, the rarer it is. In every run of 64 successive windows the rarest one, leftmost in a tie, gets
a point, and windows with enough points are selected, so that an edit changes only the selection around it. Selected
features go into Bloom filters of 2048 bits, 160 to a filter, in the order of the text. Two digests are compared by the
overlap of their filters, normalised between the overlap expected by chance and the largest one possible.
"""

from __future__ import annotations

import numpy as np

WIDTH = 64  # bytes of a window
RUN = 64  # windows among which the rarest is sought
POINTS = 16
LEVELS = 1001  # of quantised entropy
LOWEST = 100  # windows of less than a tenth of the largest entropy say nothing
BITS, EACH, PER_FILTER = 2048, 5, 160
SCALE = 1 << 16
NEVER = LEVELS + 1
PLOGP = np.concatenate([[0], np.rint(SCALE * np.arange(1, WIDTH + 2) * np.log2(np.arange(1, WIDTH + 2))).astype(np.int64)])
MOST = int(PLOGP[WIDTH])  # the sum of a window of one byte value


def levels_of(sums: np.ndarray) -> np.ndarray:
    return (MOST - sums) * (LEVELS - 1) // MOST


def window_levels(data: np.ndarray) -> np.ndarray:
    """Quantised entropy of every window of ``data``; lanes slide over equal parts of it in lockstep."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    steps = int(min(max(n, 1), 512))
    lanes = -(-n // steps)
    padded = np.zeros(lanes * steps + WIDTH, np.uint8)
    padded[: len(data)] = data
    at = np.arange(lanes) * steps
    base = np.arange(lanes) * 256
    counts = np.zeros(lanes * 256, np.int8)
    for i in range(WIDTH):
        increment(counts, base + padded[at + i])
    sums = PLOGP.take(counts.reshape(lanes, 256)).sum(axis=1)
    out = np.empty((steps, lanes), np.int16)
    up, down = np.diff(PLOGP), -np.diff(PLOGP, prepend=0)
    for i in range(steps):
        out[i] = levels_of(sums)
        if i + 1 == steps:
            break
        leaving = base + padded[at + i]
        c = counts.take(leaving)
        sums += down.take(c)
        counts[leaving] = c - 1
        entering = base + padded[at + i + WIDTH]
        c = counts.take(entering)
        sums += up.take(c)
        counts[entering] = c + 1
    return out.T.reshape(-1)[:n]


def increment(counts: np.ndarray, at: np.ndarray) -> None:
    counts[at] = counts.take(at) + 1  # a lane appears once


def level_histogram(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of all windows that lie inside a text have each level."""
    sizes = np.diff(bounds)
    own = np.maximum(sizes - WIDTH + 1, 0)
    inside = np.repeat(np.tile([True, False], len(sizes)), np.stack([own, sizes - own], axis=1).reshape(-1))
    levels = window_levels(data)
    return np.bincount(levels[inside[: len(levels)]], minlength=LEVELS)


def ranks_of(histogram: np.ndarray) -> np.ndarray:
    """Rank of each level, 0 for the rarest; levels that say nothing are never selected."""
    order = np.lexsort((np.arange(LEVELS), histogram))
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    rank[:LOWEST] = NEVER
    return rank


def select(rank: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions of the selected windows; text i has the windows ``bounds[i]`` to ``bounds[i + 1]``."""
    n = len(rank)
    if not n:
        return np.zeros(0, np.int64)
    sizes = np.diff(bounds)
    key = rank.astype(np.int64) << 40 | np.arange(n)
    best, width = key, 1
    while width < RUN and len(best) > width:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    text = np.repeat(np.arange(len(sizes)), sizes)
    points = np.zeros(n, np.int64)
    if width == RUN:
        whole = np.arange(len(best)) + RUN <= bounds[1:][text[: len(best)]]
        points += np.bincount(best[whole] & (1 << 40) - 1, minlength=n)
    short = np.flatnonzero((sizes > 0) & (sizes < RUN))
    if len(short):
        spans = np.stack([bounds[short], bounds[short + 1]], axis=1).reshape(-1)
        lowest = np.minimum.reduceat(np.append(key, np.iinfo(np.int64).max), spans)[::2]
        points[lowest & (1 << 40) - 1] += 1
    needed = np.clip(sizes - RUN + 1, 1, POINTS)
    return np.flatnonzero((points >= needed[text]) & (rank < NEVER))


def mixed(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of eight 64-bit words."""
    out = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words.shape[1]):
            out = (out ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out = out * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return out


def digests(data: np.ndarray, bounds: np.ndarray, rank: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters (a row of bits packed into 256 bytes each) of all texts in a row, and where each text's begin.

    ``rank`` holds the ranks of the texts' windows, text i's from ``windows[i]`` on. A text without a window to select
    is one feature as a whole; an empty text has no filter.
    """
    at = select(rank, windows)
    text = np.searchsorted(windows, at, side="right") - 1
    views = np.lib.stride_tricks.sliding_window_view(data, WIDTH) if len(data) >= WIDTH else np.zeros((0, WIDTH), np.uint8)
    places = bounds[text] + at - windows[text]
    hashes = mixed(np.ascontiguousarray(views[places]).view(np.uint64).reshape(len(places), -1)) if len(places) else np.zeros(0, np.uint64)
    found = np.zeros(len(bounds) - 1, bool)
    found[text] = True
    alone = np.flatnonzero(~found & (np.diff(bounds) > 0))
    if len(alone):
        import xxhash

        whole = np.array([xxhash.xxh64_intdigest(data[bounds[i] : bounds[i + 1]].tobytes()) for i in alone], np.uint64)
        text, hashes = np.concatenate([text, alone]), np.concatenate([hashes, whole])
        order = np.argsort(text, kind="stable")
        text, hashes = text[order], hashes[order]
    # a feature counts once in a text, where it stands first
    order = np.lexsort((np.arange(len(text)), hashes, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    kept = np.sort(order[new])
    text, hashes = text[kept], hashes[kept]
    sizes = np.bincount(text, minlength=len(bounds) - 1)
    filters = -(-sizes // PER_FILTER)
    begin = np.concatenate([[0], np.cumsum(filters)])
    number = np.arange(len(text)) - (np.cumsum(sizes) - sizes)[text]
    row = begin[:-1][text] + number // PER_FILTER
    bits = np.zeros((begin[-1], BITS), bool)
    for i in range(EACH):
        bits[row, (hashes >> np.uint64(11 * i) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1), begin


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised overlap of filters (last axis: bytes)."""
    both = np.bitwise_count(a & b).sum(axis=-1, dtype=np.int64)
    one, two = np.bitwise_count(a).sum(axis=-1, dtype=np.int64), np.bitwise_count(b).sum(axis=-1, dtype=np.int64)
    chance, most = one * two / BITS, np.minimum(one, two)
    return np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """For each filter of the shorter chain its best overlap in the other, on average. Two empty chains are alike."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    best = np.zeros(len(a))
    for low in range(0, len(b), 64):  # a bounded part of the longer chain at a time
        for i in range(0, len(a), 64):
            best[i : i + 64] = np.maximum(best[i : i + 64], overlap(a[i : i + 64, None], b[None, low : low + 64]).max(axis=1))
    return float(best.mean())


def likenesses(a: np.ndarray, a_begin: np.ndarray, b: np.ndarray, b_begin: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of text i's chain in ``a`` and text ``of[i]``'s in ``b``."""
    out = np.zeros(len(of))
    ones = (np.diff(a_begin) == 1) & (np.diff(b_begin)[of] == 1)
    out[ones] = overlap(a[a_begin[:-1][ones]], b[b_begin[:-1][of[ones]]])
    for i in np.flatnonzero(~ones).tolist():
        out[i] = likeness(a[a_begin[i] : a_begin[i + 1]], b[b_begin[of[i]] : b_begin[of[i] + 1]])
    return out
