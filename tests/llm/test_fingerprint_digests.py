"""Digests and likeness of documents against a plain version, window by window."""

import hashlib
import math
import random
from collections import Counter

import pytest
import xxhash

from solvane.llm import fingerprints, rarity

WIDTH, RUN, POINTS, LOWEST = 64, 64, 16, 100
BITS, EACH, PER_FILTER = 2048, 5, 160


def level(window):
    """Entropy of the bytes, from 0 to 1000 thousandths of the largest, by rounded sums of n log n."""
    sums = sum(round(65536 * n * math.log2(n)) for n in Counter(window).values())
    most = round(65536 * WIDTH * math.log2(WIDTH))
    return (most - sums) * 1000 // most


def windows(text):
    return [text[i : i + WIDTH] for i in range(len(text) - WIDTH + 1)]


def selected(text, rank):
    """Positions of the windows that are rarest, leftmost, in enough runs of 64."""
    ranks = [rank(level(w)) for w in windows(text)]
    points = Counter()
    for low in range(max(1, len(ranks) - RUN + 1) if ranks else 0):
        run = range(low, min(low + RUN, len(ranks)))
        points[min(run, key=lambda i: (ranks[i], i))] += 1
    needed = min(max(len(ranks) - RUN + 1, 1), POINTS)
    return [i for i in sorted(points) if points[i] >= needed and ranks[i] < math.inf]


def mixed(window):
    out, mask = 0, (1 << 64) - 1
    for j in range(0, WIDTH, 8):
        out = ((out ^ int.from_bytes(window[j : j + 8], "little")) * 0x9E3779B97F4A7C15) & mask
        out ^= out >> 29
        out = out * 0xBF58476D1CE4E5B9 & mask
        out ^= out >> 32
    return out


def chain(text, rank):
    """The Bloom filters as sets of bit numbers."""
    hashes = [mixed(text[i : i + WIDTH]) for i in selected(text, rank)] or ([xxhash.xxh64_intdigest(text)] if text else [])
    hashes = list(dict.fromkeys(hashes))
    return [{h >> 11 * e & BITS - 1 for h in hashes[i : i + PER_FILTER] for e in range(EACH)} for i in range(0, len(hashes), PER_FILTER)]


def as_hex(filters):
    return "".join(bytes(sum(128 >> i for i in range(8) if 8 * byte + i in f) for byte in range(BITS // 8)).hex() for f in filters)


def alike(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)

    def overlap(x, y):
        chance, most = len(x) * len(y) / BITS, min(len(x), len(y))
        return min(1.0, max(0.0, (len(x & y) - chance) / max(most - chance, 1e-9)))

    return sum(max(overlap(x, y) for y in b) for x in a) / len(a)


def corpus():
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdefghijklmnoprstuvwé ") for _ in range(draw.randint(2, 9))) for _ in range(200)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([0, 3, 15, 40, 150]))) for _ in range(25)]
    texts += [texts[4], texts[4][:-7] + "changed", "x" * 300, "", None, "ab" * 40, "漢字 " * 60, " ".join(draw.choice(words) for _ in range(2600)), "short", "short"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def plain():
    rows = corpus()
    data = [(t or "") for _, t in rows]
    histogram = Counter(level(w) for t in data for w in windows(t.encode()))
    order = sorted(range(rarity.LEVELS), key=lambda v: (histogram[v], v))
    place = {v: i for i, v in enumerate(order)}

    def rank(v):
        return place[v] if v >= LOWEST else math.inf

    out = []
    for i, (key, _) in enumerate(rows):
        own, follows = data[i], data[(i + 1) % len(data)]
        half = len(own) // 2
        edited = own[: len(own) - half] + follows[:half]
        a, b, c = (chain(t.encode(), rank) for t in (own, edited, follows))
        out.append((key, len(own), hashlib.sha256(edited.encode()).hexdigest(), as_hex(a), as_hex(b), round(alike(a, b), 9), round(alike(a, c), 9)))
    return rows, out


@pytest.mark.parametrize("ranges", [1, 6])
def test_digests_and_likeness(spark, plain, ranges):
    rows, expected = plain
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id bigint, text string, at string, fingerprint string").repartition(4)
    found = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, fingerprints.fingerprints(df, ranges=ranges).collect())]
    assert sorted(found) == sorted(expected)
    near = {r[0]: r for r in expected}
    assert near[4][3] == near[25][3] and near[25][6] > 0.5  # a copy, and a copy with its end changed
    assert len(near[32][3]) > BITS // 4 and near[28][3] == ""
