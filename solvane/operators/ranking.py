"""Global ranks without sorting a whole table in one task.

Most uses of a rank only ask on which side of a few cut-offs a row lies
(exact-size splits, folds, slices, quantile edges).  For those
:func:`keys_at_ranks` finds the exact keys at the cut-off ranks: a sample of
the keys gives splitters around each rank, the rows before every splitter are
counted exactly, and only the rows between the nearest splitters go on.  The
keys may be of any type that can be ordered, with infinite and equal values,
and the rows are then labelled by comparing with literals: no shuffle of the
rows themselves.  :func:`global_rank` numbers every row where a number per row
is the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvane.functions.hashing import as_column
from solvane.storage import cut

# Key rows between two splitters that are few enough to be put in order.
FEW = 100_000
# Keys that a round samples.
SAMPLE = 10_000


def keys_at_ranks(df: DataFrame, keys: Sequence[str], ranks: Sequence[int], rows: int | None = None) -> dict[int, tuple]:
    """Exact key tuples at the given 0-based ranks of ``df`` ordered by ``keys``.

    No key may be null.  Ranks at or beyond the row count are left out of the
    answer.  ``rows`` saves a count where the caller knows it.
    """
    keys = list(keys)
    df = df.select(*keys)
    if rows is None and ranks:
        rows = df.count()
    open_ranks = sorted({r for r in ranks if 0 <= r < rows})
    found, splitters, turn = {}, [], 0
    while open_ranks:
        gaps = _gaps(open_ranks, splitters, rows)
        wide = {gap: inside for gap, inside in gaps.items() if gap[3] - gap[2] > FEW}
        if not wide:
            found.update(_in_order(df, keys, gaps))
            break
        chosen = _splitters(df, keys, wide, turn)
        splitters = sorted([*splitters, *_counted(df, keys, chosen)], key=lambda s: (s[0], s[1]))
        for rank in list(open_ranks):
            exact = next((key for before, upto, key in splitters if before <= rank < upto), None)
            if exact is not None:
                found[rank] = exact
                open_ranks.remove(rank)
        turn += 1
    return found


def _gaps(ranks: Sequence[int], splitters: Sequence[tuple], rows: int) -> dict[tuple, list[int]]:
    """Ranks by the gap (key below, key above, first rank, rank after the last) between the splitters that enclose them.

    A splitter is (rows before its key, rows up to its key, key).
    """
    gaps = {}
    for rank in ranks:
        below = max((s for s in splitters if s[1] <= rank), default=(0, 0, None), key=lambda s: s[1])
        above = min((s for s in splitters if s[0] > rank), default=(rows, rows, None), key=lambda s: s[0])
        gaps.setdefault((below[2], above[2], below[1], above[0]), []).append(rank)
    return gaps


def _inside(keys: Sequence[str], gap: tuple) -> Column:
    """True for the keys strictly between those of the gap."""
    after = F.lit(True) if gap[0] is None else ~upto_key(keys, gap[0])
    return after & before_key(keys, gap[1])


def _number(keys: Sequence[str], gaps: Sequence[tuple]) -> Column:
    number = F.lit(None).cast("int")
    for i, gap in enumerate(gaps):
        number = F.when(_inside(keys, gap), F.lit(i)).otherwise(number)
    return number


def _splitters(df: DataFrame, keys: list[str], gaps: dict[tuple, list[int]], turn: int) -> set[tuple]:
    """Keys just before and just behind where the wanted ranks should lie, by a sample of each gap's rows."""
    rows = sum(gap[3] - gap[2] for gap in gaps)
    numbered = df.withColumn("_gap", _number(keys, list(gaps))).filter("_gap is not null")
    sample = numbered.sample(min(1.0, SAMPLE / rows), seed=turn).orderBy("_gap", *keys).collect()
    chosen = set()
    for i, (gap, ranks) in enumerate(gaps.items()):
        own = [tuple(row[k] for k in keys) for row in sample if row["_gap"] == i]
        for rank in ranks if own else []:
            share = (rank - gap[2] + 0.5) / (gap[3] - gap[2])
            reach = 2 + 4 * math.sqrt(len(own) * share * (1 - share))
            for place in (share * len(own) - reach, share * len(own), share * len(own) + reach):
                chosen.add(own[min(max(int(place), 0), len(own) - 1)])
    return chosen


def _counted(df: DataFrame, keys: list[str], chosen: set[tuple]) -> list[tuple]:
    """(rows before, rows up to, key) for each key, in one pass over the key columns."""
    chosen = list(chosen)
    if not chosen:
        return []
    counts = [F.count_if(condition(keys, key)) for key in chosen for condition in (before_key, upto_key)]
    row = df.agg(*(c.alias(f"_{i}") for i, c in enumerate(counts))).first()
    return [(row[2 * i], row[2 * i + 1], key) for i, key in enumerate(chosen)]


def _in_order(df: DataFrame, keys: list[str], gaps: dict[tuple, list[int]]) -> dict[int, tuple]:
    """The keys at the wanted ranks of gaps of few rows, each put in order in a task."""
    wanted = F.lit(False)
    for i, (gap, ranks) in enumerate(gaps.items()):
        wanted = wanted | ((F.col("_gap") == i) & F.col("_rank").isin([r - gap[2] for r in ranks]))
    numbered = df.withColumn("_gap", _number(keys, list(gaps))).filter("_gap is not null")
    ranked = numbered.withColumn("_rank", F.row_number().over(Window.partitionBy("_gap").orderBy(*keys)) - 1)
    starts = [gap[2] for gap in gaps]
    return {row["_rank"] + starts[row["_gap"]]: tuple(row[k] for k in keys) for row in ranked.filter(wanted).collect()}


def before_key(keys: Sequence[str | Column], cutoff: tuple | None) -> Column:
    """True where ``keys`` sort strictly before ``cutoff``; without a cut-off always true."""
    return F.lit(True) if cutoff is None else _compared(keys, cutoff, F.lit(False))


def upto_key(keys: Sequence[str | Column], cutoff: tuple) -> Column:
    """True where ``keys`` sort before ``cutoff`` or equal it."""
    return _compared(keys, cutoff, F.lit(True))


def _compared(keys: Sequence[str | Column], cutoff: tuple, if_equal: Column) -> Column:
    condition = if_equal
    for key, value in reversed(list(zip(keys, cutoff))):
        column = as_column(key)
        condition = (column < F.lit(value)) | ((column == F.lit(value)) & condition)
    return condition


def global_rank(df: DataFrame, keys: Sequence[str], name: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row in the order of ``keys`` as a bigint.

    The table is range-sorted over the cluster and written once; the rank is
    then the rows in earlier partitions plus the position in this one.
    ``keys`` should be unique, so that no range holds more than its share.
    """
    ordered = cut(df.orderBy(*keys).withColumn("_rank_at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_rank_part", F.shiftrightunsigned("_rank_at", 33))
    sizes = ordered.groupBy("_rank_part").agg(F.count("*").alias("_rank_n"))
    earlier = Window.orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort, so this side is small whatever the data size.
    offsets = sizes.select("_rank_part", F.coalesce(F.sum("_rank_n").over(earlier), F.lit(0)).alias("_rank_offset"))
    position = F.col("_rank_at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ordered.join(F.broadcast(offsets), "_rank_part")
    return ranked.withColumn(name, F.col("_rank_offset") + position).drop("_rank_at", "_rank_part", "_rank_offset")


def series_position(df: DataFrame, group: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """0-based position inside each group; a group may be larger than a task can hold."""
    ranked = global_rank(df, [group, *order], "_rank")
    starts = ranked.groupBy(group).agg(F.min("_rank").alias("_start"))
    return ranked.join(starts, group).withColumn(name, F.col("_rank") - F.col("_start")).drop("_rank", "_start")
