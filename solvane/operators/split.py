"""Exact-size, stratified and k-fold splits that do not depend on the partitioning.

Rows are ordered by a hash of (seed, id).  A split is decided by comparing each
row's hash with the hash at the wanted rank, so labelling a table is a map over
its rows; only key columns are read to find the ranks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvane.functions.hashing import HASH_RANGE, as_column, hash32
from solvane.operators.binning import equal_width_bin
from solvane.operators.ranking import before_key, global_rank, keys_at_ranks
from solvane.storage import broadcast_if_small, cut

# Rows wanted in a hash range of a stratum that is put in order.
RANGE_ROWS = 50_000


def _shuffled(df: DataFrame, id_col: str, seed: int | None) -> tuple[DataFrame, list[str], list[Column]]:
    """Key table, its key names, and the same keys as expressions over ``df``."""
    if seed is None:
        return df.select(id_col), [id_col], [F.col(id_col)]
    keys = df.select(hash32(seed, id_col).alias("_hash"), id_col)
    return keys, ["_hash", id_col], [hash32(seed, id_col), F.col(id_col)]


def label_by_rank(df: DataFrame, id_col: str, sizes: Sequence[int], labels: Sequence, seed: int | None, column: str, rows: int | None = None) -> DataFrame:
    """Give the first ``sizes[0]`` rows ``labels[0]`` and so on; the rest gets the label after them or null."""
    keys, names, expressions = _shuffled(df, id_col, seed)
    bounds, total = [], 0
    for size in sizes:
        total += size
        bounds.append(total)
    cutoffs = keys_at_ranks(keys, names, bounds, rows)
    label = F.lit(labels[len(sizes)]) if len(labels) > len(sizes) else F.lit(None)
    for bound, value in reversed(list(zip(bounds, labels))):
        label = F.when(before_key(expressions, cutoffs.get(bound)), F.lit(value)).otherwise(label)
    return df.withColumn(column, label)


def resolve_sizes(total: int, sizes: Sequence[int | None]) -> tuple[int, int, int]:
    """Fill in the first of (train, val, test) that is not given."""
    resolved = list(sizes)
    for i, size in enumerate(resolved):
        if not size:
            resolved[i] = total - sum(s for j, s in enumerate(resolved) if j != i)
            break
    train, val, test = resolved
    if train < 0 or val < 0 or train + val > total:
        raise ValueError(f"sizes {list(sizes)} do not fit {total} rows")
    return train, val, test


def split_by_size(df: DataFrame, id_col: str, sizes: Sequence[int | None], seed: int, column: str = "ml_phase") -> DataFrame:
    """Random train and val of exact size; everything else is test."""
    total = df.count()
    train, val, _ = resolve_sizes(total, sizes)
    return label_by_rank(df, id_col, [train, val], ["train", "val", "test"], seed, column, total)


def split_by_column(df: DataFrame, column: str = "ml_phase") -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(df.filter(F.col(column) == phase) for phase in ("train", "val", "test"))


def random_subset(df: DataFrame, id_col: str, sizes: Sequence[int], seed: int = 0, column: str = "ml_phase") -> DataFrame:
    """Draw train, val and test of exact sizes; other rows are left out."""
    total = df.count()
    if sum(sizes) > total:
        raise ValueError(f"sizes {list(sizes)} do not fit {total} rows")
    labelled = label_by_rank(df, id_col, sizes, ["train", "val", "test"], seed, column, total)
    return labelled.filter(F.col(column).isNotNull())


def hold_out(df: DataFrame, id_col: str, fraction: float, seed: int, column: str = "ml_phase") -> DataFrame:
    """Label ceil(fraction * n) random rows val, the others train; uses seed + 1."""
    total = df.count()
    return label_by_rank(df, id_col, [math.ceil(fraction * total)], ["val", "train"], seed + 1, column, total)


def fold_sizes(total: int, k: int) -> list[int]:
    return [total // k + (1 if i < total % k else 0) for i in range(k)]


def with_fold(df: DataFrame, id_col: str, k: int, seed: int | None, column: str = "fold") -> DataFrame:
    """Fold number per row: consecutive stretches of the (shuffled) order, the first ones one longer.

    Without a seed the order of the ids is used as it is.
    """
    total = df.count()
    return label_by_rank(df, id_col, fold_sizes(total, k)[:-1], list(range(k)), seed, column, total)


def with_fold_columns(df: DataFrame, id_col: str, k: int, seed: int, prefix: str = "ml_phase") -> DataFrame:
    """Columns ``<prefix>_fold_0 ...`` valued train or test; each row is test in exactly one."""
    folded = with_fold(df, id_col, k, seed, "_fold")
    roles = {f"{prefix}_fold_{i}": F.when(F.col("_fold") == i, "test").otherwise("train") for i in range(k)}
    return folded.withColumns(roles).drop("_fold")


def fold_roles(df: DataFrame, id_col: str, k: int, seed: int | None) -> DataFrame:
    """Long table (id, fold, role): every row is val in its own fold and train in the others."""
    folded = with_fold(df.select(id_col), id_col, k, seed, "_own")
    every = folded.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return every.select(id_col, "fold", F.when(F.col("_own") == F.col("fold"), "val").otherwise("train").alias("role"))


def merge_train_val(train: DataFrame, val: DataFrame | None) -> DataFrame:
    return train if val is None else train.unionByName(val)


def complement(df: DataFrame, sample: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``sample``."""
    return df.join(sample.select(id_col), id_col, "left_anti")


def with_batch(df: DataFrame, id_col: str, batch_size: int, seed: int | None, column: str = "batch_id") -> DataFrame:
    """Batch number of each row, in shuffled order or, without a seed, in the order of the ids."""
    if seed is None:
        ranked = global_rank(df, [id_col], "_rank")
    else:
        ranked = global_rank(df.withColumn("_hash", hash32(seed, id_col)), ["_hash", id_col], "_rank")
    return ranked.withColumn(column, F.floor(F.col("_rank") / batch_size)).drop("_rank", "_hash")


# Stratified sampling ---------------------------------------------------------


def proportional_quotas(strata: DataFrame, sizes: Sequence[int], total: int, stratum: str = "stratum", count: str = "n") -> DataFrame:
    """Largest-remainder shares of each size, drawn one after the other; ties go to the lower stratum.

    Gives (stratum, draw, upto): rows taken from the stratum by this draw and
    all earlier ones.  ``strata`` has one row per bin, so its windows are small.
    """
    if sum(sizes) > total:
        raise ValueError(f"cannot draw {list(sizes)} of {total} rows")
    whole, taken = "decimal(19,0)", F.lit(0).cast("bigint")
    shares, left = strata.select(stratum, F.col(count).alias("_left")), total
    for draw, size in enumerate(sizes):
        if size:
            product = F.col("_left").cast(whole) * F.lit(size).cast(whole)
            shares = shares.withColumn("_rest", (product % F.lit(left).cast(whole)).cast("bigint"))
            shares = shares.withColumn("_floor", ((product - F.col("_rest")) / F.lit(left).cast(whole)).cast("bigint"))
            open_seats = F.lit(size) - F.sum("_floor").over(Window.partitionBy())
            extra = F.row_number().over(Window.orderBy(F.col("_rest").desc(), F.col(stratum))) <= open_seats
            shares = shares.withColumn("_quota", F.col("_floor") + extra.cast("bigint"))
        else:
            shares = shares.withColumn("_quota", F.lit(0).cast("bigint"))
        shares = shares.withColumn(f"_upto{draw}", taken + F.col("_quota")).withColumn("_left", F.col("_left") - F.col("_quota"))
        taken, left = F.col(f"_upto{draw}"), left - size
    before = [F.lit(0)] + [F.col(f"_upto{i}") for i in range(len(sizes))]
    rows = [F.struct(F.lit(i).alias("draw"), F.col(f"_upto{i}").alias("upto"), (F.col(f"_upto{i}") > before[i]).alias("any")) for i in range(len(sizes))]
    return shares.select(stratum, F.inline(F.array(*rows))).filter("any").drop("any")


def _stratum_cutoffs(keyed: DataFrame, id_col: str, quotas: DataFrame, rows: int, largest: int) -> DataFrame:
    """(stratum, draw, hash, id) of the last row of each draw in each stratum.

    A large stratum is counted per hash range first; only the ranges that hold
    a cut-off are ordered, so no stratum is ever sorted whole.
    """
    ranges = math.ceil(largest / RANGE_ROWS) + 1
    ranged = keyed.withColumn("_range", F.floor(F.col("_hash") * ranges / HASH_RANGE).cast("int"))
    histogram = ranged.groupBy("stratum", "_range").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("stratum").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    running = histogram.withColumn("_upto", F.sum("_n").over(upto)).join(broadcast_if_small(quotas, rows), "stratum")
    before = F.col("_upto") - F.col("_n")
    holding = running.filter((F.col("_upto") >= F.col("upto")) & (before < F.col("upto")))
    wanted = cut(holding.select("stratum", "draw", "_range", (F.col("upto") - before).alias("_row")))
    ranged = ranged.join(broadcast_if_small(wanted.select("stratum", "_range").distinct(), rows), ["stratum", "_range"], "left_semi")
    order = Window.partitionBy("stratum", "_range").orderBy("_hash", id_col)
    ordered = ranged.withColumn("_row", F.row_number().over(order).cast("bigint"))
    last = ordered.join(broadcast_if_small(wanted, rows), ["stratum", "_range", "_row"])
    return last.select("stratum", "draw", "_hash", id_col)


def draw_stratified(df: DataFrame, id_col: str, stratum: Column, sizes: Sequence[int], seed: int, column: str = "draw", strict: bool = False) -> DataFrame:
    """Number the draw that takes each row, null for rows that are left over.

    Draw i takes exactly ``sizes[i]`` rows from what the draws before it left,
    shared out over the strata in proportion to the counts.  Rows without a
    stratum form one of their own.  As all draws go down the same hash order,
    their cut-offs are found together.  With ``strict`` every stratum needs two
    rows and the first draw at least one row per stratum.
    """
    value = F.coalesce(stratum.cast("bigint"), F.lit(-1))
    keyed = df.select(value.alias("stratum"), hash32(seed, id_col).alias("_hash"), id_col)
    strata = cut(keyed.groupBy("stratum").agg(F.count("*").alias("n")))
    smallest, largest, bins, total = strata.agg(F.min("n"), F.max("n"), F.count("*"), F.sum("n")).first()
    if strict and bins and (smallest < 2 or sizes[0] < bins):
        raise ValueError(f"{bins} strata, smallest of {smallest} rows, cannot share {sizes[0]} rows")
    quotas = cut(proportional_quotas(strata, sizes, total or 0))
    cutoffs = _stratum_cutoffs(keyed, id_col, quotas, bins * len(sizes), largest or 0)
    last = [F.max(F.when(F.col("draw") == i, F.struct("_hash", id_col))).alias(f"_last{i}") for i in range(len(sizes))]
    marked = df.withColumn("stratum", value).join(broadcast_if_small(cut(cutoffs.groupBy("stratum").agg(*last)), bins), "stratum", "left")
    hashed, number = hash32(seed, id_col), F.lit(None).cast("int")
    for i in reversed(range(len(sizes))):
        end = F.col(f"_last{i}")
        within = (hashed < end["_hash"]) | ((hashed == end["_hash"]) & (F.col(id_col) <= end[id_col]))
        number = F.when(within, F.lit(i)).otherwise(number)
    return marked.withColumn(column, number).drop("stratum", *[f"_last{i}" for i in range(len(sizes))])


def stratified_sample(df: DataFrame, id_col: str, target: str, size: int, step: float = 0.2, seed: int = 0, add_bin: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sample, rest) with strata of equal-width bins of the target."""
    if add_bin:
        df = df.withColumn("bin", equal_width_bin(target, step))
    drawn = draw_stratified(df, id_col, equal_width_bin(target, step), [size], seed, "_draw")
    return drawn.filter("_draw is not null").drop("_draw"), drawn.filter("_draw is null").drop("_draw")


def stratified_cascade(df: DataFrame, id_col: str, target: str, sizes: Sequence[int], step: float = 0.2, seed: int = 0) -> list[DataFrame]:
    """One sample after the other, each from what the earlier ones left."""
    drawn = draw_stratified(df, id_col, equal_width_bin(target, step), sizes, seed, "_draw")
    return [drawn.filter(F.col("_draw") == i).drop("_draw") for i in range(len(sizes))]


def stratified_split(df: DataFrame, id_col: str, target: str, sizes: Sequence[int], step: float = 0.2, seed: int = 0, column: str = "ml_phase") -> DataFrame:
    """Train, val and test drawn one after the other, with the label in ``column``; the rest is left out."""
    drawn = draw_stratified(df, id_col, equal_width_bin(target, step), sizes, seed, "_draw").filter("_draw is not null")
    phases = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    return drawn.withColumn(column, F.get(phases, F.col("_draw"))).drop("_draw")
