"""Dictionaries of tokens: building, extending, comparing and encoding with them.

A vocabulary is a table ``(token, idx)``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from solvane.operators.ranking import global_rank
from solvane.storage import BROADCAST_BYTES, stage


def token_rows(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """(id, pos, token), one row per token.

    The outer explode keeps Spark from adding a filter that would work out the
    tokens a second time.
    """
    return df.select(id_col, F.posexplode_outer(tokens).alias("pos", "token")).filter(F.col("pos").isNotNull())


def first_seen(df: DataFrame, row: str, tokens: str) -> DataFrame:
    """Distinct tokens of an array column with the (row, position) where each is first met.

    Positions count the distinct tokens of a row, which keeps their order; a
    token then has one position per row and the minimum can be hash-aggregated.
    """
    once = token_rows(df.select(row, F.array_distinct(tokens).alias(tokens)), row, tokens)
    return once.groupBy("token").agg(F.min(row).alias("first_row"), F.min_by("pos", row).alias("first_pos"))


def first_seen_rows(df: DataFrame, row: str, pos: str, token: str) -> DataFrame:
    """As :func:`first_seen` for a table with one row per token."""
    once = df.groupBy(F.col(token).alias("token"), row).agg(F.min(pos).alias("_pos"))
    return once.groupBy("token").agg(F.min(row).alias("first_row"), F.min_by("_pos", row).alias("first_pos"))


def numbered(first: DataFrame, start: int = 0) -> DataFrame:
    """Dense ids from ``start`` in the order of first sight.

    A vocabulary is fitted once and looked up many times; its tokens are written out where they are ranked.
    """
    ranked = global_rank(first, ["first_row", "first_pos"], "idx")
    return ranked.select("token", (F.col("idx") + F.lit(start)).alias("idx"))


def build_vocabulary(df: DataFrame, row: str, tokens: str) -> DataFrame:
    """Dense ids in the order in which the tokens of an array column are first met."""
    return numbered(first_seen(df, row, tokens))


def extend_vocabulary(existing: DataFrame, first: DataFrame, zero_for_new: bool = False) -> DataFrame:
    """Known tokens keep their ids; those new in ``first`` follow after them, or all get 0.

    ``first`` comes from :func:`first_seen` over the second data set.
    """
    new = first.join(existing.select("token"), "token", "left_anti")
    if zero_for_new:
        added = new.select("token", F.lit(0).cast("bigint").alias("idx"))
    else:
        added = numbered(new, existing.count())
    return existing.select("token", F.col("idx").cast("bigint").alias("idx")).unionByName(added)


def _known_or(idx: Column, token: Column, strict: bool) -> Column:
    if strict:
        problem = F.raise_error(F.concat(F.lit("unknown token: "), token)).cast("int")
        return F.when(idx.isNull() & token.isNotNull(), problem).otherwise(idx)
    return F.coalesce(idx, F.lit(-1))


def _lookup(vocabulary: DataFrame) -> DataFrame:
    """(token, idx) with one row per token, the lowest id of a repeated one."""
    return vocabulary.filter(F.col("token").isNotNull()).groupBy("token").agg(F.min("idx").cast("int").alias("idx"))


def encode_rows(df: DataFrame, token: str, vocabulary: DataFrame, output: str = "idx", strict: bool = False) -> DataFrame:
    """Look up one token per row; unknown ones become -1, or raise if ``strict``. A repeated entry counts with its lowest id."""
    lookup = _lookup(vocabulary).select(F.col("token").alias("_token"), F.col("idx").alias("_idx"))
    joined = df.join(lookup, F.col(token) == F.col("_token"), "left")
    return joined.withColumn(output, _known_or(F.col("_idx"), F.col(token), strict)).drop("_token", "_idx")


def encode_sequences(df: DataFrame, id_col: str, tokens: str, vocabulary: DataFrame, output: str = "ids", strict: bool = False, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(id, ids): each token array as an array of ids, in its order.

    The vocabulary is measured.  Within ``limit`` bytes it is sent to all tasks
    and rows are translated where they lie, each token by one hash lookup.  Of
    a larger one only the entries that ``df`` uses most, within the limit, are
    sent; the other tokens of a row, which are rare, meet the vocabulary in a
    join and come back to their row, once each.  A null array stays null, and a
    null token counts as unknown.
    """
    lookup = _lookup(vocabulary)
    sized = lookup.withColumn("bytes", F.octet_length(F.col("token").cast("string")) + 16)
    rows = df.select(F.col(id_col).alias("id"), F.col(tokens).alias("tokens"))
    if (sized.agg(F.sum("bytes")).first()[0] or 0) <= limit:
        known = lookup
    else:
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "sequences")
        known = _most_used(rows, sized, limit)
    sent = df.sparkSession.sparkContext.broadcast(known.toArrow())
    if known is not lookup:
        asked = _others(rows, sent).select("row", F.explode("others").alias("token"))
        listed = asked.join(lookup, "token").groupBy("row").agg(F.collect_list(F.struct("token", "idx")).alias("entries"))
        rows = rows.join(listed, "row", "left").select("id", "tokens", "entries")
    return _translated(rows, sent, strict).select(F.col("id").alias(id_col), F.col("ids").alias(output))


def _most_used(rows: DataFrame, sized: DataFrame, limit: int) -> DataFrame:
    """Entries of the vocabulary used 2^k times or more in the rows, for the smallest k with which they take ``limit`` bytes at most."""
    used = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("size"))
    used = stage(sized.join(used, "token"), "used")
    left, least = limit, 64
    for size, taken in used.groupBy("size").agg(F.sum("bytes")).orderBy(F.desc("size")).collect():  # a row for each power of two
        left -= taken
        if left < 0:
            break
        least = size
    return used.filter(F.col("size") >= least).select("token", "idx")


def _places(known: pa.Table, tokens: pa.Array) -> np.ndarray:
    """The id of each token, -1 for those that ``known`` lacks."""
    ids = np.append(known.column("idx").to_numpy(), -1).astype(np.int32)
    entries = known.column("token").combine_chunks().cast(tokens.type)
    return ids[pc.fill_null(pc.index_in(tokens, value_set=entries), len(ids) - 1).to_numpy(zero_copy_only=False)]


def _bounds(lists: pa.ListArray) -> np.ndarray:
    """Where each row's values begin among all, and the end."""
    return np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))


def _others(rows: DataFrame, sent) -> DataFrame:
    """(row, others): the distinct tokens of each row that were not sent."""

    def batches(parts):
        for part in parts:
            flat, bounds = part.column("tokens").flatten(), _bounds(part.column("tokens"))
            rest = np.flatnonzero((_places(sent.value, flat) < 0) & flat.is_valid().to_numpy(zero_copy_only=False))
            cuts = np.searchsorted(rest, bounds)
            at = np.flatnonzero(np.diff(cuts))
            others = [flat.take(pa.array(rest[cuts[i] : cuts[i + 1]])).unique() for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(at)), pa.array([o.to_pylist() for o in others], pa.list_(flat.type))], ["row", "others"])

    kind = StructType([StructField("row", rows.schema["row"].dataType), StructField("others", rows.schema["tokens"].dataType)])
    return rows.select("row", "tokens").mapInArrow(batches, kind)


def _translated(rows: DataFrame, sent, strict: bool) -> DataFrame:
    """(id, ids) of rows (id, tokens) and, where tokens were looked up elsewhere, their ``entries``."""

    def batches(parts):
        for part in parts:
            lists = part.column("tokens")
            flat, bounds = lists.flatten(), _bounds(lists)
            ids = _places(sent.value, flat)
            if "entries" in part.schema.names:
                entries = part.column("entries")
                for i in np.flatnonzero(entries.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    low, high = bounds[i], bounds[i + 1]
                    own = _places(pa.Table.from_struct_array(entries[i].values), flat.slice(low, high - low))
                    ids[low:high] = np.where(ids[low:high] < 0, own, ids[low:high])
            empty = None
            if strict:
                empty = flat.is_null()
                unknown = np.flatnonzero((ids < 0) & ~empty.to_numpy(zero_copy_only=False))
                if len(unknown):
                    raise ValueError(f"unknown token: {flat[int(unknown[0])].as_py()}")
            values = pa.array(ids, mask=None if empty is None else empty.to_numpy(zero_copy_only=False))
            out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, mask=lists.is_null() if len(lists) else None)
            yield pa.RecordBatch.from_arrays([part.column("id"), out], ["id", "ids"])

    kind = StructType([StructField("id", rows.schema["id"].dataType), StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(batches, kind)


def rows_with_unknown(df: DataFrame, id_col: str, tokens: str, vocabulary: DataFrame) -> DataFrame:
    """Ids of the rows that hold at least one token outside the vocabulary."""
    distinct = token_rows(df.select(id_col, F.array_distinct(tokens).alias(tokens)), id_col, tokens)
    return distinct.join(vocabulary.select("token"), "token", "left_anti").select(id_col).distinct()


def vocabulary_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tokens of ``left`` that ``right`` lacks."""
    return left.select("token").join(right.select("token"), "token", "left_anti")


def featurise_distinct(df: DataFrame, text: str, featurise, columns: Sequence[str]) -> DataFrame:
    """Apply ``featurise`` (text table to text table with ``columns``) once per distinct string.

    All rows stay: a null text is featurised like any other, and a text that ``featurise`` drops gets nulls.
    """
    features = featurise(df.select(text).distinct()).select(F.col(text).alias("_text"), *columns)
    return df.join(features, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")
