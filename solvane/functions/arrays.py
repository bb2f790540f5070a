"""Array expressions for sequences, one-hot features and fingerprint bits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from solvane.functions.hashing import as_column

# The elements that an atom feature vector tells apart.
ATOM_SYMBOLS = ["B", "C", "N", "O", "F", "Si", "P", "S", "H", "Cl", "As", "Se", "Br", "Te", "I", "At"]


def shift_and_pad(ids: str | Column, length: int, row_id: str | Column) -> Column:
    """Ids plus 1, filled up with 0 to ``length``; a longer sequence is an error that names its row."""
    ids = as_column(ids)
    message = F.concat(
        F.lit("sequence of length "), F.size(ids).cast("string"), F.lit(f" exceeds the maximum {length} in row "), as_column(row_id).cast("string")
    )
    shifted = F.transform(ids, lambda i: (i + 1).cast("int"))
    padding = F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.when(F.size(ids) > length, F.raise_error(message).cast("array<int>")).otherwise(F.concat(shifted, padding))


def one_hot(symbol: str | Column, flag: Column, allowed: Sequence[str] = tuple(ATOM_SYMBOLS)) -> Column:
    """One position per allowed symbol, one for any other, and one for ``flag``."""
    symbol = as_column(symbol)
    known = [(symbol == s).cast("int") for s in allowed]
    return F.array(*known, (~symbol.isin(list(allowed))).cast("int"), flag.cast("int"))


def bit_columns(bits: str | Column, n_bits: int, prefix: str = "fp") -> dict[str, Column]:
    """Columns ``fp0`` ... valued 0 or 1 from an array of set-bit positions."""
    return {f"{prefix}{i}": F.array_contains(as_column(bits), i).cast("int") for i in range(n_bits)}


def positive_positions(vector: str | Column) -> Column:
    """Positions of the elements above 0, as set bits."""
    marked = F.transform(as_column(vector), lambda v, i: F.when(v > 0, i.cast("int")))
    return F.filter(marked, lambda i: i.isNotNull())


def dense_bits(bits: str | Column, n_bits: int) -> Column:
    """Array of 0.0 and 1.0 from set-bit positions."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda i: F.array_contains(as_column(bits), i).cast("double"))


def pack_bits(bits: str | Column, n_bits: int) -> Column:
    """Set-bit positions as 64-bit words."""
    bits = as_column(bits)

    def word(number: int) -> Column:
        own = F.filter(bits, lambda b: F.floor(b / 64) == number)
        bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(b, F.lit(64)).cast("int"))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda packed, b: packed.bitwiseOR(bit(b)))

    return F.array(*[word(number) for number in range((n_bits + 63) // 64)])


def cast_elements(array: str | Column, kind: str) -> Column:
    return F.transform(as_column(array), lambda v: v.cast(kind))
