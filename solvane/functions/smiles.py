"""Lexing of SMILES strings with built-in string functions, and a walk along their bonds."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from solvane.functions.hashing import as_column

# The public SMILES grammar for atoms and for all other symbols.
ATOM_PATTERN = r"\[[^\[\]]+\]|Br|Cl|B|C|N|O|P|S|F|I|b|c|n|o|p|s"
OTHER_PATTERN = r"[-=#$:/\\.~()]|%[0-9]{2}|[0-9]"
SYMBOL_PATTERN = r"^\[?[0-9]*([A-Z][a-z]?|[a-z][a-z]?)"
RING_PATTERN = r"%[0-9]{2}|[0-9]"


def atom_tokens(smiles: str | Column) -> Column:
    """Atom tokens from left to right; bracket atoms are kept whole."""
    return F.regexp_extract_all(as_column(smiles), F.lit(ATOM_PATTERN), F.lit(0))


def raw_symbol(token: Column) -> Column:
    return F.regexp_extract(token, SYMBOL_PATTERN, 1)


def atom_symbol(token: Column) -> Column:
    """Element symbol of an atom token, e.g. Se for [se]."""
    symbol = raw_symbol(token)
    return F.concat(F.upper(F.substring(symbol, 1, 1)), F.substring(symbol, 2, 1))


def is_aromatic(token: Column) -> Column:
    """Aromatic atoms are written in lower case."""
    symbol = raw_symbol(token)
    return (F.length(symbol) > 0) & (F.substring(symbol, 1, 1) == F.lower(F.substring(symbol, 1, 1)))


def heavy_atoms(smiles: str | Column) -> Column:
    return F.size(atom_tokens(smiles))


def element_count(smiles: str | Column, symbol: str) -> Column:
    return F.size(F.filter(atom_tokens(smiles), lambda t: atom_symbol(t) == symbol))


def branches_close(smiles: str | Column) -> Column:
    """Parentheses outside bracket atoms close in order."""
    marks = F.regexp_extract_all(as_column(smiles), F.lit(r"[()]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(state, mark):
        depth = state["depth"] + F.when(mark == "(", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.least(state["least"], depth).alias("least"))

    return F.aggregate(marks, start, step, lambda s: (s["depth"] == 0) & (s["least"] == 0))


def rings_close(smiles: str | Column) -> Column:
    """Each ring number outside bracket atoms is written an even number of times."""
    outside = F.regexp_replace(as_column(smiles), r"\[[^\[\]]*\]", "")
    numbers = F.regexp_extract_all(outside, F.lit(RING_PATTERN), F.lit(0))
    nothing = F.array().cast("array<string>")

    def step(opened: Column, number: Column) -> Column:
        return F.when(F.array_contains(opened, number), F.array_remove(opened, number)).otherwise(F.concat(opened, F.array(number)))

    return F.aggregate(numbers, nothing, step, lambda opened: F.size(opened) == 0)


def looks_valid(smiles: str | Column) -> Column:
    """Lexical validity: only known symbols, closed branches and closed rings."""
    smiles = as_column(smiles)
    symbols = smiles.rlike(f"^({ATOM_PATTERN}|{OTHER_PATTERN})+$")
    return F.coalesce(symbols & branches_close(smiles) & rings_close(smiles), F.lit(False))


TOKEN = re.compile(f"(?P<atom>{ATOM_PATTERN})|(?P<ring>{RING_PATTERN})|{OTHER_PATTERN}")
AROMATIC = re.compile(r"\[?[0-9]*[a-z]")


def bonds(smiles: str) -> Iterator[tuple[int, int, str]]:
    """Bonds (src, dst, bond) between the atom tokens of a valid string, atoms numbered from left to right.

    One walk over the tokens: the last atom, a stack of the atoms where branches
    begin, and a table of open rings.  A bond that is not written is ``:``
    between two aromatic atoms and ``-`` otherwise; the directions ``/`` and
    ``\\`` are ``-``.
    """
    nowhere = (-1, False)
    stack, rings, last, count, bond = [], {}, nowhere, 0, ""
    for token in TOKEN.finditer(smiles):
        text, kind, met, written = token[0], token.lastgroup, None, bond
        bond = ""
        if kind == "atom":
            here = (count, AROMATIC.match(text) is not None)
            met = (last, here) if last[0] >= 0 else None
            last, count = here, count + 1
        elif kind == "ring":
            number = int(text.replace("%", ""))
            if number in rings:
                opened, first = rings.pop(number)
                met, written = (opened, last), first or written
            else:
                rings[number] = (last, written)
        elif text == "(":
            stack.append(last)
        elif text == ")":
            last = stack.pop() if stack else nowhere
        elif text == ".":
            last = nowhere
        else:
            bond = text
        if met is not None:
            plain = ":" if met[0][1] and met[1][1] else "-"
            yield met[0][0], met[1][0], "-" if written in ("/", "\\") else written or plain
