"""Preparation of molecule data sets, from a raw table to a labelled or widened one.

Every job takes a table and returns one; reading and writing are left to
:mod:`solvane.sources`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from solvane.operators.clean import at_least, keep_valid, rows_between, thin_out_below
from solvane.operators.fingerprint import add_fingerprint_columns, fingerprints
from solvane.operators.graph import GRAPH
from solvane.operators.split import random_subset, stratified_split, with_fold_columns
from solvane.operators.vocab import extend_vocabulary, first_seen

# Thresholds and sizes of the published data sets.
MIN_PCE = 0.0001
THINNING = {"threshold": 4.0, "skip": 0.3}
SIZES = [15000, 5000, 5000]


def valid_molecules(df: DataFrame, id_col: str, valid: Column, first: int = -1) -> DataFrame:
    """Only rows with a valid structure, of the first ``first`` rows if that is positive."""
    if first > 0:
        df = rows_between(df, [id_col], 0, first)
    return keep_valid(df, valid)


def _cleaned(df: DataFrame, id_col: str, target: str, threshold: float, thinning: dict | None, seed: int) -> DataFrame:
    df = at_least(df, target, threshold)
    return df if thinning is None else thin_out_below(df, id_col, target, thinning["threshold"], thinning["skip"], seed)


def cleaned_and_stratified(df: DataFrame, id_col: str, target: str, sizes: Sequence[int] = SIZES, threshold: float = MIN_PCE, thinning: dict | None = None, step: float = 0.2, seed: int = 0) -> DataFrame:
    """Threshold, optional thinning, then stratified train, val and test of exact sizes."""
    return stratified_split(_cleaned(df, id_col, target, threshold, thinning, seed), id_col, target, sizes, step, seed)


def cleaned_and_random(df: DataFrame, id_col: str, target: str, sizes: Sequence[int] = SIZES, threshold: float = MIN_PCE, thinning: dict | None = None, seed: int = 100) -> DataFrame:
    """Threshold, optional thinning, then random train, val and test of exact sizes."""
    return random_subset(_cleaned(df, id_col, target, threshold, thinning, seed), id_col, sizes, seed)


def extended_dictionary(known: DataFrame, df: DataFrame, row: str, tokens: str) -> DataFrame:
    """The vocabulary of one data set continued with the tokens of another."""
    return extend_vocabulary(known, first_seen(df, row, tokens))


def with_folds(df: DataFrame, id_col: str, k: int = 5, seed: int = 200) -> DataFrame:
    return with_fold_columns(df, id_col, k, seed)


def with_fingerprints(df: DataFrame, id_col: str, nodes: DataFrame, edges: DataFrame, n_bits: int = 1048, radius: int = 2) -> DataFrame:
    """One column per fingerprint bit."""
    bits = fingerprints(nodes, edges, n_bits=n_bits, radius=radius).withColumnRenamed(GRAPH, id_col)
    return add_fingerprint_columns(df, bits, id_col, n_bits)
