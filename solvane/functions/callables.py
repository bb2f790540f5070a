"""Where a caller may hand in a column name, an expression or a Python function."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Source = str | Column | Callable[[DataFrame], Column]


def resolve(df: DataFrame, source: Source) -> Column:
    """The column that a name, an expression or a function of the table stands for."""
    if isinstance(source, str):
        return F.col(source)
    return source if isinstance(source, Column) else source(df)


def row_featuriser(function: Callable[[str], Iterable[int]]) -> Callable[[str | Column], Column]:
    """Wrap a Python function of one string as a vectorised column function giving array<int>.

    The slow path, for featurisers that cannot be written with built-in functions;
    combine with :func:`solvane.operators.vocab.featurise_distinct`.
    """

    @F.pandas_udf("array<int>")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else [int(v) for v in function(text)])

    return apply
