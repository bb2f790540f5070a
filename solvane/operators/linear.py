"""Linear models with squared loss from one aggregate of the data.

The sums of products of the features and the target say all that a least-squares
fit needs.  They are added up once, per fold if there are folds; what a fit on
all folds but one needs is the whole less that fold, and errors follow from the
same sums, so any number of penalties and folds takes one scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """``sums`` is the sum of z z' over rows z = (1, features, target)."""

    sums: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.sums + other.sums)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.sums - other.sums)

    @property
    def rows(self) -> float:
        return self.sums[0, 0]

    def mapped(self, a: np.ndarray) -> Moments:
        """Those of the features multiplied by ``a``."""
        whole = np.zeros((len(self.sums), a.shape[1] + 2))
        whole[0, 0] = whole[-1, -1] = 1.0
        whole[1:-1, 1:-1] = a
        return Moments(whole.T @ self.sums @ whole)

    def fit(self, reg: float = 0.0, intercept: bool = True) -> np.ndarray:
        """(b, w) with the least mean squared error plus ``reg`` times the squared weights; the intercept has no penalty."""
        gram, cross = self.sums[:-1, :-1] / self.rows, self.sums[:-1, -1] / self.rows
        penalty = reg * np.eye(len(gram))
        penalty[0, 0] = 0.0
        if intercept:
            return np.linalg.lstsq(gram + penalty, cross, rcond=None)[0]
        return np.append(0.0, np.linalg.lstsq((gram + penalty)[1:, 1:], cross[1:], rcond=None)[0])

    def mse(self, fitted: np.ndarray) -> float:
        line = np.append(-fitted, 1.0)
        return float(line @ self.sums @ line / self.rows)


def moments(df: DataFrame, features: str, label: str, by: str | None = None) -> dict:
    """The moments of each group ``by``, or of all rows under the key None. ``features`` is an array of numbers, equally long in all rows.

    A task returns one row per group and product, whatever its rows; rows with a
    null among features and target are left out.
    """
    group = F.lit(None).cast("int") if by is None else F.col(by)
    z = F.concat(F.array(F.lit(1.0)), F.col(features).cast("array<double>"), F.array(F.col(label).cast("double")))
    rows = df.select(group.alias("group"), z.alias("z")).filter(F.col("z").isNotNull() & ~F.exists("z", lambda v: v.isNull() | F.isnan(v)))

    def add_up(parts):
        sums: dict = {}
        for part in parts:
            if not len(part):
                continue
            z = part.column("z").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            groups = part.column("group").dictionary_encode(null_encoding="encode")
            which = groups.indices.to_numpy(zero_copy_only=False)
            for i, key in enumerate(groups.dictionary.to_pylist()):
                own = z[which == i]
                sums[key] = sums.get(key, 0.0) + own.T @ own
        for key, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], rows_type), pa.array([total.reshape(-1)], pa.list_(pa.float64()))], ["group", "sums"])

    kind = rows.schema["group"].dataType.simpleString()
    rows_type = pa.schema(rows.limit(0).toArrow().schema).field("group").type
    cells = rows.mapInArrow(add_up, f"group {kind}, sums array<double>").select("group", F.posexplode("sums").alias("at", "v"))
    found: dict = {}
    for row in cells.groupBy("group", "at").agg(F.sum("v").alias("v")).collect():  # a square of the number of features for each group
        found.setdefault(row["group"], {})[row["at"]] = row["v"]
    out = {}
    for key, values in found.items():
        side = int(round(len(values) ** 0.5))
        out[key] = Moments(np.array([values[i] for i in range(side * side)]).reshape(side, side))
    return out


def cross_validated_ridge(df: DataFrame, features: str, label: str, fold: str, regs: Sequence[float], intercept: bool = True) -> DataFrame:
    """(reg, fold, train_mse, test_mse) of every penalty and fold, from one scan of ``df``."""
    by_fold = moments(df, features, label, fold)
    whole = sum(by_fold.values(), start=Moments(np.zeros(1)))
    rows = []
    for reg in regs:
        for key, own in sorted(by_fold.items()):
            rest = whole - own
            fitted = rest.fit(reg, intercept)
            rows.append((float(reg), key, rest.mse(fitted), own.mse(fitted)))
    return df.sparkSession.createDataFrame(rows, "reg double, fold int, train_mse double, test_mse double")
