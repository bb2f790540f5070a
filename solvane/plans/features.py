"""Features for kernels: fingerprints as packed bits, scaled physical numbers, or both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvane.functions.arrays import pack_bits
from solvane.operators.scaling import VectorScaler, fit_vector_scaler


def prepare_features(df: DataFrame, id_col: str, bits: str | None = None, n_bits: int = 2048, physical: str | None = None, target: str | None = None, fit_on: DataFrame | None = None, scaler: VectorScaler | None = None) -> tuple[DataFrame, VectorScaler | None]:
    """(features, scaler): the id, ``words`` from set-bit positions, ``phys`` with every position scaled, and the target as ``y``.

    The scaler is fitted on ``fit_on``, by default ``df``, unless one is given; it
    is returned, so that other tables can be brought to the same scale.
    """
    if bits is None and physical is None:
        raise ValueError("features need bits, physical numbers or both")
    columns = [F.col(id_col)]
    if physical is not None:
        scaler = scaler or fit_vector_scaler(df if fit_on is None else fit_on, physical)
        df = scaler.scaled(df, physical, "_phys")
    if bits is not None:
        columns.append(pack_bits(bits, n_bits).alias("words"))
    if physical is not None:
        columns.append(F.col("_phys").alias("phys"))
    if target is not None:
        columns.append(F.col(target).alias("y"))
    return df.select(*columns), scaler
