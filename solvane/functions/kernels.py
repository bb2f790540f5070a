"""Similarity kernels between two feature structs with ``words`` (packed bits) and ``phys`` (numbers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Kernel = Callable[[Column, Column], Column]


def _bits_in_common(a: Column, b: Column, combine) -> Column:
    counts = F.zip_with(a, b, lambda x, y: F.bit_count(combine(x, y)))
    return F.aggregate(counts, F.lit(0), lambda total, n: total + n)


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over combined set bits of two packed fingerprints; 0 for two empty ones."""
    shared = _bits_in_common(a, b, lambda x, y: x.bitwiseAND(y))
    either = _bits_in_common(a, b, lambda x, y: x.bitwiseOR(y))
    return F.when(either > 0, shared / either).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda total, s: total + s)


def structural(gamma: float) -> Kernel:
    return lambda x, y: F.exp(F.lit(-gamma) * (1 - tanimoto(x["words"], y["words"])))


def physical(gamma: float) -> Kernel:
    return lambda x, y: F.exp(F.lit(-gamma) * squared_distance(x["phys"], y["phys"]))


def combined(gamma_structural: float = 0.0, gamma_physical: float = 0.0, alpha: float | None = None) -> Kernel:
    """Structural, physical or both: a weighted sum if ``alpha`` is given and not 0, else the product."""
    if gamma_physical == 0.0:
        return structural(gamma_structural)
    if gamma_structural == 0.0:
        return physical(gamma_physical)
    s, p = structural(gamma_structural), physical(gamma_physical)
    if alpha:
        return lambda x, y: F.lit(alpha) * s(x, y) + F.lit(1 - alpha) * p(x, y)
    return lambda x, y: s(x, y) * p(x, y)


def _dot(x: Column, y: Column) -> Column:
    products = F.zip_with(x["phys"], y["phys"], lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def linear() -> Kernel:
    return _dot


def polynomial(gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> Kernel:
    return lambda x, y: F.pow(F.lit(gamma) * _dot(x, y) + F.lit(coef0), F.lit(degree))


def sigmoid(gamma: float = 1.0, coef0: float = 0.0) -> Kernel:
    return lambda x, y: F.tanh(F.lit(gamma) * _dot(x, y) + F.lit(coef0))


# Names a caller may use in place of a function.
KERNELS: dict[str, Callable[..., Kernel]] = {
    "rbf": physical,
    "linear": linear,
    "poly": polynomial,
    "sigmoid": sigmoid,
    "tanimoto": lambda: lambda x, y: tanimoto(x["words"], y["words"]),
    "rbf_kernel_phys_and_struct": combined,
}


def resolve_kernel(kernel: str | Kernel, **params) -> Kernel:
    """A kernel by name with its parameters, or a callable as it is."""
    if callable(kernel):
        return kernel
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}")
    return KERNELS[kernel](**params)
