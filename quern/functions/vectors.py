"""Vector functions on array<double> Columns: the readable twins of the Arrow kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, eps: float = 1e-12) -> Column:
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(eps)))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """x on the range from low to high; 0.5 on an empty range."""
    return F.when(high > low, (x - low) / F.greatest(high - low, F.lit(1e-8))).otherwise(F.lit(0.5))


def head(v: Column, h: Column, heads: int, dim: int) -> Column:
    """Columns of one head; the dimension must divide."""
    if dim % heads:
        raise ValueError(f"{dim} dimensions don't divide into {heads} heads")
    return F.slice(v, h * (dim // heads) + 1, F.lit(dim // heads))


def orthogonal(dim: int, seed: int = 42) -> np.ndarray:
    """A fixed orthogonal matrix: scaled Hadamard for powers of two, else the Q of a seeded normal matrix."""
    if dim & (dim - 1) == 0:
        i = np.arange(dim)
        return np.where(np.bitwise_count(i[:, None] & i[None, :]) % 2, -1.0, 1.0) / np.sqrt(dim)
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
