"""Vector expressions on ARRAY<FLOAT> columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    """Inner product; null if either is null."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p)


def norm(x: Column) -> Column:
    """Euclidean length; null for null."""
    return F.sqrt(dot(x, x))


def normalised(x: Column) -> Column:
    """Vector of length 1; a zero vector stays zero."""
    n = norm(x)
    return F.transform(x, lambda v: v.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def usable(x: Column, dim: int) -> Column:
    """Whether a vector has exactly ``dim`` finite components that are not all zero."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (F.size(x) == dim) & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)
