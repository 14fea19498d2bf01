"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column, digits: int = 6) -> Column:
    """Unit length (norms below 1e-8 count as that), rounded."""
    n = F.greatest(norm(a), F.lit(1e-8))
    return F.transform(a, lambda x: F.round(x.cast("double") / n, digits))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)
