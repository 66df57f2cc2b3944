"""Arithmetic on arrays of numbers, in DOUBLE and in index order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine similarity; with no length on a side and no epsilon, null."""
    size = norm(a) * norm(b) + F.lit(epsilon)
    return F.when(size != 0, dot(a, b) / size)


def normalised(a: Column) -> Column:
    """Of length one; a vector without length stays as it is."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))
