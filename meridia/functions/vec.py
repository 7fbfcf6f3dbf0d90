"""Vectors as arrays of numbers; sums run from the first element to the last, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    """0 where a vector is shorter than `least`."""
    na, nb = norm(a), norm(b)
    return F.when((na < least) | (nb < least), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
