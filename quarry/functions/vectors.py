"""Vector arithmetic over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0, null where lengths differ."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).otherwise(F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size))


def unit(a: Column) -> Column:
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: F.lit(0.0))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def half_similarity(distance: Column, clamp: bool = True) -> Column:
    """1 - d/2."""
    value = 1 - distance / 2
    return F.greatest(F.lit(0.0), value) if clamp else value


def full_similarity(distance: Column) -> Column:
    """1 - d, not below 0."""
    return F.greatest(F.lit(0.0), 1 - distance)
