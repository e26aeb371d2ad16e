"""Vectors as arrays: products, cosine similarity and the scores derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similarity(distance: Column) -> Column:
    """A cosine distance as a score from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2))


def finite(a: Column | str) -> Column:
    """Whether all components are there and finite."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
