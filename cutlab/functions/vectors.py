"""Vectors as array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """A unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def similarity(a: Column, b: Column) -> Column:
    """Cosine with a floor of 0: no vector, a negative cosine and NaN all count as 0."""
    n = norm(a) * norm(b)
    cosine = F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
    return F.greatest(F.lit(0.0), F.nanvl(F.coalesce(cosine, F.lit(0.0)), F.lit(0.0)))
