"""Column builders for vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    length = norm(v)
    return F.transform(v, lambda x: x / F.when(length == 0, F.lit(1.0)).otherwise(length))


def rounded(v: Column, places: int) -> Column:
    return F.transform(v, lambda x: F.round(x, places))
