"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector is an error."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.raise_error(F.lit("zero vector")).cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 beside a zero vector, null beside a null one."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))
