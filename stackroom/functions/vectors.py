"""Vector expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for a zero vector, an error for different lengths."""
    length = norm(a) * norm(b)
    value = F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vector length mismatch")).cast("double"))
