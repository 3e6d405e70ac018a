"""Vectors as arrays: sums in double, in the order of the array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length one; a zero vector gives null."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    """Similarity, null for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def vector_text(a: Column, digits: int = 8) -> Column:
    """``[x,y,...]`` with a fixed number of digits, exact halves to the even digit as in C's printf; null components are left out (C14)."""
    shown = lambda x: F.call_function("format_number", x, F.lit("0." + "0" * digits))
    # the pattern would write a sign of its own for these
    named = lambda x: F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.coalesce(named(x.cast("double")), shown(x.cast("double")))), ","), F.lit("]"))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])
