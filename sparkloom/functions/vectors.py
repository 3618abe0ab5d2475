"""Column functions over arrays as vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body's inner functions use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(a: Column) -> Column:
    return let(norm(a), lambda length: F.transform(a, lambda x: x.cast("double") / F.nullif(length, F.lit(0.0))))


def runs(ordered: Column) -> Column:
    """array<struct<value, n>>: the distinct values of a sorted array, each with its number."""
    places = F.when(F.size(ordered) > 0, F.sequence(F.lit(1), F.size(ordered))).otherwise(F.array().cast("array<int>"))
    firsts = F.filter(places, lambda i: (i == 1) | (F.element_at(ordered, i) != F.element_at(ordered, F.greatest(i - 1, F.lit(1)))))
    return let(firsts, lambda f: F.transform(f, lambda x, i: F.struct(F.element_at(ordered, x).alias("value"), (F.coalesce(F.get(f, i + 1), F.size(ordered) + 1) - x).alias("n"))))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
