"""Array and date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category_tokens(c: Column) -> Column:
    """Ordered distinct tokens of a string split on white space."""
    return F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != ""))


def authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, " and "), lambda x: F.trim(x)), lambda x: x != "")


def prefix_year(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int")


def latest(*times: Column) -> Column:
    """The latest of several ISO strings; unreadable ones count as missing."""
    return F.greatest(*[F.try_to_timestamp(t) for t in times])


def array_literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def subset(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long arrays; null if either is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
