"""Descriptive functions across the arguments of one row; missing arguments are ignored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import col
from . import function


def _values(args) -> Column:
    return F.array_compact(F.array(*[col(a).cast("double") for a in args]))


@function("SUM")
def sum_(*args) -> Column:
    x = _values(args)
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, b: a + b))


@function("MEAN")
def mean(*args) -> Column:
    return sum_(*args) / F.when(F.size(_values(args)) > 0, F.size(_values(args)))


@function("MIN")
def min_(*args) -> Column:
    return F.array_min(_values(args))


@function("MAX")
def max_(*args) -> Column:
    return F.array_max(_values(args))


@function("N")
def n(*args) -> Column:
    return F.size(_values(args))


@function("NMISS")
def nmiss(*args) -> Column:
    return F.lit(len(args)) - F.size(_values(args))


@function("RANGE")
def range_(*args) -> Column:
    return max_(*args) - min_(*args)


@function("COALESCE")
def coalesce(*args) -> Column:
    return F.coalesce(*[col(a) for a in args])


@function("COALESCEC")
def coalescec(*args) -> Column:
    return F.coalesce(*[F.when(F.trim(col(a)) != "", col(a)) for a in args])


@function("MISSING")
def missing(x) -> Column:
    x = col(x)
    return F.when(x.isNull() | (F.trim(x.cast("string")) == ""), 1).otherwise(0)


@function("LARGEST")
def largest(k, *args) -> Column:
    return F.try_element_at(F.sort_array(_values(args), asc=False), F.lit(k))


@function("SMALLEST")
def smallest(k, *args) -> Column:
    return F.try_element_at(F.sort_array(_values(args)), F.lit(k))


@function("ORDINAL")
def ordinal(k, *args) -> Column:
    """With one argument its ordinal text (1st, 2nd); with more the k-th smallest."""
    if args:
        return smallest(k, *args)
    x = col(k).cast("int")
    tail = F.when((x % 100).isin(11, 12, 13), "th").when(x % 10 == 1, "st").when(x % 10 == 2, "nd").when(x % 10 == 3, "rd").otherwise("th")
    return F.concat(x.cast("string"), tail)


@function("STD")
def std(*args) -> Column:
    """Sample standard deviation of the arguments."""
    x = _values(args)
    m = mean(*args)
    ss = F.aggregate(F.transform(x, lambda v: (v - m) * (v - m)), F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(x) > 1, F.sqrt(ss / (F.size(x) - 1)))


@function("VAR")
def var(*args) -> Column:
    return std(*args) * std(*args)


def sort_values(*args) -> Column:
    """CALL SORTN / SORTC: the arguments in ascending order, missing first, as an array to project again."""
    return F.array_sort(F.array(*[col(a) for a in args]), lambda a, b: F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
