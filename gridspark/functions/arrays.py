"""Arrays and strings of variable length as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(v: Column) -> Column:
    """Items of an array; null for null."""
    return F.when(v.isNotNull(), F.size(v)).cast("bigint")


def part(v: Column, start: int, stop: int | None = None) -> Column:
    """Items from start up to stop, clipped to the array."""
    n = F.size(v) if stop is None else F.least(F.size(v), F.lit(stop))
    return F.slice(v, start + 1, F.greatest(n - start, F.lit(0)))


def equal(a: Column, b: Column) -> Column:
    """Same items in the same order; nulls are equal to nulls."""
    return a.eqNullSafe(b)
