"""Scalar functions with the embedded-database semantics the guarded surface promises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substr(s: Column, start: int, length: int) -> Column:
    """Start 0 counts as the place before the first character."""
    return F.substring(s, 1, max(0, length - 1)) if start == 0 else F.substring(s, start, length)


def scalar_max(*cols: Column) -> Column:
    """Null if any argument is null (``greatest`` skips nulls)."""
    return F.when(sum((c.isNull().cast("int") for c in cols), F.lit(0)) > 0, None).otherwise(F.greatest(*cols))


def scalar_min(*cols: Column) -> Column:
    return F.when(sum((c.isNull().cast("int") for c in cols), F.lit(0)) > 0, None).otherwise(F.least(*cols))


def divide(a: Column, b: Column) -> Column:
    """Division by zero is null."""
    return F.try_divide(a, b)


def total(c: Column) -> Column:
    """Aggregate: a double, 0 for no rows."""
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def close_to(a: Column, b: Column) -> Column:
    """Equal within max(1e-9, |a| * 1e-12)."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-9), F.abs(a) * 1e-12)


def ratio(num: Column, den: Column) -> Column:
    """Null for an empty denominator."""
    return F.when(den != 0, num / den)
