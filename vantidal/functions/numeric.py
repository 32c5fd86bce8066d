"""Numeric helpers whose semantics differ between engines: finiteness and correlation of constants."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True for a finite number; null for null. (NaN is greater than every number, so it must go first.)"""
    x = x.cast("double")
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _over(c: Column, w: WindowSpec | None) -> Column:
    return c if w is None else c.over(w)


def safe_corr(a: Column, b: Column, w: WindowSpec | None = None) -> Column:
    """Pearson's correlation within [-1, 1] of the rows that have both; null where either side is constant or has one value.

    What is constant is told by its least and greatest value: partial means are merged with rounding, so the spread of a
    constant column isn't always 0.
    """
    paired = a.isNotNull() & b.isNotNull()
    a, b = (F.when(paired, x.cast("double")) for x in (a, b))
    varies = (_over(F.min(a), w) < _over(F.max(a), w)) & (_over(F.min(b), w) < _over(F.max(b), w))
    value = F.try_divide(_over(F.covar_pop(a, b), w), _over(F.stddev_pop(a), w) * _over(F.stddev_pop(b), w))
    within = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))  # these skip nulls, so null is kept apart
    return F.when(varies & value.isNotNull(), F.when(F.isnan(value), value).otherwise(within))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)
