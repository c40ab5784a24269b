"""Arithmetic that yields null where the result is undefined, and moments in which it matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and infinities as null, so that null alone means missing."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null if b is 0 or either is null."""
    return F.try_divide(a, b)


def positive_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def rounded(x: Column, places: int = 6) -> Column:
    """Rounded for comparisons; never a negative zero."""
    return F.round(x, places) + F.lit(0.0)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows where both are present, null if one is constant; for aggregates."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def exact_sum(x: Column, scale: int = 4) -> Column:
    """A sum that does not depend on the order of rows: terms are rounded to `scale` places as decimals; null if one is too large for that, from 1e20 on at 4 places."""
    terms = x.try_cast(f"decimal(24,{scale})")
    return F.when(F.count(terms) == F.count(x), F.sum(terms).cast("double"))
