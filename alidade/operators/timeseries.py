"""Operators along an instrument's own observations, in order of date.

Windows count observations, not calendar days: the observation before is the last one that exists. A
window with fewer than n present values gives null. All share the partitioning by
instrument, so that any number of them needs one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from alidade.functions.safe import ratio


def along(n: int | None = None) -> WindowSpec:
    """An instrument's history, or its last n observations up to this one."""
    w = Window.partitionBy("instrument").orderBy("dt")
    return w if n is None else w.rowsBetween(1 - n, 0)


def lagged(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(along()) if n >= 0 else F.lead(x, -n).over(along())


def change(x: Column, n: int = 1) -> Column:
    return x - lagged(x, n)


def period_return(x: Column, n: int = 1) -> Column:
    return ratio(x, lagged(x, n)) - F.lit(1.0)


def forward_return(x: Column, n: int = 1) -> Column:
    """From this observation to the n-th after it: a label for screening, never part of a factor."""
    return ratio(lagged(x, -n), x) - F.lit(1.0)


def rolling(kind: str, x: Column, n: int) -> Column:
    """mean, sum, std (population), min or max of the last n observations."""
    make = {"mean": F.avg, "sum": F.sum, "std": F.stddev_pop, "min": F.min, "max": F.max}[kind]
    return F.when(F.count(x).over(along(n)) == n, make(x).over(along(n)))


def rolling_cov(x: Column, y: Column, n: int) -> Column:
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.when(F.count(x).over(along(n)) == n, F.covar_pop(x, y).over(along(n)))


def rolling_corr(x: Column, y: Column, n: int) -> Column:
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x).over(along(n)) * F.stddev_pop(y).over(along(n))
    # A window of equal values may leave a rest of rounding; such spreads count as none.
    return F.when(spread > 1e-12, ratio(rolling_cov(x, y, n), spread))


def with_returns(panel: DataFrame, field: str = "total") -> DataFrame:
    """The panel with ret, from the observation before, and fwd, to the one after."""
    return panel.withColumns({"ret": period_return(F.col(field)), "fwd": forward_return(F.col(field))})
