"""Operators across the instruments of a date.

What needs moments alone joins one aggregated row a date back to the panel, so the panel itself isn't shuffled by
date when that side is small, and the aggregation is combined before its shuffle. Ranks need the rows of a date
together: a date has one row an instrument.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alidade.functions.safe import ratio


def by_date(df: DataFrame, *aggregates: Column) -> DataFrame:
    """df joined with aggregates of its own dates."""
    return df.join(df.groupBy("dt").agg(*aggregates), "dt", "left")


def zscore(df: DataFrame, field: str, out: str) -> DataFrame:
    """(x - mean) / population deviation of the date; null if all are equal."""
    rows = by_date(df, F.avg(field).alias("_m"), F.stddev_pop(field).alias("_s"))
    return rows.withColumn(out, F.when(F.col("_s") > 1e-12, ratio(F.col(field) - F.col("_m"), F.col("_s")))).drop("_m", "_s")


def demean(df: DataFrame, field: str, out: str) -> DataFrame:
    return by_date(df, F.avg(field).alias("_m")).withColumn(out, F.col(field) - F.col("_m")).drop("_m")


def average_rank(x: Column, places: int = 9) -> Column:
    """Rank within the date from 1, equal values (to `places` places) sharing the mean of their ranks; null for null."""
    x = F.round(x, places)
    same = Window.partitionBy("dt", x)
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy("dt").orderBy(x.asc_nulls_last())) + (F.count(x).over(same) - 1) / 2.0)


def relative_rank(x: Column) -> Column:
    """average_rank over the number of present values of the date: in (0, 1]."""
    return ratio(average_rank(x), F.count(x).over(Window.partitionBy("dt")))


def winsorise(df: DataFrame, field: str, out: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Values beyond the date's quantiles (linear between neighbours) are set to these."""
    rows = by_date(df, F.percentile(field, F.lit(low)).alias("_l"), F.percentile(field, F.lit(high)).alias("_h"))
    return rows.withColumn(out, F.when(F.col(field).isNotNull(), F.least(F.greatest(field, "_l"), F.col("_h")))).drop("_l", "_h")


def residual(df: DataFrame, y: str, x: str, out: str) -> DataFrame:
    """What a line in x leaves of y within the date; the mean is what is taken off where x is constant."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    ys, xs = F.when(both, F.col(y)), F.when(both, F.col(x))
    rows = by_date(df, F.avg(ys).alias("_my"), F.avg(xs).alias("_mx"), F.covar_pop(xs, ys).alias("_c"), F.var_pop(xs).alias("_v"))
    slope = F.coalesce(F.when(F.col("_v") > 1e-12, ratio(F.col("_c"), F.col("_v"))), F.lit(0.0))
    return rows.withColumn(out, F.when(both, F.col(y) - F.col("_my") - slope * (F.col(x) - F.col("_mx")))).drop("_my", "_mx", "_c", "_v")


def multi_residual(df: DataFrame, y: str, xs: list[str], out: str) -> DataFrame:
    """What a least-squares fit on xs and a constant leaves of y within the date; rows with a null in any of them get null.

    The normal equations of a date are sums, so they are aggregated before the shuffle; each date's small
    system is solved in pandas and its coefficients are joined back.
    """
    names = ["_1", *xs]
    terms = {"_1": F.lit(1.0), **{x: F.col(x) for x in xs}}
    whole = df.where(F.concat_ws("", *(F.when(F.col(c).isNull(), "x") for c in [y, *xs])) == "")
    sums = [F.sum(terms[a] * terms[b]).alias(f"a{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums += [F.sum(terms[a] * F.col(y)).alias(f"b{i}") for i, a in enumerate(names)]
    schema = T.StructType([T.StructField("dt", df.schema["dt"].dataType), *(T.StructField(f"_k{i}", T.DoubleType()) for i in range(len(names)))])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for rows in batches:
            out_rows = []
            for r in rows.itertuples(index=False):
                a = np.array([[getattr(r, f"a{min(i, j)}_{max(i, j)}") for j in range(len(names))] for i in range(len(names))])
                b = np.array([getattr(r, f"b{i}") for i in range(len(names))])
                out_rows.append((r.dt, *np.linalg.lstsq(a, b, rcond=1e-12)[0]))
            yield pd.DataFrame(out_rows, columns=schema.names)

    fits = whole.groupBy("dt").agg(*sums).mapInPandas(solve, schema)
    rows = df.join(fits, "dt", "left")
    fit = sum((F.col(f"_k{i}") * terms[a] for i, a in enumerate(names)), F.lit(0.0))
    return rows.withColumn(out, F.col(y) - fit).drop(*(f"_k{i}" for i in range(len(names))))
