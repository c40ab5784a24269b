"""Screening statistics of factors against a forward label.

Factor values are long: factor_id, instrument, dt, value, label. Each statistic is one aggregation
by date and factor, combined before its shuffle. What follows works on one row a date and factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alidade.functions.safe import correlation, ratio


def information_coefficients(values: DataFrame) -> DataFrame:
    """factor_id, dt, ic (correlation of value and label), rank_ic (of their average ranks), n (pairs), coverage (pairs by labels)."""
    both = F.col("value").isNotNull() & F.col("label").isNotNull()
    pair = values.withColumns({"v": F.when(both, F.round("value", 9)), "l": F.when(both, F.round("label", 9))})

    def rank(c: str):  # noqa: ANN202
        within = Window.partitionBy("factor_id", "dt")
        return F.when(F.col(c).isNotNull(), F.rank().over(within.orderBy(F.col(c).asc_nulls_last())) + (F.count(c).over(Window.partitionBy("factor_id", "dt", c)) - 1) / 2.0)

    ranked = pair.withColumns({"rv": rank("v"), "rl": rank("l")})
    out = ranked.groupBy("factor_id", "dt").agg(
        correlation(F.when(both, F.col("value")), F.when(both, F.col("label"))).alias("ic"),
        correlation(F.col("rv"), F.col("rl")).alias("rank_ic"),
        F.count("v").alias("n"),
        ratio(F.count("v").cast("double"), F.count("label")).alias("coverage"),
    )
    return out


def summary(ics: DataFrame) -> DataFrame:
    """One row a factor: dates, mean and deviation of the ic, the t-like ratio mean / deviation * sqrt(dates), the share of positive dates, coverage."""
    rows = ics.groupBy("factor_id").agg(
        F.count("ic").alias("dates"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg("rank_ic").alias("rank_ic_mean"),
        F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("positive"), F.avg("coverage").alias("coverage"),
    )
    return rows.withColumn("t_ratio", ratio(F.col("ic_mean") * F.sqrt(F.col("dates").cast("double")), F.col("ic_std")))


def turnover(values: DataFrame) -> DataFrame:
    """factor_id, turnover: the mean change of an instrument's relative rank from one of its observations to the next."""
    day = Window.partitionBy("factor_id", "dt")
    rank = F.percent_rank().over(day.orderBy(F.round("value", 9)))
    path = Window.partitionBy("factor_id", "instrument").orderBy("dt")
    ranked = values.where("value is not null").withColumn("pr", rank)
    return ranked.withColumn("move", F.abs(F.col("pr") - F.lag("pr").over(path))).groupBy("factor_id").agg(F.avg("move").alias("turnover"))


def bucket_means(values: DataFrame, buckets: int = 5) -> DataFrame:
    """factor_id, bucket, n, label_mean: labels by the date's equal-sized buckets of value, equal values going by instrument."""
    order = Window.partitionBy("factor_id", "dt").orderBy(F.round("value", 9), "instrument")
    rows = values.where("value is not null and label is not null").withColumn("bucket", F.ntile(buckets).over(order))
    return rows.groupBy("factor_id", "bucket").agg(F.count("*").alias("n"), F.avg("label").alias("label_mean"))


def factor_correlations(values: DataFrame) -> DataFrame:
    """factor_a < factor_b and their pooled correlation over the instruments and dates where both are present.

    A row's factors are gathered first (as many as there are factors), so no pair of rows is joined.
    """
    gathered = values.where("value is not null").groupBy("instrument", "dt").agg(F.sort_array(F.collect_list(F.struct("factor_id", "value"))).alias("fs"))
    pairs = gathered.select(F.explode(F.flatten(F.transform("fs", lambda a, i: F.transform(F.slice("fs", i + 2, F.size("fs")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    named = pairs.select(F.col("p.a.factor_id").alias("factor_a"), F.col("p.b.factor_id").alias("factor_b"), F.col("p.a.value").alias("x"), F.col("p.b.value").alias("y"))
    return named.groupBy("factor_a", "factor_b").agg(correlation(F.col("x"), F.col("y")).alias("correlation"), F.count("*").alias("n"))


def prune_redundant(ranking: list[tuple[str, float]], pairs: list[tuple[str, str, float]], most: float = 0.9) -> list[str]:
    """The factors that stay when, best first, each one goes that correlates by more than `most` with one that stays.

    Works on the names of one bounded batch of factors, on the driver.
    """
    tied = {frozenset((a, b)) for a, b, c in pairs if c is not None and abs(c) > most}
    kept: list[str] = []
    for name, _ in sorted(ranking, key=lambda r: (-r[1], r[0])):
        if not any(frozenset((name, k)) in tied for k in kept):
            kept.append(name)
    return kept
