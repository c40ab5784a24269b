"""The registered queries over the test tables, and the same in DuckDB's SQL.

Doubles are rounded to six places on both sides, as sums of doubles depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.functions.safe import rounded
from alidade.operators import crosssection as cs
from alidade.operators import screening as sc
from alidade.operators import timeseries as ts
from alidade.operators.audit import annual_review, difference, factor_id, manifest
from alidade.plans.grammar import evaluate, generate, long_values, parse, to_sql
from alidade.plans.mining import held_out, labelled_values, recompute
from alidade.sources.tables import daily_panel, monthly_panel

#: Definitions that the screening queries use.
FIXED = ["cs_rank(ts_ret(total,1))", "cs_z(ts_mean(total,3))", "cs_rank(div(total,high))", "cs_z(ts_std(mean,5))"]
GENERATED = generate(["total", "mean", "high", "low"], 24, seed=20)
KEYS = ("instrument", "dt")
#: The last date that screening sees, and the correlation beyond which a factor goes, in the queries.
UNTIL, MOST_ALIKE = "2024-01-20", 0.3


def _round(df: DataFrame, *plain: str) -> DataFrame:
    """All doubles but the plain columns rounded."""
    return df.select(*((rounded(F.col(c)).alias(c) if kind == "double" and c not in plain else F.col(c)) for c, kind in df.dtypes))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return labelled_values(daily_panel(spark, d), FIXED)


def q_daily(spark: SparkSession, d: str) -> DataFrame:
    return _round(daily_panel(spark, d))


def q_monthly(spark: SparkSession, d: str) -> DataFrame:
    return _round(monthly_panel(spark, d))


def q_returns(spark: SparkSession, d: str) -> DataFrame:
    return _round(ts.with_returns(daily_panel(spark, d)).select(*KEYS, "ret", "fwd"))


def q_lags(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("total")
    return _round(daily_panel(spark, d).select(*KEYS, ts.lagged(x, 2).alias("lag2"), ts.lagged(x, -1).alias("lead1"), ts.change(x, 3).alias("change3")))


def q_rolling(spark: SparkSession, d: str) -> DataFrame:
    made = [ts.rolling(k, F.col("total"), 5).alias(f"{k}5") for k in ("mean", "sum", "std", "min", "max")]
    return _round(daily_panel(spark, d).select(*KEYS, *made))


def q_rolling_pairs(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("total"), F.col("high")
    return _round(daily_panel(spark, d).select(*KEYS, ts.rolling_cov(x, y, 5).alias("cov5"), ts.rolling_corr(x, y, 5).alias("corr5")))


def q_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _round(cs.demean(cs.zscore(daily_panel(spark, d), "total", "z"), "total", "centred").select(*KEYS, "z", "centred"))


def q_rank(spark: SparkSession, d: str) -> DataFrame:
    return _round(daily_panel(spark, d).select(*KEYS, cs.average_rank(F.col("n").cast("double")).alias("rank_n"), cs.relative_rank(F.col("total")).alias("rank_total")))


def q_winsorise(spark: SparkSession, d: str) -> DataFrame:
    return _round(cs.winsorise(daily_panel(spark, d), "total", "clipped").select(*KEYS, "clipped"))


def q_residual(spark: SparkSession, d: str) -> DataFrame:
    return _round(cs.residual(ts.with_returns(daily_panel(spark, d)), "ret", "mean", "resid").select(*KEYS, "resid"))


def q_multi_residual(spark: SparkSession, d: str) -> DataFrame:
    return _round(cs.multi_residual(ts.with_returns(daily_panel(spark, d)), "ret", ["mean", "high"], "resid").select(*KEYS, "resid"))


def q_generate(spark: SparkSession, d: str) -> DataFrame:
    values = long_values(evaluate(daily_panel(spark, d), GENERATED), GENERATED)
    return _round(values.groupBy("factor_id").agg(F.count("*").alias("rows"), F.count("value").alias("present"), F.avg("value").alias("value_mean"), F.max(F.abs("value")).alias("value_max")))


def q_evaluate(spark: SparkSession, d: str) -> DataFrame:
    return _round(long_values(evaluate(daily_panel(spark, d), FIXED), FIXED))


def q_ic(spark: SparkSession, d: str) -> DataFrame:
    return _round(sc.information_coefficients(_values(spark, d)).select("factor_id", "dt", "ic", "n", "coverage"))


def q_rank_ic(spark: SparkSession, d: str) -> DataFrame:
    return _round(sc.information_coefficients(_values(spark, d)).select("factor_id", "dt", "rank_ic"))


def q_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round(sc.summary(sc.information_coefficients(_values(spark, d))))


def q_turnover(spark: SparkSession, d: str) -> DataFrame:
    return _round(sc.turnover(_values(spark, d)))


def q_correlations(spark: SparkSession, d: str) -> DataFrame:
    return _round(sc.factor_correlations(_values(spark, d)))


def q_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _round(sc.bucket_means(_values(spark, d)))


def q_held_out(spark: SparkSession, d: str) -> DataFrame:
    return _round(held_out(daily_panel(spark, d), FIXED, UNTIL))


def q_pruned(spark: SparkSession, d: str) -> DataFrame:
    values = _values(spark, d)
    ranking = [(r.factor_id, abs(r.t_ratio or 0.0)) for r in sc.summary(sc.information_coefficients(values)).collect()]
    pairs = [(r.factor_a, r.factor_b, r.correlation) for r in sc.factor_correlations(values).collect()]
    kept = sc.prune_redundant(ranking, pairs, MOST_ALIKE)
    return spark.createDataFrame([(name, name in kept) for name, _ in ranking], "factor_id string, kept boolean")


def q_planted(spark: SparkSession, d: str) -> DataFrame:
    """Differences from a copy in which every seventh instrument is missing and every fifth is off by a half."""
    values = long_values(evaluate(daily_panel(spark, d), FIXED), FIXED)
    off = F.when(F.col("instrument") % 5 == 0, F.col("value") + 0.5).otherwise(F.col("value"))
    return _round(difference(values, values.where("instrument % 7 <> 0").withColumn("value", off)))


def q_recompute(spark: SparkSession, d: str) -> DataFrame:
    panel = daily_panel(spark, d)
    return difference(long_values(evaluate(panel, FIXED), FIXED), recompute(panel, FIXED)).drop("largest")


def q_manifest(spark: SparkSession, d: str) -> DataFrame:
    values = long_values(evaluate(daily_panel(spark, d), FIXED), FIXED)
    definitions = spark.createDataFrame([(factor_id(x), x) for x in FIXED], "factor_id string, definition string")
    sealed = manifest(values, definitions)
    return sealed.select("factor_id", "definition", "n_values", "first_dt", "last_dt", rounded(F.col("value_sum").cast("double"), 3).alias("value_sum"))


def q_review(spark: SparkSession, d: str) -> DataFrame:
    return _round(annual_review(labelled_values(monthly_panel(spark, d), FIXED), base_until=1997))


# DuckDB SQL.

_DAILY = """panel AS (
    SELECT user_id AS instrument, CAST(ts AS DATE) AS dt, CAST(sum(CAST(value AS DECIMAL(24, 4))) AS DOUBLE) AS total, count(value) AS n,
           CAST(sum(CAST(value AS DECIMAL(24, 4))) AS DOUBLE) / nullif(count(value), 0) AS mean, max(value) AS high, min(value) AS low
    FROM events GROUP BY 1, 2)"""
_MONTHLY = """panel AS (
    SELECT l_suppkey AS instrument, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, CAST(sum(CAST(l_quantity AS DECIMAL(24, 4))) AS DOUBLE) AS total,
           count(l_quantity) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(24, 4))) AS DOUBLE) / nullif(count(l_quantity), 0) AS mean,
           max(l_quantity) AS high, min(l_quantity) AS low
    FROM lineitem GROUP BY 1, 2)"""
_PATH = "PARTITION BY instrument ORDER BY dt"
_FIVE = f"{_PATH} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"
_RETURNS = f"""returns AS (
    SELECT *, total / nullif(lag(total) OVER ({_PATH}), 0) - 1 AS ret, lead(total) OVER ({_PATH}) / nullif(total, 0) - 1 AS fwd FROM panel)"""


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) + CAST(0 AS DOUBLE) AS {name}"


def _long(definitions: list[str], panel: str = "panel", label: bool = False) -> str:
    """The long factor values as CTEs over a panel; the last is named vals."""
    keep = ("label",) if label else ()
    source = f"(SELECT *, lead(total) OVER ({_PATH}) / nullif(total, 0) - 1 AS label FROM {panel})" if label else panel
    texts = {str(parse(d)): parse(d).name for d in definitions}
    parts = [f"SELECT '{factor_id(t)}' AS factor_id, instrument, dt, {name} AS value{', label' * label} FROM wide" for t, name in texts.items()]
    return f"wide AS ({to_sql(definitions, source, keep)}), vals AS ({' UNION ALL '.join(parts)})"


_CORR = "covar_pop({x}, {y}) / nullif(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0)"
_ICS = f"""pairs AS (
    SELECT factor_id, dt, label, CASE WHEN label IS NOT NULL THEN round(value, 9) END AS v, CASE WHEN value IS NOT NULL THEN round(label, 9) END AS l,
           CASE WHEN label IS NOT NULL THEN value END AS x, CASE WHEN value IS NOT NULL THEN label END AS y FROM vals),
ranked AS (
    SELECT *,
        CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY factor_id, dt ORDER BY v NULLS LAST) + (count(v) OVER (PARTITION BY factor_id, dt, v) - 1) / CAST(2 AS DOUBLE) END AS rv,
        CASE WHEN l IS NOT NULL THEN rank() OVER (PARTITION BY factor_id, dt ORDER BY l NULLS LAST) + (count(l) OVER (PARTITION BY factor_id, dt, l) - 1) / CAST(2 AS DOUBLE) END AS rl
    FROM pairs),
ics AS (
    SELECT factor_id, dt, {_CORR.format(x="x", y="y")} AS ic, {_CORR.format(x="rv", y="rl")} AS rank_ic, count(v) AS n,
           CAST(count(v) AS DOUBLE) / nullif(count(label), 0) AS coverage FROM ranked GROUP BY 1, 2)"""
_LABELLED = f"WITH {_DAILY}, {_long(FIXED, label=True)}"


def _sql_generate() -> str:
    return (
        f"WITH {_DAILY}, {_long(GENERATED)} SELECT factor_id, count(*) AS rows, count(value) AS present, {_r('avg(value)', 'value_mean')}, {_r('max(abs(value))', 'value_max')} FROM vals GROUP BY 1"
    )


#: name: (query, SQL)
_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "daily_panel": (q_daily, f"WITH {_DAILY} SELECT instrument, dt, {_r('total', 'total')}, n, {_r('mean', 'mean')}, {_r('high', 'high')}, {_r('low', 'low')} FROM panel"),
    "monthly_panel": (q_monthly, f"WITH {_MONTHLY} SELECT instrument, dt, {_r('total', 'total')}, n, {_r('mean', 'mean')}, {_r('high', 'high')}, {_r('low', 'low')} FROM panel"),
    "ts_returns": (q_returns, f"WITH {_DAILY}, {_RETURNS} SELECT instrument, dt, {_r('ret', 'ret')}, {_r('fwd', 'fwd')} FROM returns"),
    "ts_lags": (
        q_lags,
        f"WITH {_DAILY} SELECT instrument, dt, {_r(f'lag(total, 2) OVER ({_PATH})', 'lag2')}, {_r(f'lead(total) OVER ({_PATH})', 'lead1')}, {_r(f'total - lag(total, 3) OVER ({_PATH})', 'change3')} FROM panel",
    ),
    "ts_rolling": (
        q_rolling,
        f"WITH {_DAILY} SELECT instrument, dt, "
        + ", ".join(
            _r(f"CASE WHEN count(total) OVER ({_FIVE}) = 5 THEN {f}(total) OVER ({_FIVE}) END", f"{k}5") for k, f in (("mean", "avg"), ("sum", "sum"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
        )
        + " FROM panel",
    ),
    "ts_rolling_pairs": (
        q_rolling_pairs,
        f"""WITH {_DAILY} SELECT instrument, dt, {_r(f"CASE WHEN count(total) OVER ({_FIVE}) = 5 THEN covar_pop(total, high) OVER ({_FIVE}) END", "cov5")},
        {_r(f"CASE WHEN count(total) OVER ({_FIVE}) = 5 AND stddev_pop(total) OVER ({_FIVE}) * stddev_pop(high) OVER ({_FIVE}) > 1e-12 THEN covar_pop(total, high) OVER ({_FIVE}) / nullif(stddev_pop(total) OVER ({_FIVE}) * stddev_pop(high) OVER ({_FIVE}), 0) END", "corr5")} FROM panel""",
    ),
    "cs_zscore": (
        q_zscore,
        f"""WITH {_DAILY} SELECT instrument, dt, {_r("CASE WHEN stddev_pop(total) OVER (PARTITION BY dt) > 1e-12 THEN (total - avg(total) OVER (PARTITION BY dt)) / nullif(stddev_pop(total) OVER (PARTITION BY dt), 0) END", "z")},
        {_r("total - avg(total) OVER (PARTITION BY dt)", "centred")} FROM panel""",
    ),
    "cs_rank": (
        q_rank,
        f"""WITH {_DAILY} SELECT instrument, dt, {_r("rank() OVER (PARTITION BY dt ORDER BY n) + (count(*) OVER (PARTITION BY dt, n) - 1) / CAST(2 AS DOUBLE)", "rank_n")},
        {_r("(rank() OVER (PARTITION BY dt ORDER BY total) + (count(*) OVER (PARTITION BY dt, total) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY dt)", "rank_total")} FROM panel""",
    ),
    "cs_winsorise": (
        q_winsorise,
        f"""WITH {_DAILY}, limits AS (SELECT dt, quantile_cont(total, 0.05) AS lo, quantile_cont(total, 0.95) AS hi FROM panel GROUP BY dt)
        SELECT instrument, dt, {_r("least(greatest(total, lo), hi)", "clipped")} FROM panel JOIN limits USING (dt)""",
    ),
    "cs_residual": (
        q_residual,
        f"""WITH {_DAILY}, {_RETURNS}, fits AS (SELECT dt, avg(ret) AS my, avg(mean) AS mx, covar_pop(mean, ret) AS c, var_pop(mean) AS v FROM returns WHERE ret IS NOT NULL AND mean IS NOT NULL GROUP BY dt)
        SELECT instrument, dt, {_r("ret - my - coalesce(CASE WHEN v > 1e-12 THEN c / v END, 0) * (mean - mx)", "resid")} FROM returns LEFT JOIN fits USING (dt)""",
    ),
    "cs_multi_residual": (
        q_multi_residual,
        f"""WITH {_DAILY}, {_RETURNS}, m AS (
            SELECT dt, avg(ret) AS my, avg(mean) AS m1, avg(high) AS m2, covar_pop(mean, ret) AS c1, covar_pop(high, ret) AS c2, var_pop(mean) AS v1, var_pop(high) AS v2, covar_pop(mean, high) AS c12
            FROM returns WHERE ret IS NOT NULL GROUP BY dt)
        SELECT instrument, dt, {_r("ret - my - (c1 * v2 - c2 * c12) / nullif(v1 * v2 - c12 * c12, 0) * (mean - m1) - (c2 * v1 - c1 * c12) / nullif(v1 * v2 - c12 * c12, 0) * (high - m2)", "resid")}
        FROM returns LEFT JOIN m USING (dt)""",
    ),
    "generate_factors": (q_generate, _sql_generate()),
    "evaluate_factors": (q_evaluate, f"WITH {_DAILY}, {_long(FIXED)} SELECT factor_id, instrument, dt, {_r('value', 'value')} FROM vals"),
    "screen_ic": (q_ic, f"{_LABELLED}, {_ICS} SELECT factor_id, dt, {_r('ic', 'ic')}, n, {_r('coverage', 'coverage')} FROM ics"),
    "screen_rank_ic": (q_rank_ic, f"{_LABELLED}, {_ICS} SELECT factor_id, dt, {_r('rank_ic', 'rank_ic')} FROM ics"),
    "screen_summary": (
        q_summary,
        f"""{_LABELLED}, {_ICS} SELECT factor_id, count(ic) AS dates, {_r("avg(ic)", "ic_mean")}, {_r("stddev_samp(ic)", "ic_std")}, {_r("avg(rank_ic)", "rank_ic_mean")},
        {_r("avg(CASE WHEN ic IS NOT NULL THEN CAST(ic > 0 AS INTEGER) END)", "positive")}, {_r("avg(coverage)", "coverage")},
        {_r("avg(ic) * sqrt(CAST(count(ic) AS DOUBLE)) / nullif(stddev_samp(ic), 0)", "t_ratio")} FROM ics GROUP BY factor_id""",
    ),
    "screen_turnover": (
        q_turnover,
        f"""{_LABELLED}, pr AS (SELECT *, percent_rank() OVER (PARTITION BY factor_id, dt ORDER BY round(value, 9)) AS pr FROM vals WHERE value IS NOT NULL),
        moves AS (SELECT factor_id, abs(pr - lag(pr) OVER (PARTITION BY factor_id, instrument ORDER BY dt)) AS move FROM pr)
        SELECT factor_id, {_r("avg(move)", "turnover")} FROM moves GROUP BY factor_id""",
    ),
    "screen_correlations": (
        q_correlations,
        f"""{_LABELLED}, v AS (SELECT * FROM vals WHERE value IS NOT NULL)
        SELECT a.factor_id AS factor_a, b.factor_id AS factor_b, {_r(_CORR.format(x="a.value", y="b.value"), "correlation")}, count(*) AS n
        FROM v a JOIN v b ON a.instrument = b.instrument AND a.dt = b.dt AND a.factor_id < b.factor_id GROUP BY 1, 2""",
    ),
    "screen_buckets": (
        q_buckets,
        f"""{_LABELLED}, b AS (SELECT factor_id, label, ntile(5) OVER (PARTITION BY factor_id, dt ORDER BY round(value, 9), instrument) AS bucket FROM vals WHERE value IS NOT NULL AND label IS NOT NULL)
        SELECT factor_id, CAST(bucket AS INTEGER) AS bucket, count(*) AS n, {_r("avg(label)", "label_mean")} FROM b GROUP BY 1, 2""",
    ),
    "screen_held_out": (
        q_held_out,
        f"""{_LABELLED}, {_ICS} SELECT factor_id, count(ic) AS dates, {_r("avg(ic)", "ic_mean")}, {_r("stddev_samp(ic)", "ic_std")}, {_r("avg(rank_ic)", "rank_ic_mean")},
        {_r("avg(CASE WHEN ic IS NOT NULL THEN CAST(ic > 0 AS INTEGER) END)", "positive")}, {_r("avg(coverage)", "coverage")},
        {_r("avg(ic) * sqrt(CAST(count(ic) AS DOUBLE)) / nullif(stddev_samp(ic), 0)", "t_ratio")} FROM ics WHERE dt > DATE '{UNTIL}' GROUP BY factor_id""",
    ),
    "screen_pruned": (
        q_pruned,
        f"""WITH RECURSIVE {_LABELLED[5:]}, {_ICS}, v AS (SELECT * FROM vals WHERE value IS NOT NULL),
        t AS (SELECT factor_id, coalesce(abs(avg(ic) * sqrt(CAST(count(ic) AS DOUBLE)) / nullif(stddev_samp(ic), 0)), 0) AS t FROM ics GROUP BY 1),
        tied AS (SELECT a.factor_id AS a, b.factor_id AS b FROM v a JOIN v b ON a.instrument = b.instrument AND a.dt = b.dt AND a.factor_id <> b.factor_id
                 GROUP BY 1, 2 HAVING abs({_CORR.format(x="a.value", y="b.value")}) > {MOST_ALIKE}),
        places AS (SELECT factor_id, row_number() OVER (ORDER BY t DESC, factor_id) AS k, coalesce((SELECT list(b) FROM tied WHERE a = factor_id), []) AS others FROM t),
        walk(k, names) AS (
            SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[])
            UNION ALL SELECT p.k, CASE WHEN list_has_any(w.names, p.others) THEN w.names ELSE list_append(w.names, p.factor_id) END FROM walk w JOIN places p ON p.k = w.k + 1)
        SELECT factor_id, list_contains((SELECT names FROM walk ORDER BY k DESC LIMIT 1), factor_id) AS kept FROM places""",
    ),
    "recompute_planted": (
        q_planted,
        f"""WITH {_DAILY}, {_long(FIXED)} SELECT factor_id, count(*) AS rows, CAST(sum(CAST(instrument % 7 = 0 AS INTEGER)) AS BIGINT) AS missing,
        CAST(sum(CAST(instrument % 7 <> 0 AND instrument % 5 = 0 AND value IS NOT NULL AS INTEGER)) AS BIGINT) AS beyond,
        {_r("max(CASE WHEN instrument % 7 <> 0 AND value IS NOT NULL THEN CASE WHEN instrument % 5 = 0 THEN 0.5 / greatest(1, abs(value), abs(value + 0.5)) ELSE 0 END END)", "largest")} FROM vals GROUP BY 1""",
    ),
    "recompute_difference": (
        q_recompute,
        f"WITH {_DAILY}, {_long(FIXED)} SELECT factor_id, count(*) AS rows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS beyond FROM vals GROUP BY 1",
    ),
    "freeze_manifest": (
        q_manifest,
        f"WITH {_DAILY}, {_long(FIXED)}, names(factor_id, definition) AS (VALUES {', '.join(f"('{factor_id(d)}', '{d}')" for d in FIXED)}) "
        "SELECT factor_id, any_value(definition) AS definition, count(*) AS n_values, min(dt) AS first_dt, max(dt) AS last_dt, round(CAST(sum(CAST(round(value, 8) AS DECIMAL(28, 8))) AS DOUBLE), 3) + CAST(0 AS DOUBLE) AS value_sum "
        "FROM vals JOIN names USING (factor_id) WHERE value IS NOT NULL GROUP BY 1",
    ),
    "annual_review": (
        q_review,
        f"""WITH {_MONTHLY}, {_long(FIXED, label=True)}, {_ICS}, y AS (SELECT *, year(dt) AS year FROM ics),
        base AS (SELECT factor_id, avg(ic) AS base_ic FROM y WHERE year <= 1997 GROUP BY 1),
        years AS (SELECT factor_id, CAST(year AS INTEGER) AS year, count(ic) AS dates, avg(ic) AS ic_mean FROM y WHERE year > 1997 GROUP BY 1, 2)
        SELECT factor_id, year, dates, {_r("ic_mean", "ic_mean")}, {_r("base_ic", "base_ic")},
               CASE WHEN dates < 6 THEN 'short' WHEN base_ic IS NULL OR ic_mean IS NULL OR ic_mean * base_ic <= 0 THEN 'retire'
                    WHEN abs(ic_mean) >= least(CAST(0.02 AS DOUBLE), abs(base_ic) / 2) THEN 'keep' ELSE 'watch' END AS status
        FROM years LEFT JOIN base USING (factor_id)""",
    ),
}

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items()}
