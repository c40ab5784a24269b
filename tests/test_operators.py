import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from alidade.functions.safe import correlation
from alidade.operators import crosssection as cs
from alidade.operators import screening as sc
from alidade.operators import timeseries as ts
from alidade.sources.tables import build_panel, read_panel, write_panel

DAY = [dt.date(2024, 1, d) for d in range(1, 32)]
SCHEMA = "instrument long, dt date, x double, y double"


def frame(spark, rows):
    return spark.createDataFrame([(i, DAY[d], x, y) for i, d, x, y in rows], SCHEMA)


def test_empty(spark):
    empty = frame(spark, [])
    assert cs.zscore(empty, "x", "z").count() == 0 and cs.multi_residual(empty, "y", ["x"], "r").count() == 0
    assert empty.select(ts.rolling("mean", F.col("x"), 3)).count() == 0


def test_rolling_needs_all_values(spark):
    rows = frame(spark, [(1, 0, 1.0, 0.0), (1, 3, None, 0.0), (1, 4, 3.0, 0.0), (1, 5, 5.0, 0.0)])
    got = [r[0] for r in rows.select(ts.rolling("mean", F.col("x"), 2).alias("m"), "dt").orderBy("dt").collect()]
    assert got == [None, None, None, 4.0]


def test_constant_inputs_give_null(spark):
    rows = frame(spark, [(i, d, 2.0, float(i)) for i in range(3) for d in range(3)])
    assert rows.groupBy("dt").agg(correlation(F.col("x"), F.col("y")).alias("c")).first().c is None
    assert {r.z for r in cs.zscore(rows, "x", "z").collect()} == {None}
    assert {r[0] for r in rows.select(ts.rolling_corr(F.col("x"), F.col("y"), 2)).collect()} == {None}
    assert [round(r.r, 9) for r in cs.residual(rows.where("dt = '2024-01-01'"), "y", "x", "r").orderBy("instrument").collect()] == [-1.0, 0.0, 1.0]


def test_forward_return_is_no_lookahead_for_factors(spark):
    rows = frame(spark, [(1, 0, 1.0, 0.0), (1, 1, 2.0, 0.0), (1, 2, 0.0, 0.0), (1, 3, 5.0, 0.0)])
    got = ts.with_returns(rows, "x").orderBy("dt").collect()
    assert [r.ret for r in got] == [None, 1.0, -1.0, None] and [r.fwd for r in got] == [1.0, -1.0, None, None]


def test_ranks_with_ties_and_nulls(spark):
    rows = frame(spark, [(1, 0, 1.0, 0.0), (2, 0, 1.0, 0.0), (3, 0, 4.0, 0.0), (4, 0, None, 0.0)])
    got = {r.instrument: r.k for r in rows.select("instrument", cs.average_rank(F.col("x")).alias("k")).collect()}
    assert got == {1: 1.5, 2: 1.5, 3: 3.0, 4: None}


def test_winsorise(spark):
    rows = frame(spark, [(i, 0, float(i), 0.0) for i in range(101)] + [(200, 0, None, 0.0)])
    got = {r.instrument: r.w for r in cs.winsorise(rows, "x", "w").collect()}
    assert got[0] == 5.0 and got[100] == 95.0 and got[50] == 50.0 and got[200] is None


def test_multi_residual(spark):
    rng = np.random.default_rng(1)
    data = [(i, d, float(rng.normal()), float(rng.normal())) for i in range(20) for d in range(2)]
    rows = frame(spark, data).withColumn("z", F.col("x") * F.col("x"))
    got = {(r.instrument, r.dt): r.r for r in cs.multi_residual(rows, "y", ["x", "z"], "r").collect()}
    for d in range(2):
        part = [(i, x, y) for i, day, x, y in data if day == d]
        a = np.array([[1, x, x * x] for _, x, _ in part])
        y = np.array([y for *_, y in part])
        left = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        assert all(math.isclose(got[i, DAY[d]], e, abs_tol=1e-8) for (i, _, _), e in zip(part, left, strict=True))


def values(spark):
    rng = np.random.default_rng(2)
    rows = [(f, i, DAY[d], float(rng.integers(0, 5)) if rng.random() < 0.9 else None, float(rng.normal()) if rng.random() < 0.9 else None) for f in "ab" for i in range(12) for d in range(8)]
    return rows, spark.createDataFrame(rows, "factor_id string, instrument long, dt date, value double, label double")


def mean_ranks(x):
    order = sorted(x)
    return [statistics.mean(k + 1 for k, v in enumerate(order) if v == w) for w in x]


def test_information_coefficients(spark):
    rows, df = values(spark)
    for r in sc.information_coefficients(df).collect():
        pairs = [(v, y) for f, _, d, v, y in rows if f == r.factor_id and d == r.dt and v is not None and y is not None]
        xs, ys = zip(*pairs, strict=True)
        assert math.isclose(r.ic, np.corrcoef(xs, ys)[0, 1], abs_tol=1e-9) and r.n == len(pairs)
        assert math.isclose(r.rank_ic, np.corrcoef(mean_ranks(xs), mean_ranks(ys))[0, 1], abs_tol=1e-9)


def test_summary_and_pruning(spark):
    _, df = values(spark)
    rows = sc.summary(sc.information_coefficients(df)).collect()
    assert {r.factor_id for r in rows} == {"a", "b"} and all(r.dates == 8 for r in rows)
    assert sc.prune_redundant([("a", 3.0), ("b", 2.0), ("c", 2.0)], [("a", "b", -0.95), ("b", "c", 0.99), ("a", "c", None)]) == ["a", "c"]
    assert sc.prune_redundant([], []) == []


def test_panel_does_not_depend_on_partitioning(spark):
    rows = spark.createDataFrame([(i % 5, DAY[i % 7], 0.1 * i) for i in range(500)] + [(1, DAY[0], float("nan"))], "k long, d date, v double")
    a, b = (sorted(build_panel(rows.repartition(n), F.col("k"), F.col("d"), F.col("v")).collect()) for n in (1, 7))
    assert a == b


def test_values_too_large_for_an_exact_sum(spark):
    rows = spark.createDataFrame([(1, DAY[0], 1e21), (1, DAY[0], 2.0), (2, DAY[0], 3.00004), (3, DAY[0], None)], "k long, d date, v double")
    got = {r.instrument: (r.total, r.n, r.high) for r in build_panel(rows, F.col("k"), F.col("d"), F.col("v")).collect()}
    assert got == {1: (None, 2, 1e21), 2: (3.0, 1, 3.00004), 3: (None, 0, None)}


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_formats(spark, tmp_path, kind):
    rows = frame(spark, [(1, 0, 1.5, None), (2, 1, None, 2.0)])
    rows.write.format(kind).option("header", True).save(str(tmp_path / kind))
    assert sorted(map(str, read_panel(spark, str(tmp_path / kind), ["x", "y"], kind).collect())) == sorted(map(str, rows.collect()))


def test_nan_is_null_and_nothing_is_replaced(spark, tmp_path):
    rows = frame(spark, [(1, 0, float("nan"), float("inf"))])
    write_panel(rows, str(tmp_path / "p"))
    assert read_panel(spark, str(tmp_path / "p"), ["x", "y"]).first()[2:] == (None, None)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_panel(rows, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        read_panel(spark, str(tmp_path / "p"), ["x"], "xml")
