import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alidade.plans.grammar import Expr, evaluate, generate, layers, long_values, parse, to_sql
from alidade.plans.mining import check, recompute


def panel(spark, rows):
    return spark.createDataFrame([(i, dt.date(2024, 1, d), x, y) for i, d, x, y in rows], "instrument long, dt date, a double, b double")


def some_panel(spark):
    rng = random.Random(3)
    rows = [(i, d, rng.choice([None, 0.0, 1.0, rng.random() * 10]), rng.random()) for i in range(6) for d in range(1, 13) if rng.random() < 0.85]
    return panel(spark, rows)


@pytest.mark.parametrize("text", ["a", "add(a,b)", "cs_rank(ts_mean(div(a,b),5))", "ts_corr(a,b,3)"])
def test_round_trip(text):
    assert str(parse(text)) == text


def test_canonical():
    assert str(parse(" add( b , a ) ")) == "add(a,b)" and parse("add(b,a)").name == parse("add(a,b)").name


@pytest.mark.parametrize("text", ["", "add(a)", "add(a,b,c)", "ts_mean(a)", "ts_mean(a,0)", "no(a)", "add(a,b", "a b", "add(a,b))", "a;drop"])
def test_refused(text):
    with pytest.raises(ValueError):
        parse(text)


@given(st.integers(0, 10_000), st.integers(1, 30))
@settings(max_examples=30, deadline=None)
def test_generate(seed, count):
    made = generate(["a", "b"], count, seed)
    assert made == generate(["a", "b"], count, seed) and len(set(made)) == len(made) == count
    assert all(str(parse(d)) == d for d in made)


def test_layers_share_parts():
    made = layers([parse("cs_rank(ts_mean(a,3))"), parse("cs_z(ts_mean(a,3))")], ["a"])
    assert [[p.kind for p in layer] for layer in made] == [["ts"], ["cs", "cs"]]
    with pytest.raises(ValueError):
        layers([Expr("c")], ["a"])


def test_values_by_hand(spark):
    rows = evaluate(panel(spark, [(1, 1, 1.0, 2.0), (1, 2, 3.0, 0.0), (1, 5, None, 4.0), (2, 1, 5.0, 2.0)]), ["ts_delta(a,1)", "div(a,b)", "cs_rank(a)", "log(b)"])
    got = {(r.instrument, r.dt.day): r[2:] for r in rows.collect()}
    assert got[1, 2][:2] == (2.0, None) and got[1, 5][0] is None and got[1, 1][2] == 0.5 and got[2, 1][2] == 1.0 and got[1, 2][3] is None


def test_two_paths_agree(spark):
    made = generate(["a", "b"], 12, 5)
    rows = check(some_panel(spark), made).collect()
    assert len(rows) == len(made) and all(r.missing == 0 and r.beyond == 0 for r in rows)


def test_difference_shows(spark):
    from alidade.operators.audit import difference

    p = some_panel(spark)
    values = long_values(evaluate(p, ["cs_rank(a)"]), ["cs_rank(a)"])
    other = recompute(p.where("instrument <> 3"), ["cs_rank(a)"])
    row = difference(values, other).first()
    assert row.missing >= p.where("instrument = 3").count() and row.beyond > 0


def test_sql_is_text_alone():
    assert to_sql(["cs_z(ts_mean(a,2))"], "t").startswith("WITH l0 AS (SELECT instrument, dt, CAST(a AS DOUBLE) AS a FROM t)")


def test_plan_has_one_exchange_a_kind(spark):
    df = evaluate(some_panel(spark), ["cs_rank(ts_mean(a,3))", "cs_z(ts_std(b,3))", "cs_rank(ts_corr(a,b,3))"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(instrument") <= 1 and plan.count("Exchange hashpartitioning(dt") <= 1
