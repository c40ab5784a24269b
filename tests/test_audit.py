import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from alidade.__main__ import main
from alidade.operators.audit import annual_review, fingerprints, panel_fingerprint, read_freeze, verify_freeze
from alidade.plans.grammar import generate
from alidade.plans.mining import Thresholds, false_discovery_limit, held_out, screen, seal
from alidade.streaming.panels import streaming_daily_panel


def panel(spark):
    rng = random.Random(9)
    rows, level = [], {}
    for d in range(60):
        for i in range(15):
            level[i] = max(level.get(i, 100.0) * (1 + rng.gauss(0, 0.02) + 0.002 * (i - 7)), 1.0)
            rows.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=d * 20), level[i], rng.random()))
    return spark.createDataFrame(rows, "instrument long, dt date, total double, noise double")


def test_mine_and_freeze(spark, tmp_path):
    p = panel(spark)
    found = screen(p, ["cs_rank(ts_ret(total,2))", "cs_z(ts_ret(total,2))", "cs_rank(noise)"], "2022-06-01", Thresholds(least_t=2.0, most_correlation=0.8))
    assert len(found.statistics) == 3 and len(found.accepted) == 1 and "ts_ret" in found.accepted[0]
    sealed = seal(p, found.accepted, str(tmp_path), "first", seed=1)
    assert sealed.count() == 1 and sealed.first().definition == found.accepted[0]
    assert verify_freeze(spark, str(tmp_path), "first").first().intact
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        seal(p, found.accepted, str(tmp_path), "first")
    values, _ = read_freeze(spark, str(tmp_path), "first")
    moved = values.withColumn("value", F.when(F.col("instrument") == 1, F.col("value") + 1e-6).otherwise(F.col("value")))
    assert fingerprints(moved).first().value_sum != fingerprints(values).first().value_sum
    assert fingerprints(values.repartition(7)).collect() == fingerprints(values.coalesce(1)).collect()


def test_large_values_have_fingerprints(spark):
    rows = [("f", k, dt.date(2020, 1, 1), v) for k, v in enumerate((1e21, -1e300, 2.0))]
    df = spark.createDataFrame(rows, "factor_id string, instrument long, dt date, value double")
    first = fingerprints(df).first()
    other = fingerprints(df.withColumn("value", F.when(F.col("instrument") == 0, 2e21).otherwise(F.col("value")))).first()
    assert first.n_values == 3 and first.value_sum is not None and first.value_sum != other.value_sum


def test_panel_fingerprint(spark):
    p = panel(spark)
    assert panel_fingerprint(p) == panel_fingerprint(p.repartition(5).select(*reversed(p.columns))) != panel_fingerprint(p.where("instrument > 0"))
    two = [spark.createDataFrame([r], "a long, b long") for r in ((None, 1), (1, None))]
    assert panel_fingerprint(two[0]) != panel_fingerprint(two[1]) and panel_fingerprint(two[0].limit(0)) == "0:0"


def test_screening_in_batches_and_held_out_dates(spark):
    p = panel(spark)
    definitions = ["cs_rank(ts_ret(total,2))", "cs_z(ts_ret(total,2))", "cs_rank(ts_ret(total,3))", "cs_rank(noise)", "cs_z(total)"]
    rules = Thresholds(least_t=0.0, least_coverage=0.0, most_correlation=0.8)
    assert screen(p, definitions, "2022-06-01", rules, batch=2).accepted == screen(p, definitions, "2022-06-01", rules).accepted
    seen = {r["factor_id"]: r["dates"] for r in screen(p, definitions, "2022-06-01", rules).statistics}
    later = {r.factor_id: r.dates for r in held_out(p, definitions, "2022-06-01").collect()}
    every = {r.factor_id: r.dates for r in held_out(p, definitions, "1900-01-01").collect()}
    assert set(later) == set(seen) and all(seen[k] + later[k] == every[k] and later[k] > 0 for k in seen)


def test_false_discoveries():
    ratios = [5.0, -4.0, 2.1, 0.3, -0.1]
    assert false_discovery_limit(ratios, 1.0) == 0.1 and false_discovery_limit(ratios, 0.05) == 4.0
    assert false_discovery_limit(ratios, 0.06) == 2.1 and false_discovery_limit([0.5], 0.05) == math.inf and false_discovery_limit([], 0.05) == math.inf


def test_command_line(spark, tmp_path, capsys):
    panel(spark).write.parquet(str(tmp_path / "panel"))
    args = [str(tmp_path / "panel"), "--fields", "total", "noise", "--count", "6", "--seed", "3", "--until", "2022-06-01", "--least-t", "0.5", "--review-after", "2021"]
    main([*args, "--store", str(tmp_path / "store"), "--name", "first"], spark)
    out = json.loads(capsys.readouterr().out)
    assert out["screened"] == 6 and out["accepted"] and out["intact"] is True and len(out["held_out"]) == len(out["accepted"])
    assert {r["year"] for r in out["review"]} <= {2022, 2023}
    main([*args, "--least-t", "1000"], spark)
    out = json.loads(capsys.readouterr().out)
    assert out["accepted"] == [] and "intact" not in out


def test_review(spark):
    rng = random.Random(4)
    rows = []
    for year, sign in ((2019, 1), (2020, 1), (2021, -1)):
        for month in range(1, 13):
            for i in range(10):
                x = rng.random()
                rows.append(("f", i, dt.date(year, month, 1), x, sign * x + 0.1 * rng.random()))
    rows.append(("f", 1, dt.date(2022, 1, 1), 1.0, None))
    got = {r.year: r.status for r in annual_review(spark.createDataFrame(rows, "factor_id string, instrument long, dt date, value double, label double"), 2019).collect()}
    assert got == {2020: "keep", 2021: "retire", 2022: "short"}


def test_generated_factors_run_in_one_plan(spark):
    assert len(screen(panel(spark), generate(["total", "noise"], 6, 2), "2021-01-01").statistics) == 6


def test_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, h), u, float(d + h)) for d in (1, 2, 3, 9) for h in (1, 5) for u in (1, 2)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(str(tmp_path / "in"))
    query = streaming_daily_panel(stream).writeStream.format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.instrument, r.dt.day): r.total for r in spark.table("daily").collect()}
    assert got[1, 1] == 8.0 and (1, 9) not in got  # the last day is still open
