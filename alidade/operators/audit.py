"""Recomputation, freezing and annual review."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.functions.safe import ratio
from alidade.operators.screening import information_coefficients

#: Places to which values are rounded before they are summed for a fingerprint.
PLACES = 8


def factor_id(definition: str) -> str:
    return hashlib.sha256(definition.encode()).hexdigest()


def difference(first: DataFrame, second: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """factor_id, rows, missing (present in one only), beyond (differ by more than tolerance, relative above 1), largest (difference).

    Both have factor_id, instrument, dt, value. One full outer join on the whole key.
    """
    keys = ["factor_id", "instrument", "dt"]
    a = first.select(*keys, F.col("value").alias("x"), F.lit(1).alias("in_a"))
    b = second.select(*keys, F.col("value").alias("y"), F.lit(1).alias("in_b"))
    gap = F.abs(F.col("x") - F.col("y"))
    scale = F.greatest(F.lit(1.0), F.abs("x"), F.abs("y"))
    lone = F.col("in_a").isNull() | F.col("in_b").isNull() | (F.col("x").isNull() != F.col("y").isNull())
    return a.join(b, keys, "full_outer").groupBy("factor_id").agg(
        F.count("*").alias("rows"), F.sum(lone.cast("long")).alias("missing"),
        F.sum(F.coalesce((gap > tolerance * scale).cast("long"), F.lit(0))).alias("beyond"), F.max(ratio(gap, scale)).alias("largest"),
    )


def fingerprints(values: DataFrame) -> DataFrame:
    """factor_id, n_values, first_dt, last_dt, value_sum, key_sum: sums that do not depend on the order or partitioning of rows.

    value_sum is of values as decimals, a hash standing for those of 1e20 or more; key_sum weighs each with a hash of its place, so that swapped values show.
    """
    large = F.pmod(F.xxhash64("value"), F.lit(10**18)).cast(f"decimal(28,{PLACES})")
    v = F.coalesce(F.round("value", PLACES).try_cast(f"decimal(28,{PLACES})"), large)
    spot = F.pmod(F.xxhash64("instrument", "dt"), F.lit(9973))
    present = values.where("value is not null")
    return present.groupBy("factor_id").agg(
        F.count("*").alias("n_values"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"),
        F.sum(v).cast(f"decimal(38,{PLACES})").alias("value_sum"), F.sum((v * spot).cast(f"decimal(32,{PLACES})")).cast(f"decimal(38,{PLACES})").alias("key_sum"),
    )


def panel_fingerprint(panel: DataFrame) -> str:
    """Rows and sum of row hashes of a panel, whatever the order of its rows and columns; nulls count by their place."""
    names = sorted(panel.columns)
    each = F.xxhash64(*names, *(F.col(c).isNull() for c in names)).cast("decimal(38,0)")
    rows, total = panel.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return f"{rows}:{total}"


def manifest(values: DataFrame, definitions: DataFrame, evidence: dict[str, str] | None = None) -> DataFrame:
    """fingerprints with the definition and a canonical string of evidence (versions, inputs, seed)."""
    note = json.dumps(evidence or {}, sort_keys=True, separators=(",", ":"))
    return fingerprints(values).join(definitions.select("factor_id", "definition"), "factor_id").withColumn("evidence", F.lit(note))


def freeze(values: DataFrame, definitions: DataFrame, store: str, name: str, evidence: dict[str, str] | None = None) -> DataFrame:
    """Write values and manifest as a freeze of that name, once: an existing one raises. Returns the manifest as written."""
    spark = values.sparkSession
    values.select("factor_id", "instrument", "dt", "value").write.mode("errorifexists").partitionBy("factor_id").parquet(f"{store}/{name}/values")
    written = spark.read.parquet(f"{store}/{name}/values")
    manifest(written, definitions, evidence).write.mode("errorifexists").parquet(f"{store}/{name}/manifest")
    return spark.read.parquet(f"{store}/{name}/manifest")


def read_freeze(spark: SparkSession, store: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Values and manifest."""
    return spark.read.parquet(f"{store}/{name}/values"), spark.read.parquet(f"{store}/{name}/manifest")


def verify_freeze(spark: SparkSession, store: str, name: str) -> DataFrame:
    """factor_id, intact: whether the values of a freeze still have the fingerprints of its manifest."""
    values, sealed = read_freeze(spark, store, name)
    now = fingerprints(values).select("factor_id", F.struct("n_values", "first_dt", "last_dt", "value_sum", "key_sum").alias("now"))
    then = sealed.select("factor_id", F.struct("n_values", "first_dt", "last_dt", "value_sum", "key_sum").alias("then"))
    return then.join(now, "factor_id", "left").select("factor_id", F.coalesce(F.col("then") == F.col("now"), F.lit(False)).alias("intact"))


def annual_review(values: DataFrame, base_until: int, least_ic: float = 0.02, least_dates: int = 6) -> DataFrame:
    """factor_id, year, dates, ic_mean, base_ic, status of each year after base_until.

    base_ic is the mean ic of the years up to base_until. keep: the same sign, and at least half of its
    size or least_ic; watch: the same sign but weaker; retire: another sign; short: fewer dates than least_dates.
    """
    ics = information_coefficients(values).withColumn("year", F.year("dt"))
    base = ics.where(F.col("year") <= base_until).groupBy("factor_id").agg(F.avg("ic").alias("base_ic"))
    years = ics.where(F.col("year") > base_until).groupBy("factor_id", "year").agg(F.count("ic").alias("dates"), F.avg("ic").alias("ic_mean"))
    now, then = F.col("ic_mean"), F.col("base_ic")
    strong = F.abs(now) >= F.least(F.lit(least_ic), F.abs(then) / 2)
    status = F.when(F.col("dates") < least_dates, "short").when(then.isNull() | now.isNull() | (now * then <= 0), "retire").when(strong, "keep").otherwise("watch")
    return years.join(base, "factor_id", "left").withColumn("status", status)
