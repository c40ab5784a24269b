"""Input tables and the panels built from them; files are read by Spark alone, with declared schemas where the format has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alidade.functions.safe import clean, exact_sum, ratio

#: The least that a price-like file must have.
PANEL = T.StructType([T.StructField("instrument", T.LongType()), T.StructField("dt", T.DateType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_panel(spark: SparkSession, path: str, fields: list[str], kind: str = "parquet") -> DataFrame:
    """Read instrument, dt and the double fields from parquet, orc, csv (with header) or json; NaN becomes null."""
    schema = T.StructType([*PANEL.fields, *(T.StructField(f, T.DoubleType()) for f in fields)])
    reader = spark.read.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    if kind not in ("parquet", "orc", "csv", "json"):
        raise ValueError(f"unknown format: {kind}")
    rows = reader.format(kind).load(path)
    return rows.select("instrument", "dt", *(clean(F.col(f)).alias(f) for f in fields))


def write_panel(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write by year, so that later reads of some years touch just their files; an existing result is never replaced."""
    rows = df.withColumn("year", F.year("dt")).repartition("year", "dt")
    rows.write.mode("errorifexists").partitionBy("year").format(kind).save(path)


def build_panel(rows: DataFrame, instrument: Column, dt: Column, value: Column) -> DataFrame:
    """One row for each instrument and date that has rows: total, n, mean, high, low of value.

    One aggregation, combined before its shuffle; the total does not depend on the order of rows.
    """
    source = rows.select(instrument.alias("instrument"), dt.cast("date").alias("dt"), clean(value).alias("v"))
    out = source.groupBy("instrument", "dt").agg(exact_sum(F.col("v")).alias("total"), F.count("v").alias("n"), F.max("v").alias("high"), F.min("v").alias("low"))
    return out.select("instrument", "dt", "total", "n", ratio(F.col("total"), F.col("n")).alias("mean"), "high", "low")


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event values by day."""
    return build_panel(table(spark, sf_dir, "events"), F.col("user_id"), F.to_date("ts"), F.col("value"))


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' quantities by month of shipping."""
    return build_panel(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.trunc("l_shipdate", "MM"), F.col("l_quantity"))
