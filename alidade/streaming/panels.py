"""A panel as a stream: daily aggregates that are given out once a watermark has passed their day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alidade.functions.safe import clean, exact_sum, ratio


def streaming_daily_panel(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The daily panel of a stream of ts, user_id, value; later rows than `lateness` are left out by the watermark.

    State is one row an instrument and open day.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", clean(F.col("value"))).withWatermark("ts", lateness)
    out = rows.groupBy(F.window("ts", "1 day"), F.col("user_id").alias("instrument")).agg(
        exact_sum(F.col("value")).alias("total"), F.count("value").alias("n"), F.max("value").alias("high"), F.min("value").alias("low")
    )
    return out.select("instrument", F.to_date("window.start").alias("dt"), "total", "n", ratio(F.col("total"), F.col("n")).alias("mean"), "high", "low")
