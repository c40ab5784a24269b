"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

A row's key is -ln(u) / w: u is uniform and comes from the md5 of the id, w is the row's quality
weight, so a smaller key comes first and a rerun gives the same mix. Within a source, rows in key order
are summed up to the source's token budget. Whole epochs over the source come before that.

Defined results: sources are ordered by code point with null last and weigh 3, 1, 2, repeating; a null
or empty text has size 0 and takes nothing; if all sizes are 0, all targets are 0; rows with the same id
have the same key and follow in order of size; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alidade.llm.common import saved

#: White space between words: space and the code points 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
#: Characters that mark junk; their share lowers a row's quality weight.
SYMBOLS = "#*$%&|<>"
#: A row's weight is never below this, so that every row can be drawn.
LEAST_WEIGHT = 0.05


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than SPACES; null counts as empty."""
    # One kind of white space, then one space between words: the count is one more than the spaces that are left.
    bare = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1)))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, " +"))).cast("long")


def quality_weight(text: Column) -> Column:
    """Between LEAST_WEIGHT and 1: falls by ten times the share of SYMBOLS among the characters."""
    text = F.coalesce(text, F.lit(""))
    marks = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) - F.lit(10.0) * marks / F.greatest(F.length(text), F.lit(1)))


def uniform(key: Column, seed: str) -> Column:
    """In (0, 1), from 48 bits of an md5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """One row a source: source, source_size, target. sizes: source, source_size.

    Each source gets min(most * its size, level * its weight). In order of the level at which a source
    is full, the level is the budget that full sources leave, over the weight of the others. This is
    where resharing the excess ends. There is one row a source here, whatever the number of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.lit(most) * F.col("source_size")
    ranked = sizes.withColumn("rank", F.row_number().over(order)).select(
        "source", "source_size", F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), ((F.col("rank") - 1) % 3 + 1).cast("int")).alias("weight"), "rank", cap.alias("cap")
    )
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("weight"))
    filled = Window.orderBy("full_at", "rank")
    everything = Window.partitionBy()
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "*",
        F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("rest"),
    ).toDF(*ranked.columns, "left", "rest")
    level = F.min(F.when(F.col("left") <= F.col("full_at") * F.col("rest"), F.struct("full_at", "rank", (F.col("left") / F.col("rest")).alias("level")))).over(everything)["level"]
    return levels.withColumn("level", level).select(
        "source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target")
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, share: float = 1.5, most: float = 2.0, seed: str = "mix-"
) -> DataFrame:
    """Return id_col, source, size, source_size, target and taken for every row.

    taken is size for each whole epoch that the target holds, plus size once more for rows that the
    rest of the target reaches in key order: the row at the limit is in if more than half of it fits.

    No source is sorted in one task. Rows are sorted within (source, bucket), where a bucket is a
    range of the key's logarithm, of which no more than a few thousandths of any source share one;
    the sums of the buckets are prefix-summed by source. The number of buckets grows as the square
    root of the rows.
    """
    text = F.col(text_col)
    key = -F.ln(uniform(F.col(id_col), seed)) / (quality_weight(text) if weight is None else weight)
    sized = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), key.alias("key")), "mix-sizes")
    steps = max(1, round(math.sqrt(sized.count()) / 16))
    bucketed = sized.withColumn("bucket", F.floor(F.log2("key") * F.lit(float(steps))))
    parts = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, most)
    by_key = Window.partitionBy("source").orderBy("bucket")
    parts = parts.withColumn("start", F.sum("bucket_size").over(by_key) - F.col("bucket_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    parts = parts.join(targets.withColumn("epochs", epochs), parts["source"].eqNullSafe(targets["source"])).select(
        parts["source"].alias("p_source"), F.col("bucket").alias("p_bucket"), "start", "source_size", "target", "epochs"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = bucketed.withColumn("run", F.sum("size").over(inside))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    middle = F.col("start") + F.col("run") - F.col("size") / 2.0
    extra = middle < F.col("target") - F.col("epochs") * F.col("source_size")
    return rows.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + extra.cast("int"))).cast("long").alias("taken")
    )
