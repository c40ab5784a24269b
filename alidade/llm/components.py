"""Connected components by alternating large-star and small-star rounds, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alidade.llm.common import release, saved


def _least(edges: DataFrame) -> DataFrame:
    """For each node its smallest neighbour or itself."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Return node, root (the smallest node reachable) for all nodes of the undirected edges a, b.

    Loops, repeated edges and edges with a null end do no harm and name no node. Each round is written to the shared folder. A hub's edges are
    split by the join's skew handling, its minimum is aggregated before the shuffle. A component is
    done when it is a star around its smallest node; the rounds grow with the logarithm of its size.
    """
    first = now = saved(edges.select("a", "b").where("a <> b"), name)
    nodes = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
    while True:
        both = now.union(now.select("b", "a"))
        # Large star: larger neighbours move to the least neighbour.
        large = both.join(_least(both), F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: every edge points to the smaller node; each node and its smaller neighbours move to the least of these.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = _least(down)
        small = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a <> b").distinct()
        before, now = now, saved(small, name)
        if before is not first:
            release(before)
        # Not done while a node has two edges, or is the end of one and the beginning of another.
        sides = now.select(F.col("a").alias("node"), F.lit(1).alias("begins"), F.lit(0).alias("ends")).union(now.select("b", F.lit(0), F.lit(1)))
        if not sides.groupBy("node").agg(F.sum("begins").alias("begins"), F.max("ends").alias("ends")).where("begins + ends > 1 and begins > 0").limit(1).count():
            break
    out = saved(nodes.join(now, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root")), name)
    release(first, now)
    return out
