"""Connected components of an edge list, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formicary.llm.shared import discard, materialize


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node of distinct (u, v), u > v, has either one link to a smaller node or links to larger ones only."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the long pairs (u, v); the component is its smallest node.

    Alternates large-star and small-star steps: each replaces a node's links to its neighbours by links
    to the least of them, until only stars are left. Every step aggregates by node before it joins, no
    step makes more than two rows of an edge, and each round is written out, so neither lineage nor
    memory grows with the rounds. Self-links and repeated links do no harm; without edges: no rows.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = materialize(now, "edges")
    for _ in range(max_rounds):
        if _only_stars(now):
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(now.join(least, "u").select("u", F.col("m").alias("v")))
        large = large.filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, now = now, materialize(small.distinct(), "edges")
        discard(before)
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
