"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import checkpoint, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges(a, b)` longs; component is the smallest node reachable.

    Each round joins every node to the smallest of its neighbours, first its larger neighbours, then its smaller ones, and
    stops when nothing changes; rounds grow with the logarithm of the nodes. Minima are taken by key before they are joined
    back, so a node with many edges is never gathered. Repeated edges and loops do no harm; a node with nothing but loops is left out.
    """
    at = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        both = at.filter("u <> v").unionByName(at.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large)
        release(least)
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        # An edge's larger end first; a node keeps its loop out.
        was, at = at, checkpoint(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        release(was, large, least)
    own = at.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return own.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
