"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Edges stay a distributed table; a step is an aggregation and an equi-join, and the driver sees only
whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a long, b long) that have a link; root is the least node.

    Loops and repeated edges are allowed.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    old = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        if (mark["n"], mark["s"]) == old or mark["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        old = (mark["n"], mark["s"])
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.table(small, "edges")
        scratch.drop(now)
        now = new
