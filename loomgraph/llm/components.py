"""Connected components of links, by alternating large and small stars, each written to the shared folder.

Large star: a node passes its smallest neighbour to its larger ones; small star: to its smaller ones and itself. Every node
ends up linked to the smallest of its component. A hub's links are aggregated before the shuffle and joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a < b, anew: from each node's neighbours to the smallest."""
    u, v = F.col("u"), F.col("v")
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = both.join(least, "u")
    moved = met.where(v > u) if large else met
    out = moved.select(F.col("m").alias("a"), v.alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("m").alias("a"), u.alias("b")))
    out = out.where("a < b")
    return out if large else out.distinct()  # what large stars repeat goes with the small stars' repeats


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every linked node; ``links`` has a and b, in any order."""
    now = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        now = written(_star(_star(now, True), False), "links")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
