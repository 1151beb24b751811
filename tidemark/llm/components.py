"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import park, unpark


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours (large: the greater ones) on its least neighbour or itself."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        hung = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        hung = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b long): root is the least node that links reach.

    Each step is a few shuffles of the link table, whose size never grows; the steps number as the logarithm of the
    longest chain. Nulls, self links and repeated links count for nothing.
    """
    now = park(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        large = _star(now, large=True)
        small = park(_star(large, large=False), "links")
        seen = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unpark(now)
        now = small
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
