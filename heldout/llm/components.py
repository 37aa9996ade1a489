"""Connected components of an edge table by alternating stars."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import cut


def _least(directed: DataFrame) -> DataFrame:
    """(u, m): the least neighbour of u, or u itself; counted before the shuffle, so hubs cost one row per task."""
    return directed.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): each node of an edge with the smallest node reachable from it.

    Null ends and loops are ignored; repeated edges count once. No edges, no rows.
    Every round writes its edges to the shared folder; rounds grow with the logarithm
    of the longest path. Only counts come to the driver.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v))
    now = cut(now.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        large = both.join(_least(both), "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v)
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.join(_least(large), "u")
        small = low.select(F.explode(F.array(F.struct(v.alias("u"), F.col("m").alias("v")), F.struct(u.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.where(u != v).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    ends = now.select(u.alias("node"), v.alias("component"))
    return ends.unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
