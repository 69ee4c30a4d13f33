"""Connected components by alternating large and small stars.

Both steps only send each node the least of its neighbours (an aggregate with
partial sums) and join it back to the edges, so no neighbourhood is ever held in
one place.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage


def _attach(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _edges(frame: DataFrame) -> DataFrame:
    return frame.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of longs -> (node, root): root is the least of the component."""
    edges = stage(_edges(edges), "links")
    state = _sum(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _edges(_attach(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        met = _attach(large)
        small = _edges(met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))))
        edges = stage(small, "links")
        state, before = _sum(edges), state
        if state == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
