"""Connected components by alternating large-star and small-star steps (edges only, no adjacency lists).

Each step is a grouped minimum (partially aggregated, so a hub costs one row per task) and a key join that AQE may
split, so a component or hub with a third of all vertices stays spread. The number of rounds is logarithmic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(id, component)``: the smallest id reachable. Ids without edges are absent.
    Loops, repeated edges and both directions are allowed."""
    e = scratch.pin(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = large.join(low2, "u")
        nxt = nxt.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = scratch.pin(nxt)
        new = _state(nxt)
        scratch.drop(e)
        e = nxt
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
