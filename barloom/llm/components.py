"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v), each listed once.

    Large: every node sends its larger neighbours to its smallest neighbour or itself. Small: it sends its
    smaller neighbours and itself to the smallest. The minimum is a combined aggregate and its return a plain
    join, so a node with very many neighbours is split over tasks.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Rows (node, root) for every node of an edge (``u``, ``v`` long): root is the smallest node reachable.

    Ends when a double step leaves the edges as they are (count and order-free hash), with every edge then
    pointing at a root. Nulls must be removed before. An empty edge table gives an empty result.
    """
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, step, before = scratch.keep(now, f"{name}-0"), 0, None
    while True:
        n = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if n["n"] == 0 or before == (n["n"], n["h"]):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = (n["n"], n["h"])
        step += 1
        now = scratch.keep(_star(_star(now, True), False), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
