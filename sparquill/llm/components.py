"""Connected components of an edge table by alternating large and small stars.

Each round takes minima of neighbours with partial aggregation and joins them back, so that a node with very many edges is pre-aggregated and its
join can be split; nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: larger neighbours move to a node's least neighbour. Small star: the node and its smaller neighbours do."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    own = down if small else down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = own.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = own.join(least, "u")
    moved = moved.select("v", "m").union(least.select(F.col("u").alias("v"), "m")) if small else moved.where("v > u").select("v", "m")
    return moved.where("v <> m").distinct().select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v; longs) to (node, component): the least node reachable. Loops and nulls are ignored; nodes without edges don't appear."""
    edges = keep(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v"), "edges")
    before = None
    for _ in range(ROUNDS):
        edges = keep(_star(_star(edges, False), True), "stars")
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if seen == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        before = seen
    raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
