"""Outlines: blocks with heading levels as a tree, its paths and subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stage

LEVELS = 6


def outline(blocks: DataFrame, doc: str, order: str, level: str) -> DataFrame:
    """Adds parent: the place of the last block before with a smaller heading level (text, level 0, hangs below every heading)."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col(level) == 0, LEVELS + 1).otherwise(F.col(level))
    marks = [F.max(F.when(F.col(level) == k, F.col(order))).over(w) for k in range(1, LEVELS + 1)]
    named = blocks.select("*", own.alias("_own"), *(m.alias(f"_at{k}") for k, m in enumerate(marks, 1)))
    parent = F.array_max(F.filter(F.array(*(F.when(F.col("_own") > k, F.col(f"_at{k}")) for k in range(1, LEVELS + 1))), lambda x: x.isNotNull()))
    return named.withColumn("parent", parent).drop("_own", *(f"_at{k}" for k in range(1, LEVELS + 1)))


def ancestors(tree: DataFrame, doc: str, order: str, depth: int = LEVELS + 1) -> DataFrame:
    """(doc, node, ancestor, steps): every block above each block. A tree of headings is at most `depth` deep, so the joins are few. Each step is written, so
    none is joined again for those after it and a task holds the rows of one join."""
    up = stage(tree.where("parent IS NOT NULL").select(F.col(doc).alias("doc"), F.col(order).alias("node"), "parent"))
    found = front = up.select("doc", "node", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    for _ in range(depth - 1):
        above = up.select("doc", F.col("node").alias("ancestor"), F.col("parent").alias("next"))
        front = stage(front.join(above, ["doc", "ancestor"]).select("doc", "node", F.col("next").alias("ancestor"), (F.col("steps") + 1).alias("steps")))
        found = found.union(front)
    return found


def heading_paths(tree: DataFrame, doc: str, order: str, title: str) -> DataFrame:
    """(doc, node, path): the titles above each block, from the top, joined by slashes."""
    above = ancestors(tree, doc, order).join(tree.select(F.col(doc).alias("doc"), F.col(order).alias("ancestor"), F.col(title).alias("title")), ["doc", "ancestor"])
    names = F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("k"), "title")))
    return above.groupBy("doc", "node").agg(F.array_join(F.transform(names, lambda x: x["title"]), " / ").alias("path"))


def subtree(tree: DataFrame, doc: str, order: str, roots: DataFrame) -> DataFrame:
    """(doc, root, node): everything below the roots (doc, root), which are included."""
    named = roots.select("doc", F.col("root").alias("ancestor"))
    below = ancestors(tree, doc, order).join(named, ["doc", "ancestor"]).select("doc", F.col("ancestor").alias("root"), "node")
    return below.union(roots.select("doc", "root", F.col("root").alias("node"))).distinct()
