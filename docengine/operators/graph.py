"""Closures over edge tables: reachability, trees and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) reachable from roots (node) over edges (src, dst), roots included. Cycles end when a step finds nothing new.

    Edges are written once, by src; each step joins only the newest nodes. Lineage is cut by checkpoint() into
    spark.checkpoint.dir.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").repartition("src").checkpoint()
    seen = new = roots.select("node").distinct()
    depth = 0
    while True:
        new = edges.join(new, edges["src"] == new["node"], "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").checkpoint()
        if new.isEmpty():
            return seen
        seen, depth = seen.unionByName(new), depth + 1
        if depth % 4 == 0:
            seen = seen.checkpoint()


def tree(rows: DataFrame, max_depth: int | None = None) -> DataFrame:
    """rows (id, parent, ord, title) with depth and path (ords from the root, for depth-first order).

    Nodes below a cycle are never reached from a root and so are pruned. A tree deeper than max_depth, if given, is refused
    with ValueError; no node is dropped silently.
    """
    level = rows.where("parent is null").select("id", "parent", "ord", "title", F.lit(0).alias("depth"), F.array("ord").alias("path"))
    out, depth = level, 0
    while True:
        up = level.select(F.col("id").alias("parent"), F.col("depth").alias("d"), F.col("path").alias("p"))
        level = rows.join(up, "parent").select("id", "parent", "ord", "title", (F.col("d") + 1).alias("depth"), F.concat("p", F.array("ord")).alias("path")).checkpoint()
        if level.isEmpty():
            return out
        depth += 1
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"the tree is deeper than {max_depth}")
        out = out.unionByName(level)


def dangling(refs: DataFrame, objects: DataFrame, ref: str, key: str) -> DataFrame:
    """Rows of refs whose ref is no key of objects; null refs are none."""
    return refs.where(F.col(ref).isNotNull()).join(objects.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")
