"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import materialize

def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node that isn't the smallest of its component; component is that smallest node.

    Self-loops, nulls and repeated edges are ignored; an empty table gives an empty result. Every step is an aggregate
    with map-side combine and an equi-join whose larger side adaptive execution may split, so a hub spreads over tasks.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = materialize(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "edges")
    mark = _mark(now)
    before = None
    while mark[0] and mark != before:  # every step lowers some label until nothing changes
        now = materialize(_small_star(_large_star(now)), "edges")
        mark, before = _mark(now), mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def joined_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """components, as of connected_components(), after further links (a, b): only the links between components are stepped through."""
    of = lambda name: components.select(F.col("node").alias(name), F.col("component").alias(f"c{name}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = connected_components(between, "a", "b")
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    out = components.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialize(out.unionByName(moved), "components")
