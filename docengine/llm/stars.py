"""Classes of linked nodes from buckets, by star-shaped candidates.

Every bucket proposes a star: its members against one pseudo-randomly chosen centre. Candidates are confirmed by the caller's
exact comparison, and buckets whose members already lie in one component need no more work. What stays open is compared
across components: small buckets pair by pair, crowded ones in square blocks of bounded size. So no link that the buckets can
see is lost, no cap is needed, and a large group is not written out as pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import materialize, may_match, salted, with_salt
from docengine.llm.components import connected_components, joined_components

STAR_ROUNDS = 2
#: Open buckets of more members are compared in blocks where the caller can, smaller ones pair by pair.
CROWD = 32
BLOCK = 256


def shared_buckets(nodes: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(key, salt, salts, node, n) of nodes (node, n, keys): members of buckets with two nodes or more, crowded ones in parts.

    more: further members (key, node, n). Where nodes have comp, a component known before, buckets have two components or more.
    """
    rows = nodes.select(F.explode("keys").alias("key"), "node", "n", *[c for c in nodes.columns if c == "comp"])
    rows = rows if more is None else rows.unionByName(more)
    by = "comp" if "comp" in rows.columns else "node"
    shared = materialize(rows.groupBy("key").agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m"), "shared")
    dealt = with_salt(may_match(rows, "key", shared), "key", shared, "node")
    keys = with_salt(shared, "key", shared, "m").select("key", "salts")
    return materialize(dealt.join(salted(keys), ["key", "salt"]).select("key", "salt", "salts", "node", "n"), "buckets")


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _with(rows: DataFrame, *values: Column, only: str = "true") -> DataFrame:
    """rows with aggregates of their key, of those keys alone that meet the condition only."""
    each = salted(rows.groupBy("key").agg(F.first("salts").alias("salts"), *values).where(only))
    return rows.join(each, ["key", "salt"])


def _open_rows(buckets: DataFrame, components: DataFrame | None) -> DataFrame:
    """(key, salt, salts, node, n, comp, crowd) of buckets whose members lie in several components; crowd is their number."""
    if components is None:
        rows = buckets.withColumn("comp", F.col("node"))
    else:
        rows = buckets.join(components, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    return materialize(_with(rows, F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("crowd"), only="lo <> hi").drop("lo", "hi"), "open")


def _star(rows: DataFrame, used: DataFrame | None, percent: int, sole: bool = False) -> DataFrame:
    """Pairs of each bucket's centre with its members in other components.

    The centre is the member that meets the most others over all its buckets, as the original of many near copies does; one
    that was a centre before only comes after the others. sole: a node meets but the first of its buckets' centres.
    """
    met = rows.groupBy("node").agg(F.sum("crowd").alias("met"))
    met = met.withColumn("fresh", F.lit(1)) if used is None else met.join(used.withColumn("old", F.lit(0)), "node", "left").select("node", "met", F.coalesce("old", F.lit(1)).alias("fresh"))
    rows = rows.join(met, "node")
    order = F.struct("fresh", "met", F.xxhash64("node").alias("h"), "node", F.col("n").alias("m"), F.col("comp").alias("c"))
    both = _with(rows, F.max(order).alias("z"))
    met = both.where((F.col("comp") != F.col("z.c")) & _alike(F.col("n"), F.col("z.m"), percent))
    if sole:
        return met.groupBy("node").agg(F.max("z").alias("z")).select(F.col("z.node").alias("a"), F.col("node").alias("b"))
    return met.select(F.col("z.node").alias("a"), F.col("node").alias("b")).distinct()


def _across(rows: DataFrame, percent: int) -> DataFrame:
    other = rows.select("key", F.col("node").alias("o"), F.col("n").alias("m"), F.col("comp").alias("c"))
    return rows.join(other, "key").where((F.col("node") < F.col("o")) & (F.col("comp") != F.col("c")) & _alike(F.col("n"), F.col("m"), percent)).select(F.col("node").alias("a"), F.col("o").alias("b")).distinct()


def _n_across(rows: DataFrame) -> int:
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    whole = parts.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
    return int(whole.agg(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2)).first()[0] or 0)


def _blocks(rows: DataFrame) -> DataFrame:
    """(cluster, lo, hi, side, node, comp): blocks of nodes that crowded buckets connect; each pair across components has one.

    A cluster's largest component is dealt into chunks, and so are all its other nodes. The others' chunks meet each other and
    those of the largest component, whose nodes do not meet among themselves: a few strangers beside a class of many near
    copies cost as many rows as the class has, not their square. Chunks of the largest component have negative numbers.
    """
    lead = _with(rows, F.min("node").alias("lead"))
    clusters = connected_components(lead.select("node", "lead").distinct(), "node", "lead").withColumnRenamed("component", "cluster")
    nodes = materialize(rows.select("node", "comp").distinct().join(clusters, "node", "left").select("node", "comp", F.coalesce("cluster", "node").alias("cluster")), "clusters")
    sizes = nodes.groupBy("cluster", "comp").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"))
    known = sizes.select("cluster", "m", F.col("top.comp").alias("largest"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("chunks"), F.ceil((F.col("m") - F.col("top.c")) / BLOCK).cast("int").alias("others"))
    counts = materialize(known, "sizes")
    salts = salted(with_salt(counts, "cluster", counts, "m").select("cluster", "largest", "chunks", "others", "salts"))
    sized = with_salt(nodes, "cluster", counts, "node").join(salts, ["cluster", "salt"])
    top = F.col("comp") == F.col("largest")
    h = F.xxhash64("node")
    side = F.when(top, -1 - F.pmod(h, "chunks")).otherwise(F.pmod(h, "others")).cast("int")
    among = F.sequence(F.lit(0), F.col("others") - 1)
    partners = F.when(top, among).otherwise(F.concat(among, F.sequence(-F.col("chunks"), F.lit(-1))))
    dealt = sized.withColumn("side", side).withColumn("other", F.explode(partners))
    return dealt.select("cluster", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "comp")


def first_classes(buckets: DataFrame, confirm: Callable[[DataFrame], DataFrame], percent: int = 0) -> DataFrame:
    """(node, component) after one star in which each node meets one centre at most; for linked_classes() to go on from.

    So a large group of near copies is one class before its buckets propose all their stars.
    """
    pairs = materialize(_star(_open_rows(buckets, None), None, percent, True), "candidates")
    return connected_components(materialize(confirm(pairs), "links"), "a", "b")


def linked_classes(
    buckets: DataFrame, confirm: Callable[[DataFrame], DataFrame], percent: int = 0, links: DataFrame | None = None, confirm_blocks: Callable[[DataFrame], DataFrame] | None = None, components: DataFrame | None = None
) -> DataFrame:
    """(node, component) as of connected_components(). buckets as of shared_buckets(), n a size; links: edges (a, b) known before.

    confirm takes candidate pairs (a, b), distinct in either order, and returns those that link. Pairs are proposed only if
    the smaller n is at least percent per cent of the larger. confirm_blocks takes blocks as of _blocks() and returns edges
    (a, b) that connect what links there, without writing out pairs. components: as of first_classes(), written tables.
    """
    if links is None:
        links = buckets.sparkSession.createDataFrame([], "a long, b long")
    elif components is not None:
        components = joined_components(components, links)
    tested, used, known = None, None, components is not None
    for turn in range(STAR_ROUNDS + 1):
        still = _open_rows(buckets, components)
        n = still.count()
        if not n:
            break
        last = turn == STAR_ROUNDS or (known or turn > 0) and (confirm_blocks is not None or _n_across(still) <= 2 * n)
        if last and confirm_blocks is not None:
            links = links.unionByName(materialize(confirm_blocks(_blocks(still.where(F.col("crowd") > CROWD))), "links"))
            still = still.where(F.col("crowd") <= CROWD)
        pairs = _across(still, percent) if last else _star(still, used, percent)
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "candidates")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tested = both if tested is None else tested.unionByName(both)
        centres = pairs.select(F.col("a").alias("node"))
        used = (centres if used is None else used.unionByName(centres)).distinct()
        links = links.unionByName(materialize(confirm(pairs), "links"))
        components = connected_components(links, "a", "b") if components is None else joined_components(components, links)
        links = links.where("false")
        if last:
            break
    return connected_components(links, "a", "b") if components is None else components
