"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

Normalised vectors are projected on Gaussian directions; floor((a.v + b) / width) of several directions make one bucket key
for each of many tables. Cosine 0.9 is distance 0.447 between unit vectors. With 16 directions of width 2 a table joins a
pair at cosine 0.98 with probability 0.26 and one at 0.9 with 0.042, so 80 tables miss the first with 3e-11 and the second
with 0.03; unrelated pairs share a table's bucket with 1e-5. Equal vectors collapse first. Buckets are compared in square
blocks of bounded size, and a linked pair counts only in the first table that joins it, so no pair is written out: a block
gives each vector's number of links and a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import bounded_batches, frugal, materialize
from docengine.llm.components import connected_components

COSINE = 0.9
TABLES = 80
DIRECTIONS = 16
WIDTH = 2.0
BLOCK = 512
#: Rows of a block compared at a time.
STRIP = 128
SEED = 11


@lru_cache(4)
def _projections(dim: int, tables: int, directions: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, tables * directions)), rng.uniform(0, width, tables * directions), rng.integers(1, 1 << 62, directions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table_keys(units: np.ndarray, tables: int = TABLES, directions: int = DIRECTIONS, width: float = WIDTH) -> np.ndarray:
    """32-bit bucket key of each unit vector (a row) in each table."""
    a, b, odd = _projections(units.shape[1], tables, directions, width)
    cells = np.floor((units @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(units), tables, directions)
    key = (cells * odd).sum(axis=2, dtype=np.uint64)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


@frugal
def _sign(batches: Iterator[pa.RecordBatch], tables: int, directions: int, width: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.asarray(x, np.float64) for x in batch.column(1).to_pylist()]
        keys: list[np.ndarray] = [np.empty(0, np.int32)] * len(vectors)
        for dim in {len(v) for v in vectors}:
            at = [i for i, v in enumerate(vectors) if len(v) == dim]
            units = np.stack([vectors[i] for i in at])
            units = units / np.abs(units).max(axis=1, keepdims=True)
            units /= np.linalg.norm(units, axis=1, keepdims=True)
            for i, row in zip(at, table_keys(units, tables, directions, width), strict=True):
                keys[i] = row
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int32()))], names=[*batch.schema.names, "keys"])


def _strips(n: int) -> Iterator[slice]:
    return (slice(s, s + STRIP) for s in range(0, n, STRIP))


def _forest(links: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the smallest index of each row's component."""
    n = len(links)
    label = np.arange(n, dtype=np.int32)
    while True:
        new = label.copy()
        for s in _strips(n):
            new[s] = np.minimum(new[s], np.where(links[s], label[None, :], np.int32(n)).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block(t: int, rows: dict[str, np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, its number of links counted here, and a smaller node of its component here or itself. Works in strips of rows."""
    node, side, unit, keys, copies = (rows[k] for k in ("node", "side", "unit", "keys", "copies"))
    n = len(node)
    own = np.empty((n, n), bool)
    counts = np.zeros(n, np.int64)
    two = (side != side[0]).any()  # two chunks of one bucket: each has its own block for its inner pairs
    for s in _strips(n):
        own[s] = unit[s] @ unit.T >= cosine
        if two:
            own[s] &= side[s, None] != side[None, :]
        own[np.arange(n)[s], np.arange(n)[s]] = False
        first = own[s].copy()
        for earlier in range(t):
            if not first.any():
                break
            first &= keys[s, earlier, None] != keys[None, :, earlier]
        counts[s] = first @ copies
    return node, counts, node[_forest(own)]


@frugal
def _compare(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (t, key, dim, lo, hi): blocks follow one another and may cross batches."""
    parts: list[dict[str, np.ndarray]] = []
    block = None

    def done() -> Iterator[pa.RecordBatch]:
        if parts and sum(len(p["node"]) for p in parts) > 1:
            rows = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            order = np.argsort(rows["node"], kind="stable")
            node, counts, low = _block(block[0], {k: v[order] for k, v in rows.items()}, cosine)
            keep = (counts > 0) | (low != node)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(counts[keep]), pa.array(low[keep])], names=["node", "n", "low"])

    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in names], axis=0)) + 1
        get = {k: batch.column(batch.schema.get_field_index(k)) for k in ("node", "side", "copies", "embedding", "keys")}
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tuple(x[a] for x in names)
            if now != block:
                yield from done()
                parts, block = [], now
            unit = get["embedding"].slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)
            unit = unit / np.abs(unit).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            keys = get["keys"].slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
            parts.append({"unit": unit, "keys": keys} | {k: get[k].slice(a, b - a).to_numpy(zero_copy_only=False) for k in ("node", "side", "copies")})
    yield from done()


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, directions: int = DIRECTIONS, width: float = WIDTH) -> DataFrame:
    """One row for each row of vectors (vec_id long, embedding array of float or double; other columns are ignored).

    vec_id, n_links long (other rows at this cosine or more, as found), component_id long (smallest vec_id reachable over
    links), kept boolean (vec_id = component_id).

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, as do rows without a vec_id
    (component_id null, kept true) and vectors of different lengths. Rows that share a vec_id are one node of the links; each
    still counts for its partners.
    """
    bounded_batches(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0) & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    # adding 0 turns -0 into 0
    usable_rows = rows.where(usable).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast(kind)))
    distinct = usable_rows.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = materialize(
        distinct.select("node", "embedding", "copies").mapInArrow(partial(_sign, tables=tables, directions=directions, width=width), f"node long, embedding array<{kind}>, copies long, keys array<int>"), "vectors"
    )
    members = nodes.select("node", "embedding", F.size("embedding").alias("dim"), F.posexplode("keys").alias("t", "key")).select("t", "key", "dim", "node", F.xxhash64("embedding").alias("tag"))
    crowded = members.groupBy("t", "key", "dim").agg(F.count("*").alias("m")).where("m > 1")
    dealt = members.join(crowded, ["t", "key", "dim"]).select("t", "key", "dim", "node", "tag", F.ceil(F.col("m") / BLOCK).cast("int").alias("chunks"))
    dealt = dealt.withColumn("side", F.pmod("tag", "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = materialize(dealt.select("t", "key", "dim", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "node", "tag", "side"), "blocks")
    full = blocks.join(nodes.withColumn("tag", F.xxhash64("embedding")), ["node", "tag"]).select("t", "key", "dim", "lo", "hi", "node", "side", "copies", "embedding", "keys")
    order = ["t", "key", "dim", "lo", "hi"]
    found = materialize(full.repartition(*order).sortWithinPartitions(*order).mapInArrow(partial(_compare, cosine=cosine), "node long, n long, low long"), "links")
    components = connected_components(found.where("low <> node"), "node", "low")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    classes = nodes.select("node", "embedding", "copies").join(counts, "node", "left").join(components, "node", "left")
    classes = classes.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    linked = usable_rows.join(classes, "embedding").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(F.coalesce(~usable, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
