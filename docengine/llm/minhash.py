"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

Each distinct shingle is hashed once; the top bits of the hash choose its bin, and a bin keeps its least hash. An empty bin
copies the bin that a fixed pseudo-random sequence of its own reaches first among the filled ones. Bands of bins make bucket
keys. Documents with equal shingle sets collapse into one node before bucketing. Buckets propose
stars, and candidates are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import bounded_batches, frugal, left_join, materialize, may_match, shingle_hashes, split_words
from docengine.llm.stars import linked_classes, shared_buckets

BIN_BITS = 7
BANDS = 32
SHINGLE_WORDS = 5
PERCENT = 80
CHUNK = 128

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, set_hash binary, keys array<long>"


@lru_cache
def _detours(bin_bits: int) -> np.ndarray:
    """Row i: the bins that the empty bin i tries, in order."""
    return np.random.default_rng(20240131).integers(0, 1 << bin_bits, (1 << bin_bits, 1 << 13), dtype=np.int16)


def one_permutation(hashes: np.ndarray, bin_bits: int = BIN_BITS) -> np.ndarray:
    """Least hash of each bin of sorted distinct hashes (at least one), empty bins filled by optimal densification."""
    n = 1 << bin_bits
    at = np.searchsorted(hashes, np.arange(n, dtype=np.uint64) << np.uint64(64 - bin_bits))
    filled = np.diff(at, append=len(hashes)) > 0
    out = hashes[np.minimum(at, len(hashes) - 1)]
    empty, tries = np.flatnonzero(~filled), _detours(bin_bits)
    width = 32
    while len(empty) and width <= tries.shape[1]:
        hit = filled[tries[empty, :width]]
        found = hit.any(axis=1)
        out[empty[found]] = out[tries[empty[found], hit[found].argmax(axis=1)]]
        empty, width = empty[~found], width * 16
    out[empty] = out[np.flatnonzero(filled)[0]]  # after 8,192 misses: the first filled bin
    return out


def band_keys(bins: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of consecutive bins, distinct between bands."""
    rows = bins.reshape(bands, -1)
    odd = np.random.default_rng(7).integers(1, 1 << 62, rows.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = (rows * odd).sum(axis=1, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


@frugal
def _signatures(batches: Iterator[pa.RecordBatch], k: int, bin_bits: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, keys = [], [], []
        for text in batch.column(1):
            hashes = shingle_hashes(split_words((text.as_py() or b"").lower()), k)
            sizes.append(len(hashes))
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
            keys.append(band_keys(one_permutation(hashes, bin_bits), bands) if len(hashes) else np.empty(0, np.int64))
        offsets = np.cumsum([0, *map(len, keys)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))],
            names=["doc_id", "n_shingles", "set_hash", "keys"],
        )


@frugal
def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (centre, chunk, role, id, text) in this order, a group's centre first: the pairs that really link."""
    group, sets = None, []
    for batch in batches:
        centre_out, member_out = [], []
        columns = [batch.column(i).to_pylist() for i in range(4)]
        texts = batch.column(4)
        for i, (centre, chunk, role, name) in enumerate(zip(*columns, strict=True)):
            if group != (centre, chunk):
                group, sets = (centre, chunk), []
            own = shingle_hashes(split_words((texts[i].as_py() or b"").lower()), k)
            if role == 0:
                sets.append(own)
            else:
                for other in sets:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(other) - both):
                        centre_out.append(centre)
                        member_out.append(name)
                        break
        yield pa.RecordBatch.from_arrays([pa.array(centre_out, pa.int64()), pa.array(member_out, pa.int64())], names=["a", "b"])


def confirm_links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity. texts: doc_id, text as binary.

    A centre's members are dealt into chunks of about CHUNK, so that a centre with many members fills many groups.
    """
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = materialize(pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").alias("chunk")), "pairs")
    wanted = dealt.select("a", "chunk", F.lit(1).alias("role"), F.col("b").alias("doc_id")).unionByName(dealt.select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("doc_id")).distinct())
    rows = wanted.join(may_match(texts, "doc_id", wanted), "doc_id").select("a", "chunk", "role", "doc_id", "text")
    return rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role").mapInArrow(partial(_confirm, k=k, percent=percent), "a long, b long")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = times[column] > 1
    owner, column = owner[twice], column[twice]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [c, c + 4096])
        held = np.zeros((n, 4096), np.float32)
        held[owner[lo:hi], column[lo:hi] - c] = 1
        out += held @ held.T
    return out.astype(np.int64)


def _compare_block(rows: list[tuple[int, int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Edges that connect the linked nodes of rows (node, component, side, set); pairs within a side have their own block."""
    rows = [r for r in rows if len(r[3])]
    if len(rows) < 2:
        return []
    node, comp, side = (np.array([r[i] for r in rows]) for i in range(3))
    both, size = _shared([r[3] for r in rows]), np.array([len(r[3]) for r in rows])
    linked = (both > 0) & (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (comp[:, None] != comp[None, :])
    if (side != side[0]).any():
        linked &= side[:, None] != side[None, :]
    root, edges = dict(zip(node.tolist(), node.tolist(), strict=True)), []

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        a, b = find(int(node[i])), find(int(node[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            edges.append((int(node[i]), int(node[j])))
    return edges


@frugal
def _confirm_blocks(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, lo, hi, side, node, comp, text), a block's rows together."""
    block, rows = None, []
    for batch in batches:
        edges = []
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for i, (*name, side, node, comp) in enumerate(zip(*columns, strict=True)):
            if name != block:
                edges += _compare_block(rows, percent)
                block, rows = name, []
            rows.append((node, comp, side, shingle_hashes(split_words((batch.column(6)[i].as_py() or b"").lower()), k)))
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in range(2)], names=["a", "b"])
    edges = _compare_block(rows, percent)
    yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in range(2)], names=["a", "b"])


def confirm_in_blocks(blocks: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect what links within each block (cluster, lo, hi, side, node, comp)."""
    blocks = materialize(blocks.withColumnRenamed("node", "doc_id"), "blocks")
    rows = blocks.join(may_match(texts, "doc_id", blocks), "doc_id").withColumnRenamed("doc_id", "node").select("cluster", "lo", "hi", "side", "node", "comp", "text")
    key = ["cluster", "lo", "hi"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(partial(_confirm_blocks, k=k, percent=percent), "a long, b long")


def near_duplicates(documents: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, bin_bits: int = BIN_BITS, bands: int = BANDS) -> DataFrame:
    """One row for each row of documents (doc_id long, text string; other columns are ignored).

    doc_id, n_shingles long (size of the set of k-word shingles of the lower-cased text), component_id long (smallest doc_id
    reachable over links of at least percent per cent), kept boolean (doc_id = component_id).

    Null and blank texts have no shingles and link with nothing. Rows that share a doc_id are one node: links of any of
    their texts count for it. Rows without a doc_id link with nothing; their component_id is null and kept is true.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = materialize(texts.mapInArrow(partial(_signatures, k=k, bin_bits=bin_bits, bands=bands), SIGNATURE_SCHEMA), "signatures")
    sets = rows.where("set_hash is not null and doc_id is not null")
    nodes = materialize(sets.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n")), "nodes")
    buckets = shared_buckets(nodes.select("node", "keys", "n"))
    # rows that share an id, but not their texts, tie the classes of their sets together
    owned = sets.select("doc_id", "set_hash").join(nodes.select("set_hash", "node"), "set_hash")
    links = materialize(owned.where("doc_id <> node").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select(F.col("lo").alias("a"), F.col("hi").alias("b")), "links")
    components = linked_classes(buckets, partial(confirm_links, texts=texts, k=k, percent=percent), percent, links, partial(confirm_in_blocks, texts=texts, k=k, percent=percent))
    classes = nodes.select("set_hash", "node").join(components, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    joined = rows.select("doc_id", "n_shingles", "set_hash").join(classes, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    out = joined.select("doc_id", "n_shingles", component)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(documents: DataFrame, **options: int) -> DataFrame:
    """documents without the rows that near_duplicates() does not keep, columns unchanged."""
    gone = materialize(near_duplicates(documents, **options).where("not kept").select(F.col("doc_id").alias("__gone"), F.lit(True).alias("__drop")).distinct(), "gone")
    rows = left_join(documents.withColumn("__gone", F.col("doc_id").cast("long")), "__gone", gone)
    return rows.where("__drop is null").select(documents.columns)
