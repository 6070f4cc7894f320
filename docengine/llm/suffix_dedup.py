"""Passages that repeat within or across documents, by a sparse suffix array.

A passage is a run of at least min_words words; every window of min_words words that occurs twice is repeated, and so is the
union of such windows. Of each window's suffixes only one is retained: that at its minimiser, the word position in its first
``reach`` positions whose k-word hash is least (leftmost if several). Equal windows choose equal positions, so their retained
suffixes share the next min_words - reach + 1 words at least. Retained suffixes are sorted by a fingerprint of these words,
then of the widest stretch that the position's windows span, and compared with their neighbours over range partitions, which
split large groups of equal suffixes. Neighbours with equal stretches match as a whole. Where only the first words agree, the
match ends inside the stretch: one suffix for each different stretch is extended left and right word by word, as its windows,
and these are matched. Two independent fingerprints of 64 bits decide every match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import bounded_batches, frugal, left_join, materialize, may_match, split_words

MIN_WORDS = 50
K = 5
REACH = 21

#: Bases of the two rolling fingerprints, odd.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Fingerprints of word ranges of one text, of either of two kinds."""

    def __init__(self, words: list[bytes]):
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.kinds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _sums(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        if kind not in self.kinds:
            n, base = len(self.hashes), _BASES[kind]
            hashes = _mix(self.hashes + np.uint64(base)) if kind else self.hashes
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(hashes * np.cumprod(np.full(n, base, np.uint64)), dtype=np.uint64, out=sums[1:])
            self.kinds[kind] = sums, np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
        return self.kinds[kind]

    def of(self, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
        sums, back = self._sums(kind)
        return _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def retained(words: list[bytes], min_words: int, k: int, reach: int) -> tuple[np.ndarray, ...]:
    """Position, first and last window start that choose it, fingerprint of its first words, fingerprint of its stretch."""
    n = len(words)
    if n < min_words:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    roll = Rolling(words)
    at = np.arange(n - min_words + reach)
    grams = roll.of(at, at + k)
    chosen = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1) + np.arange(n - min_words + 1)
    low = np.flatnonzero(np.diff(chosen, prepend=-1))
    high = np.append(low[1:], len(chosen)) - 1
    p = chosen[low]
    first = roll.of(p, p + (min_words - reach + 1))
    whole = _mix(roll.of(low, high + min_words, 1) + (p - low).astype(np.uint64))
    return p, low, high, first, whole


@frugal
def _retain(batches: Iterator[pa.RecordBatch], min_words: int, k: int, reach: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, cols = batch.column(0).to_numpy(zero_copy_only=False), []
        for key, text in zip(keys, batch.column(1), strict=True):
            p, low, high, first, whole = retained(split_words(text.as_py()), min_words, k, reach)
            if len(p):
                cols.append((first.view(np.int64), whole.view(np.int64), np.full(len(p), key, np.int64), p.astype(np.int32), (p - low).astype(np.int16), (high - low).astype(np.int16)))
        if cols:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], names=["first", "whole", "key", "p", "before", "after"])


ROLE_FULL, ROLE_EDGE, ROLE_EXTEND = 0, 1, 2
NEIGHBOUR_SCHEMA = "role byte, edge boolean, first long, whole long, key long, p int, before short, after short, first_key long, first_p int"


@frugal
def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (first, whole, key, p). A run is the rows of equal (first, whole); what lies over the partition's edge is unknown."""
    names = ["first", "whole", "key", "p", "before", "after"]
    held: dict[str, np.ndarray] | None = None  # the last row so far
    before: tuple[int, int] | None = None  # (first, whole) of the row before it
    lead = (0, 0)  # key and p of the current run's first row
    opening = True  # the current run began with the partition

    def judge(c: dict[str, np.ndarray], last: bool) -> pa.RecordBatch | None:
        nonlocal before, lead, opening
        n = len(c["key"]) - (not last)
        if n <= 0:
            return None
        f, w = c["first"], c["whole"]
        same_first = np.zeros(len(f) + 1, bool)
        same_run = np.zeros(len(f) + 1, bool)
        same_first[1:-1] = f[1:] == f[:-1]
        same_run[1:-1] = same_first[1:-1] & (w[1:] == w[:-1])
        if before is not None:
            same_first[0] = f[0] == before[0]
            same_run[0] = same_first[0] and w[0] == before[1]
        new = ~same_run[:n]
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        lead_key = np.where(at >= 0, c["key"][at], lead[0])
        lead_p = np.where(at >= 0, c["p"][at], lead[1])
        first_row = np.zeros(n, bool)
        first_row[0] = before is None
        last_row = np.zeros(n, bool)
        last_row[-1] = last
        starts = at < 0 if before is not None else at <= 0
        edge_run = starts & opening
        edge = edge_run | last_row
        full = ~edge & (same_run[:n] | same_run[1 : n + 1])
        extend = (same_first[:n] & ~same_run[:n]) | (same_first[1 : n + 1] & ~same_run[1 : n + 1]) | first_row | last_row
        opening = bool(edge_run[-1])
        before, lead = (int(f[n - 1]), int(w[n - 1])), (int(lead_key[-1]), int(lead_p[-1]))
        out = []
        for role, rows in ((ROLE_FULL, full), (ROLE_EDGE, edge), (ROLE_EXTEND, extend)):
            i = np.flatnonzero(rows)
            out.append((np.full(len(i), role, np.int8), edge[i], *(c[k][i] for k in names), lead_key[i], lead_p[i].astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=[x.split()[0] for x in NEIGHBOUR_SCHEMA.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = {k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names}
        if held is not None:
            now = {k: np.concatenate([held[k], now[k]]) for k in names}
        if (found := judge(now, False)) is not None:
            yield found
        held = {k: v[-1:] for k, v in now.items()}
    if held is not None:
        yield judge(held, True)


RESOLVED_SCHEMA = "extend boolean, key long, a int, b int, later boolean"


@frugal
def _resolve(batches: Iterator[pa.RecordBatch], edges: dict[tuple[int, int], tuple[int, int, int]], min_words: int) -> Iterator[pa.RecordBatch]:
    """Matched stretches (a, b, whether they occur earlier) and, as extend, first and last window start of those to extend.

    edges: rows at partition edges, first key and first position of each run over an edge.
    """
    for batch in batches:
        c = {k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("role", "edge", "first", "whole", "key", "p", "before", "after", "first_key", "first_p")}
        lead_key, lead_p, repeated = c["first_key"].copy(), c["first_p"].copy(), c["role"] == ROLE_FULL
        at = np.flatnonzero(c["edge"])
        if len(at):
            runs, which = np.unique(np.stack([c["first"][at], c["whole"][at]]), axis=1, return_inverse=True)
            known = np.array([edges[int(f), int(w)] for f, w in runs.T], np.int64)[which.ravel()]
            lead_key[at], lead_p[at] = known[:, 1], known[:, 2]
            # a partition's last row may follow rows of its run that are not at the edge
            follows = (c["key"][at] != known[:, 1]) | (c["p"][at] != known[:, 2])
            repeated[at] = (c["role"][at] == ROLE_EDGE) & ((known[:, 0] > 1) | follows)
        extend = c["role"] == ROLE_EXTEND
        low = np.where(extend, lead_p, c["p"]).astype(np.int32) - c["before"]
        keep = repeated | extend
        out = (extend, np.where(extend, lead_key, c["key"]), low, low + c["after"] + np.where(extend, 0, min_words).astype(np.int32), (c["key"] != lead_key) | (c["p"] != lead_p))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (out[0], out[1], out[2].astype(np.int32), out[3].astype(np.int32), out[4])], names=[x.split()[0] for x in RESOLVED_SCHEMA.split(", ")])


@frugal
def _windows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(key, text, stretches) to (both fingerprints, key, start) of each window of the stretches."""
    for batch in batches:
        out = []
        for key, text, stretches in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            start = np.unique(np.concatenate([np.arange(s["low"], s["high"] + 1) for s in stretches]))
            roll = Rolling(split_words(text.as_py()))
            out.append((*(roll.of(start, start + min_words, kind).view(np.int64) for kind in (0, 1)), np.full(len(start), key, np.int64), start.astype(np.int32)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["window", "check", "key", "low"])


def _unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@frugal
def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans, later = [], []
        for rows in batch.column(1).to_pylist():
            spans.append([{"start": a, "end": b} for a, b in _unite([(r["a"], r["b"]) for r in rows])])
            later.append([{"start": a, "end": b} for a, b in _unite([(r["a"], r["b"]) for r in rows if r["later"]])])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(later, kind)], names=["key", "spans", "later"])


def _keyed(documents: DataFrame) -> DataFrame:
    """documents with __key: doc_id where it names one row, else a negative hash of doc_id and text."""
    again = materialize(documents.groupBy(F.col("doc_id").cast("long").alias("__id")).count().where("count > 1 and __id is not null").select("__id", F.lit(True).alias("__again")), "again")
    own = F.lit(-1) - F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))
    rows = left_join(documents.withColumn("__id", F.col("doc_id").cast("long")), "__id", again)
    return rows.withColumn("__key", F.when(F.col("__again").isNull() & F.col("__id").isNotNull(), F.col("__id")).otherwise(own)).drop("__again", "__id")


def _find(keyed: DataFrame, min_words: int, k: int, reach: int) -> DataFrame:
    """(key, spans, later): united word ranges that repeat, and those of them that repeat an earlier place."""
    spark = keyed.sparkSession
    bounded_batches(spark)
    texts = keyed.select(F.col("__key").alias("key"), F.col("text").cast("binary").alias("text"))
    suffixes = materialize(texts.mapInArrow(partial(_retain, min_words=min_words, k=k, reach=reach), "first long, whole long, key long, p int, before short, after short"), "suffixes")
    order = ["first", "whole", "key", "p"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = materialize(suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, NEIGHBOUR_SCHEMA), "neighbours")
    # of runs over partition edges alone, two for each partition at most
    rows = seen.where(F.col("role") == ROLE_EDGE).groupBy("first", "whole").agg(F.count("*").alias("n"), F.min(F.struct("first_key", "first_p")).alias("lead")).collect()
    edges = {(r["first"], r["whole"]): (r["n"], r["lead"]["first_key"], r["lead"]["first_p"]) for r in rows}
    resolved = materialize(seen.mapInArrow(partial(_resolve, edges=edges, min_words=min_words), RESOLVED_SCHEMA), "resolved")
    whole = resolved.where("not extend").select("key", "a", "b", "later")
    extend = materialize(resolved.where("extend").select("key", "a", "b"), "extend")
    stretches = extend.groupBy("key").agg(F.collect_set(F.struct(F.col("a").alias("low"), F.col("b").alias("high"))).alias("stretches"))
    windows = materialize(may_match(texts, "key", extend).dropDuplicates(["key"]).join(stretches, "key").select("key", "text", "stretches").mapInArrow(partial(_windows, min_words=min_words), "window long, check long, key long, low int"), "windows")
    shared = windows.groupBy("window", "check").agg(F.count("*").alias("n"), F.min(F.struct("key", "low")).alias("lead")).where("n > 1")
    partly = windows.join(shared, ["window", "check"]).select("key", F.col("low").alias("a"), (F.col("low") + min_words).alias("b"), (F.struct("key", "low") != F.col("lead")).alias("later"))
    spans = whole.unionByName(partly).groupBy("key").agg(F.collect_set(F.struct("a", "b", "later")).alias("rows"))
    kind = "array<struct<start:int,end:int>>"
    return materialize(spans.mapInArrow(_spans, f"key long, spans {kind}, later {kind}"), "spans")


def _words(spans: str) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def repeated_passages(documents: DataFrame, min_words: int = MIN_WORDS, k: int = K, reach: int = REACH) -> DataFrame:
    """One row for each document (doc_id long, text string; other columns are ignored) that holds a repeated passage.

    doc_id, spans and later, arrays of word ranges (start, end): all repeated passages, and those that occur earlier (in a
    smaller doc_id, or before in the same document); repeated_words and later_words long, their lengths.

    Words are split at the blanks 0x20 and 0x09-0x0D and compared as they are. Null, empty and short texts hold none. Rows
    that share doc_id and text are one document; rows without doc_id come before others and are reported without one.
    """
    keyed = _keyed(documents.select("doc_id", "text"))
    found = _find(keyed, min_words, k, reach)
    ids = keyed.select(F.col("__key").alias("key"), F.col("doc_id").cast("long").alias("doc_id")).dropDuplicates(["key"])
    return found.join(ids, "key").select("doc_id", "spans", "later", _words("spans").alias("repeated_words"), _words("later").alias("later_words"))


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of these ranges and the white space after each range."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = starts[b]
    return b"".join([*out, text[at:]])


@frugal
def _cut(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The last column holds the ranges to cut from the text in column at."""
    for batch in batches:
        texts = [cut_words(t.encode(), [(s["start"], s["end"]) for s in spans]).decode() if spans else t for t, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1])


def drop_repeats(documents: DataFrame, min_words: int = MIN_WORDS, k: int = K, reach: int = REACH) -> DataFrame:
    """documents with repeated passages cut from all texts but the first that holds them; columns unchanged.

    Documents of which no word is left go; documents without repeats stay as they are. A column n_chars follows the text.
    """
    columns = documents.columns
    keyed = _keyed(documents)
    found = materialize(_find(keyed, min_words, k, reach).where(F.size("later") > 0).select(F.col("key").alias("__key"), F.col("later").alias("__later")), "later")
    joined = left_join(keyed, "__key", found)
    same = joined.where("__later is null").select(columns)
    schema = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes)
    cut = joined.where("__later is not null").select(*columns, "__later").mapInArrow(partial(_cut, at=columns.index("text")), schema).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(dict(documents.dtypes)["n_chars"]))
    return same.unionByName(cut)
