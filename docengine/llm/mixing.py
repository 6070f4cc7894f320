"""Mixing sources to target weights by the cube method.

Targets share out a total by weight, none above its cap (the excess is reshared by weight). A document's expected copies are
its source's target over the source's size: the whole part is taken outright, the rest is an inclusion probability. The
flight phase moves the probabilities of three documents at a time along the null space of the balancing constraints (number
of documents, number of words), so that both totals stay exact, until one of them is 0 or 1. It runs in blocks of bounded
size; what each block leaves undecided (three rows at most) goes to the blocks of the next level, until a source has a single
block. There the smallest documents are kept for landing: they are rounded, largest first, towards the words still due.
take() makes its blocks of consecutive rows of an input split, so that only the few rows they leave undecided are shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import bounded_batches, frugal, materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BLOCK = 4096
LANDING = 64
SEED = 17
#: Targets of up to so many sources are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 200_000
#: Undecided rows, and their bytes, that a task of take() keeps; beyond, it leaves them undecided.
CARRY_ROWS, CARRY_BYTES = 4096, 32 << 20
#: Of each source a task of take() leaves so many of its smallest rows for landing.
RESERVE = 32
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, n, target) from units (source, size).

    Sources ordered by code point, null last, take the weights in turn. One row for each source; the windows run over these.
    """
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    ranked = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("most", F.col("source_size") * cap)
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    due = F.sum("source_size").over(whole) * share
    full = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (due - full) / left)
    first = F.min(F.when(F.col("most") / F.col("weight") > F.col("level"), F.struct((F.col("most") / F.col("weight")).alias("r"), "level"))).over(whole)["level"]
    return level.withColumn("first", first).select("source", "source_size", "n", F.least("most", F.coalesce(F.col("weight") * F.col("first"), "most")).alias("target"))


def flight(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator, stop: int = 0) -> np.ndarray:
    """Move pi (in place) until fewer than three rows, or stop of them, are strictly between 0 and 1; sums of pi and size * pi stay."""
    s, p, eps = size.tolist(), pi.tolist(), 1e-9
    draws = iter(rng.random(2 * len(s) + 8))
    active: list[int] = []
    following, left = 0, len(s)
    while left > stop:
        while len(active) < 3 and following < len(s):
            active.append(following)
            following += 1
        if len(active) == 3:
            a, b, c = active
            v = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
            if not any(v):
                v = (1.0, -1.0, 0.0)
            elif 0 in v:  # two equal sizes: exchange them
                v = tuple((1.0 if x > 0 else -1.0) if x else 0.0 for x in v)
        elif len(active) == 2 and s[active[0]] == s[active[1]]:
            v = (1.0, -1.0)
        else:
            break
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, v) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, v) if x)
        move = up if next(draws) * (up + down) < down else -down
        for i, x in zip(active, v):
            p[i] += move * x
            if p[i] < eps or p[i] > 1 - eps:
                p[i] = round(p[i])
                left -= 1
        active = [i for i in active if 0 < p[i] < 1]
    pi[:] = p
    return pi


def land(size: np.ndarray, pi: np.ndarray, due: float) -> np.ndarray:
    """Round the open rows, largest first, so that the words taken of them come near due."""
    out = pi.copy()
    todo = np.flatnonzero((pi > 0) & (pi < 1))
    todo = todo[np.argsort(-size[todo], kind="stable")]
    rest = due
    for n, i in enumerate(todo):
        later = float((size[todo[n + 1 :]] * pi[todo[n + 1 :]]).sum())
        # take it if the rest then stays nearer to what the later rows are expected to fill
        out[i] = float(abs(rest - size[i] - later) < abs(rest - later))
        rest -= size[i] * out[i]
    return out


def _cube(group: pd.DataFrame, level: int, seed: int) -> pd.DataFrame:
    group = group.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    size, pi = group["size"].to_numpy(np.float64), group["pi"].to_numpy(np.float64).copy()
    first = group.iloc[0]
    rng = np.random.default_rng([seed, level, int(first["block"]), int(first["source_hash"]) & (2**63 - 1)])
    last = first["blocks"] == 1
    due = float((size * pi).sum())
    flight(size, pi, rng, LANDING if last else 0)
    if last:
        pi = land(size, pi, due - float(size[pi == 1].sum()))
    group["pi"] = pi
    return group


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _rated(targets: DataFrame) -> DataFrame:
    """(s, source_size, n, target, whole int, pi): copies of each row of source s for sure, and the probability of one more."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-9)
    more = F.greatest(rate - whole, F.lit(0.0))
    out = targets.select(F.col("source").alias("s"), "source_size", "n", "target", whole.cast("int").alias("whole"), F.when(more < 1e-9, 0.0).otherwise(more).alias("pi"))
    return F.broadcast(out) if targets.count() <= BROADCAST_SOURCES else out


def _settle(todo: DataFrame, most: int, seed: int) -> DataFrame:
    """todo (doc_id, source, size, tie, pi and n, the rows of its source, at most most) with pi 0 or 1, without n."""
    columns = [c for c in todo.columns if c != "n"]
    done, level = None, 0
    todo = todo.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).drop("n")
    while True:
        todo = todo.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "doc_id", "tie"), "blocks")).withColumn("source_hash", F.xxhash64("source"))
        schema = ", ".join(f"{c} {t}" for c, t in todo.dtypes)
        moved = materialize(todo.groupBy("source", "block").applyInPandas(partial(_cube, level=level, seed=seed), schema), "cube")
        now = moved.where("pi in (0, 1)").select(columns)
        done = now if done is None else done.unionByName(now)
        blocks = math.ceil(most / BLOCK)
        if blocks <= 1:
            return done
        # each block leaves three rows at most
        todo = moved.where("pi not in (0, 1)").withColumn("blocks", F.ceil(F.col("blocks") * 3 / BLOCK)).drop("block", "source_hash")
        most, level = blocks * 3, level + 1


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row for each row of documents (doc_id long, text string, source string; other columns are ignored).

    doc_id, source, size long (words of the text; null: 0), source_size long, target double (its source's), copies int (times
    the mix takes it, at most the cap rounded up), taken long (copies * size), tie long (hash of the text).

    Results depend on the rows alone, so reruns agree; identical rows are exchangeable. Sources without words have target 0
    and no copies; null is a source like others.
    """
    units = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), F.xxhash64("text").alias("tie")), "units")
    targets = materialize(source_targets(units, weights, share, cap), "targets")
    rows = units.join(_rated(targets), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    base = ["doc_id", "source", "size", "tie", "source_size", "target", "whole", "pi"]
    settled = _settle(rows.where("pi > 0").select(*base, "n"), targets.agg(F.max("n")).first()[0] or 0, seed)
    done = rows.where("pi = 0").select(base).unionByName(settled.select(base))
    copies = (F.col("whole") + F.col("pi").cast("int")).alias("copies")
    return done.select("doc_id", "source", "size", "source_size", "target", copies, (F.col("size") * copies).cast("long").alias("taken"), "tie")


@frugal
def _flow(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Rows whose last columns are size, source, whole, pi: pi moves to 0 or 1, but for a few small rows; __row numbers the rows."""
    split = TaskContext.get().partitionId()
    carry: dict[str | None, pa.RecordBatch] = {}
    rngs: dict[str | None, np.random.Generator] = {}
    row = split << 34

    def out(part: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal row
        row += part.num_rows
        return part.append_column("__row", pa.array(np.arange(row - part.num_rows, row)))

    for batch in batches:
        batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)  # all fields may be null
        pi = batch.column("__pi").to_numpy()
        yield out(batch.filter(pa.array(pi == 0)))
        by_source: dict[str | None, list[int]] = {}
        for i, source in enumerate(batch.column("__source").to_pylist()):
            if pi[i] > 0:
                by_source.setdefault(source, []).append(i)
        for source, at in by_source.items():
            part = batch.take(pa.array(at))
            if source in carry:
                part = pa.concat_batches([carry.pop(source), part])
            if source not in rngs:
                rngs[source] = np.random.default_rng([seed, split, zlib.crc32(repr(source).encode())])
            part = part.take(pa.array(np.argsort(-part.column("__size").to_numpy(), kind="stable")))
            moved, fly = part.column("__pi").to_numpy().copy(), max(0, part.num_rows - RESERVE)
            flight(part.column("__size").to_numpy()[:fly].astype(np.float64), moved[:fly], rngs[source])
            part = part.set_column(part.schema.get_field_index("__pi"), "__pi", pa.array(moved))
            still = (moved > 0) & (moved < 1)
            yield out(part.filter(pa.array(~still)))
            if still.any():
                carry[source] = part.filter(pa.array(still))
        if sum(c.num_rows for c in carry.values()) > CARRY_ROWS or sum(c.nbytes for c in carry.values()) > CARRY_BYTES:
            yield from map(out, carry.values())
            carry.clear()
            rngs.clear()
    yield from map(out, carry.values())


def take(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """documents with each row repeated as often as the mix takes it, columns unchanged.

    Targets, rates and rounding are those of mix(); which rows are rounded up depends on the rows and on how the input is
    split, so reruns over the same files agree.
    """
    bounded_batches(documents.sparkSession)
    columns = documents.columns
    rows = documents.withColumns({"__size": _size(), "__source": F.col("source").cast("string")})
    targets = materialize(source_targets(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")), weights, share, cap), "targets")
    rates = _rated(targets).select("s", F.col("whole").alias("__whole"), F.col("pi").alias("__pi"))
    rated = rows.join(rates, F.col("__source").eqNullSafe(F.col("s"))).select(*columns, "__size", "__source", "__whole", "__pi")
    schema = ", ".join(f"`{c}` {t}" for c, t in rated.dtypes)
    held = materialize(rated.mapInArrow(partial(_flow, seed=seed), f"{schema}, __row long"), "flow")
    still = held.where("__pi > 0 and __pi < 1")
    units = still.select(F.col("__row").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__row").alias("tie"), F.col("__pi").alias("pi"))
    counts = materialize(units.groupBy("source").agg(F.count("*").alias("n")), "open")
    sized = units.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    settled = _settle(sized, counts.agg(F.max("n")).first()[0] or 0, seed).select(F.col("doc_id").alias("__row"), F.col("pi").alias("__settled"))
    both = held.where("__pi in (0, 1)").select(*columns, (F.col("__whole") + F.col("__pi")).alias("__copies"))
    both = both.unionByName(still.join(settled, "__row").select(*columns, (F.col("__whole") + F.col("__settled")).alias("__copies")))
    return both.where("__copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(columns)
