"""Chunks of ranged transfers, out of order and repeated, put together as a stream; and an append-only operation log."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "transfer long, received long, next_start long, complete boolean, rejected long"
STATE = "starts array<long>, ends array<long>, size long, rejected long"


def insert(ranges: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Sorted disjoint ranges with one more; touching ranges join."""
    out = []
    for a, b in ranges:
        if b < start or a > end:
            out.append((a, b))
        else:
            start, end = min(a, start), max(b, end)
    return sorted([*out, (start, end)])


def _step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    starts, ends, size, rejected = state.get if state.exists else ([], [], -1, 0)
    ranges = list(zip(starts, ends, strict=True))
    for frame in frames:
        for row in frame.sort_values("start").itertuples():
            good = row.status in (200, 206) and row.start >= 0 and row.length > 0 and (size in (-1, row.size)) and row.start + row.length <= row.size
            if good:
                size, ranges = row.size, insert(ranges, row.start, row.start + row.length)
            else:
                rejected += 1
    state.update(([a for a, _ in ranges], [b for _, b in ranges], size, rejected))
    front = ranges[0][1] if ranges and ranges[0][0] == 0 else 0
    yield pd.DataFrame([(key[0], sum(b - a for a, b in ranges), front, size >= 0 and ranges == [(0, size)], rejected)], columns=[x.split()[0] for x in OUT.split(", ")])


def reassemble(chunks: DataFrame) -> DataFrame:
    """Progress of each transfer whenever it gets chunks (transfer, start, length, size, status): bytes received, where the
    first gap begins, whether it is complete, and how many chunks were refused (bad status, range or size)."""
    return chunks.groupBy("transfer").applyInPandasWithState(_step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def log_lines(events: DataFrame, seq_by: list[str], at: str) -> DataFrame:
    """events with seq (from 1, by time) and line, within each seq_by."""
    seq = F.row_number().over(Window.partitionBy(*seq_by).orderBy(at, "event_id")).cast("long")
    return events.withColumn("seq", seq).withColumn("line", F.concat_ws(" ", F.col("seq").cast("string"), "event_type", F.col("event_id").cast("string")))


def corrected(log: DataFrame, corrections: DataFrame) -> DataFrame:
    """log (seq, outcome) with later corrections (seq, outcome, version) applied, the last version winning."""
    last = corrections.groupBy("seq").agg(F.max_by("outcome", "version").alias("__new"))
    return log.join(last, "seq", "left").withColumn("outcome", F.coalesce("__new", "outcome")).drop("__new")


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events of each type and tumbling window; works on a stream (rows later than delay are dropped there) and on a table."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
