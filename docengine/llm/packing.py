"""Hierarchical multi-length packing of tokenised documents.

A document's full windows become sequences of their own. Its remainder is routed to the smallest tier (a power of two up to
the window) that holds it, and each tier is packed into sequences of its own length: its longest piece first, the gap filled
with the best-fitting pieces of this and shorter tiers, and what no piece fits by cutting one. The tier with most tokens
waiting packs next, so tiers alternate. Each task packs the rows of its own input split, with a bounded pool, so nothing is
shuffled. The few tokens left at a split's end become sequences whose lengths are powers of two. No sequence has padding.
Step groups cut the stream of all sequences into equal numbers of tokens, over the bounds of splits.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import bounded_batches, frugal, materialize
from docengine.llm.tokens import encoder, list_array, slices

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 8 * WINDOW
POOL_WINDOWS = 128
#: Splits' offsets up to so many are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SPLITS = 500_000

SCHEMA = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long, sequence_length long, tier long, split int, before long"


class Packer:
    """Packs pieces (length, key, doc_id, ids, start, doc_tokens) of one split; rows() takes what is finished."""

    def __init__(self, split: int, window: int, tiers: tuple[int, ...]):
        self.window, self.tiers, self.split = window, tiers, split
        self.pools: list[list[tuple]] = [[] for _ in tiers]  # each sorted by length
        self.waiting = [0] * len(tiers)  # tokens of each pool
        self.tokens = self.sequences = self.packed = self.added = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        length = sum(p[0] for p in pieces)
        tier = next(t for t in self.tiers if t >= length)
        offset = 0
        for n, _, doc, ids, start, total in pieces:
            self.out.append((doc, start, n, ids, total, (self.split << 36) + self.sequences, offset, length, tier, self.split, self.packed))
            offset += n
        self.sequences += 1
        self.packed += length

    def _route(self, piece: tuple) -> None:
        at = next(i for i, t in enumerate(self.tiers) if t >= piece[0])
        insort(self.pools[at], piece, key=lambda p: p[:2])
        self.waiting[at] += piece[0]
        self.tokens += piece[0]

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.window):
            self.added += 1
            piece = (min(self.window, len(ids) - start), self.added, doc, ids[start : start + self.window].copy(), start, len(ids))
            if piece[0] == self.window:
                self._close([piece])
            else:
                self._route(piece)
        if self.tokens > POOL_WINDOWS * self.window:
            self.pack(POOL_WINDOWS // 2 * self.window)

    def _take(self, at: int, i: int) -> tuple:
        piece = self.pools[at].pop(i)
        self.waiting[at] -= piece[0]
        self.tokens -= piece[0]
        return piece

    def _fill(self, size: int) -> None:
        """One sequence of exactly size tokens; the pools hold as many at least."""
        gap, pieces = size, []
        while gap:
            for at in reversed(range(len(self.pools))):  # longest tier first, its longest piece that fits
                if i := bisect_right(self.pools[at], (gap, self.added + 1), key=lambda p: p[:2]):
                    pieces.append(self._take(at, i - 1))
                    break
            else:  # none fits: cut the shortest
                at = next(i for i, pool in enumerate(self.pools) if pool)
                n, key, doc, ids, start, total = self._take(at, 0)
                pieces.append((gap, key, doc, ids[:gap], start, total))
                self._route((n - gap, key, doc, ids[gap:], start + gap, total))
            gap -= pieces[-1][0]
        self._close(pieces)

    def pack(self, least: int) -> None:
        """Sequences of the tiers until at most least tokens stay pooled, or no tier can be filled from itself and shorter ones."""
        while self.tokens > least:
            ready = [i for i, t in enumerate(self.tiers) if self.pools[i] and sum(self.waiting[: i + 1]) >= t]
            if not ready:
                break
            self._fill(self.tiers[max(ready, key=self.waiting.__getitem__)])

    def finish(self) -> None:
        self.pack(0)
        while self.tokens:
            self._fill(min(self.window, 1 << (self.tokens.bit_length() - 1)))

    def rows(self) -> pa.RecordBatch:
        names, kinds = zip(*(f.split() for f in SCHEMA.split(", ")), strict=True)
        columns = list(zip(*self.out, strict=True)) or [()] * len(names)
        self.out = []
        ids = list_array(np.concatenate([*columns[3], np.empty(0, np.uint32)]).astype(np.uint32), np.cumsum([0, *columns[2]]))
        return pa.RecordBatch.from_arrays([ids if i == 3 else pa.array(c, pa.int32() if kinds[i] == "int" else pa.int64()) for i, c in enumerate(columns)], names=list(names))


@frugal
def _pack(batches: Iterator[pa.RecordBatch], path: str, byte_level: bool, end: int, window: int, tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    packer = Packer(TaskContext.get().partitionId(), window, tiers)
    for part in slices(batches, 1):
        flat, at = encoder(path, byte_level, end).encode(part.column(1))
        for doc, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            packer.add(doc, flat[a:b])
        yield packer.rows()
    encoder(path, byte_level, end).forget()
    packer.finish()
    yield packer.rows()


def pack_documents(documents: DataFrame, tokenizer: str, end: int, byte_level: bool = False, window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row for each piece of documents (doc_id long, text string; other columns are ignored), with its ids.

    tokenizer: the path of a tokenizers file; end: the id after each document; the last tier is the window. Null and empty
    texts give the end id alone; repeated rows and rows without doc_id are packed like others. sequence_id is unique over the
    table and depends on how the input is split; before counts the tokens of the split's earlier sequences.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_pack, path=tokenizer, byte_level=byte_level, end=end, window=window, tiers=tiers), SCHEMA)


def with_step_groups(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """pieces as of pack_documents(), written and reread, with step_group long: sequences in order of split and place.

    Every group begins within its step_tokens of the whole table's stream of tokens, so groups differ by one sequence at most;
    only the table's last group may hold less.
    """
    held = materialize(pieces, "packed")
    ends = materialize(held.groupBy("split").agg(F.sum("length").alias("n")), "splits")  # one row for each split
    base = ends.select("split", (F.sum("n").over(Window.orderBy("split")) - F.col("n")).alias("base"))
    if ends.count() <= BROADCAST_SPLITS:
        base = F.broadcast(base)
    group = F.floor((F.col("base") + F.col("before")) / step_tokens).cast("long").alias("step_group")
    return held.join(base, "split").select(*pieces.columns, group)
