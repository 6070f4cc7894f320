"""Chroma audio fingerprints of a media column, and the alignment of recordings.

Frames of the signal are folded into twelve pitch classes. An integral image over (frame, pitch class) gives the sums of
rectangles, from which sixteen filters compare two regions each; every response is quantised to two bits in Gray code and the
sixteen pairs are packed into one 32-bit integer for each frame. Two recordings align at the offset where the histogram of
offsets of equal integers peaks, and match if few bits differ over the aligned stretch. Candidates share two integers as they
are, or four in one of several subsets of their bits, so that copies with bit errors in nearly each integer are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import bounded_batches, materialize, may_match
from docengine.llm.stars import first_classes, linked_classes, shared_buckets

FRAME, HOP = 1024, 256
SPAN = 12
LOW_HZ, HIGH_HZ = 100.0, 1900.0
STEP = 0.12
MAX_BIT_ERROR = 0.2
#: A bucket key joins the integers of a frame and of the frame this far behind it.
LAG = 6
#: Further keys join so many integers so far apart. They hold so many of their bits, in so many random subsets, drawn from the
#: LIVELY bits of an integer that tell most: bits that hardly vary cost a noisy copy as much and keep no stranger away.
WORDS, STEP_BETWEEN, KEPT_BITS, SUBSETS, LIVELY = 4, 4, 52, 6, 20
#: Recordings of fewer integers, which overlap too little for those, share so many of the 64 bits of two, in so many subsets.
SHORT, SHORT_BITS, SHORT_SUBSETS = 40, 52, 4
#: So many keys of each recording, the least ones, put near copies into one class before all keys are compared.
SKETCH = 32
SEED = 11


@lru_cache(4)
def _pitch_bins(rate: int) -> tuple[np.ndarray, np.ndarray]:
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    at = np.flatnonzero((hz >= LOW_HZ) & (hz <= min(HIGH_HZ, rate / 2)))
    return at, np.round(12 * np.log2(hz[at] / 440.0)).astype(int) % 12


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by pitch classes, each frame of unit length (zeros where it is silent); short recordings are padded to a frame."""
    x = np.asarray(samples, np.float64)
    x = np.pad(x, (0, max(0, FRAME - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    at, pitch = _pitch_bins(rate)
    out = np.zeros((len(frames), 12))
    for k in range(12):
        out[:, k] = power[:, at[pitch == k]].sum(axis=1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def filters() -> list[tuple[int, int, int, int]]:
    """Kind, first pitch class, number of classes, number of frames: by rule, four kinds over growing bands and stretches."""
    return [(i % 4, (5 * i) % 9, 2 + i % 3 + (i % 4 == 1), (4, 6, 8, SPAN)[i // 4]) for i in range(16)]


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """One unsigned 32-bit integer for each frame that has SPAN - 1 frames after it."""
    c = chroma(samples, rate)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, high, wide in filters():
        top, half, mid = min(12, y + high), wide // 2, y + max(1, (min(12, y + high) - y) // 2)
        if kind == 0:  # against the rest of the classes
            a, b = area(0, wide, y, top), area(0, wide, 0, 12) - area(0, wide, y, top)
        elif kind == 1:  # lower against upper half of the band
            a, b = area(0, wide, y, mid), area(0, wide, mid, top)
        elif kind == 2:  # earlier against later half of the stretch
            a, b = area(0, half, y, top), area(half, wide, y, top)
        else:  # opposite corners
            a, b = area(0, half, y, mid) + area(half, wide, mid, top), area(0, half, mid, top) + area(half, wide, y, mid)
        r = np.log((1 + a) / (1 + b))
        level = (r > -STEP).astype(np.uint32) + (r > 0) + (r > STEP)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float] | None:
    """(offset of b in a, share of differing bits over the aligned stretch), or None where no integer is common.

    Only offsets count at which half of the shorter recording overlaps. Ties of the histogram go to the smallest offset.
    """
    at = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[at], b, "left"), np.searchsorted(a[at], b, "right")
    if not (hi > lo).any():
        return None
    offsets = np.concatenate([at[x:y] - j for j, (x, y) in enumerate(zip(lo, hi, strict=True)) if y > x])
    overlap = np.minimum(len(a), offsets + len(b)) - np.maximum(0, offsets)
    offsets = offsets[2 * overlap >= min(len(a), len(b))]
    if not len(offsets):
        return None
    values, votes = np.unique(offsets, return_counts=True)
    to = int(values[votes.argmax()])
    x, y = a[max(0, to) :], b[max(0, -to) :]
    n = min(len(x), len(y))
    return to, float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n)


def _pairs(codes: np.ndarray) -> np.ndarray:
    return codes[:-LAG].astype(np.uint64) << np.uint64(32) | codes[LAG:]


def matches(a: np.ndarray, b: np.ndarray, found: tuple[int, float] | None, max_bit_error: float = MAX_BIT_ERROR) -> bool:
    """Whether few enough bits differ where a and b align, as found by align().

    Without two common integers LAG frames apart less may differ the shorter the aligned stretch is: over half of a recording
    unrelated ones come below MAX_BIT_ERROR by chance, as often as once in a thousand pairs.
    """
    if found is None or found[1] > max_bit_error:
        return False
    overlap = min(len(a), found[0] + len(b)) - max(0, found[0])
    return found[1] <= max_bit_error * overlap / min(len(a), len(b)) or bool(np.isin(_pairs(a), _pairs(b)).any())


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for held, rate in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            pcm = held.as_py()
            usable = pcm and rate and len(pcm) >= 2
            out.append(fingerprint(np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2"), rate).view(np.int32) if usable else np.empty(0, np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["rec_id", "codes"])


def fingerprints(recordings: DataFrame) -> DataFrame:
    """(rec_id, codes array of int) of recordings (rec_id long, pcm binary of little-endian 16-bit mono samples, rate int).

    Null, empty and too short recordings have no codes.
    """
    bounded_batches(recordings.sparkSession)
    return recordings.select(F.col("rec_id").cast("long").alias("rec_id"), "pcm", F.col("rate").cast("int").alias("rate")).mapInArrow(_prints, "rec_id long, codes array<int>")


def _aligned(batches: Iterator[pa.RecordBatch], max_bit_error: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [(np.array(x, np.int32).view(np.uint32), np.array(y, np.int32).view(np.uint32)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        found = [align(x, y) for x, y in both]
        same = [matches(x, y, f, max_bit_error) for (x, y), f in zip(both, found, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f and f[0] for f in found], pa.int64()), pa.array([f and f[1] for f in found], pa.float64()), pa.array(same, pa.bool_())], names=["a", "b", "offset", "bit_error", "same"])


def align_pairs(pairs: DataFrame, prints: DataFrame, max_bit_error: float = MAX_BIT_ERROR) -> DataFrame:
    """pairs (a, b) with offset and bit_error, null where they have no integer in common, and same, as of matches(). prints: rec_id, codes."""
    one = prints.select(F.col("rec_id").alias("a"), F.col("codes").alias("x"))
    two = prints.select(F.col("rec_id").alias("b"), F.col("codes").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(partial(_aligned, max_bit_error=max_bit_error), "a long, b long, offset long, bit_error double, same boolean")


def _lively(nodes: DataFrame) -> list[int]:
    """The LIVELY bits of the integers that are nearest to being set in half of them."""
    said = nodes.select(F.explode("codes").alias("c")).agg(F.count("*"), *[F.sum(F.getbit("c", F.lit(bit))) for bit in range(32)]).first()
    return sorted(range(32), key=lambda bit: abs(said[0] - 2 * (said[bit + 1] or 0)))[:LIVELY]


def _masks(words: int, bits: int, subsets: int, among: list[int]) -> list[list[int]]:
    """Of each subset the bits kept of each integer, as signed integers."""
    rng, pool = np.random.default_rng(SEED), np.add.outer(32 * np.arange(words), among).ravel()
    return [np.packbits(np.isin(np.arange(32 * words), rng.permutation(pool)[:bits]), bitorder="little").view("<i4").tolist() for _ in range(subsets)]


def _subset_keys(masks: list[list[int]], step: int) -> F.Column:
    def at(x: F.Column, i: F.Column) -> F.Column:
        ints = [x, *[F.get("codes", i + step * k) for k in range(1, len(masks[0]))]]
        return F.array(*[F.xxhash64(*[v.bitwiseAND(F.lit(m)) for v, m in zip(ints, mask, strict=True)], F.lit(i)) for i, mask in enumerate(masks)])

    return F.array_distinct(F.flatten(F.transform(F.slice("codes", 1, F.greatest(F.size("codes") - step * (len(masks[0]) - 1), F.lit(0))), at)))


def _keys(lively: list[int]) -> tuple[F.Column, F.Column]:
    """The keys of a recording, and those in which short recordings meet all others."""
    after = F.slice("codes", LAG + 1, F.greatest(F.size("codes") - LAG, F.lit(0)))
    pairs = F.array_distinct(F.zip_with(F.slice("codes", 1, F.size(after)), after, lambda x, y: F.xxhash64(x, y)))
    two = _subset_keys(_masks(2, SHORT_BITS, SHORT_SUBSETS, list(range(32))), LAG)
    more = F.when(F.size("codes") < SHORT, two).otherwise(F.array().cast("array<bigint>"))
    return F.concat(pairs, _subset_keys(_masks(WORDS, KEPT_BITS, SUBSETS, lively), STEP_BETWEEN), more), two


def _buckets(nodes: DataFrame, keys: F.Column, two: F.Column) -> DataFrame:
    """shared_buckets() of nodes (node, codes, comp). Long recordings meet in subsets of two integers only where a short one does."""
    short = F.size("codes") < SHORT
    held = materialize(nodes.where(short).select(F.explode(two).alias("key")).distinct(), "short-keys")
    more = None if held.isEmpty() else may_match(nodes.where(~short).select(F.explode(two).alias("key"), "node", F.lit(1).alias("n"), "comp"), "key", held).join(held, "key", "left_semi")
    return shared_buckets(nodes.select("node", F.lit(1).alias("n"), keys.alias("keys"), "comp"), more)


def match_recordings(prints: DataFrame, max_bit_error: float = MAX_BIT_ERROR) -> DataFrame:
    """One row for each row of prints (rec_id long, codes array of int).

    rec_id, n_codes long, component_id long (smallest rec_id reachable over matches), kept boolean (rec_id = component_id),
    offset long and bit_error double (alignment with that recording; 0 and 0 for itself, null where none is common).

    Recordings match as of matches(); candidates share two integers LAG frames apart, or four in a subset of their bits, so
    few of the matches whose bits differ by up to a sixteenth are lost. Recordings of at most LAG integers match only if equal.
    Equal fingerprints collapse first, then most near copies by a few keys of each; all keys decide what else meets. Recordings without codes match nothing; rows without rec_id have component_id null and
    kept true; rows that share a rec_id are one node, which the smallest codes stand for.
    """
    prints = materialize(prints, "prints")
    named = prints.where("rec_id is not null and size(codes) > 0").groupBy("rec_id").agg(F.min("codes").alias("codes"))
    nodes = materialize(named.groupBy("codes").agg(F.min("rec_id").alias("node")), "nodes")
    keys, two = _keys(_lively(nodes))
    shapes = nodes.select(F.col("node").alias("rec_id"), "codes")

    def confirm(pairs: DataFrame) -> DataFrame:
        return align_pairs(pairs, shapes, max_bit_error).where("same").select("a", "b")

    sketches = nodes.select("node", F.lit(1).alias("n"), F.slice(F.array_sort(keys), 1, SKETCH).alias("keys"))
    first = first_classes(shared_buckets(sketches), confirm)
    classed = nodes.join(first, "node", "left").select("node", "codes", F.coalesce("component", "node").alias("comp"))
    components = linked_classes(_buckets(materialize(classed, "classed"), keys, two), confirm, components=first)
    classes = materialize(nodes.join(components, "node", "left").select("codes", "node", F.coalesce("component", "node").alias("component_id")), "classes")
    aligned = align_pairs(classes.where("node <> component_id").select(F.col("component_id").alias("a"), F.col("node").alias("b")), shapes).select(F.col("b").alias("node"), "offset", "bit_error")
    known = named.join(classes.join(aligned, "node", "left"), "codes").select("rec_id", "component_id", F.when(F.col("node") == F.col("component_id"), F.lit(0)).otherwise(F.col("offset")).alias("offset"), F.when(F.col("node") == F.col("component_id"), F.lit(0.0)).otherwise(F.col("bit_error")).alias("bit_error"))
    out = prints.select("rec_id", F.size("codes").cast("long").alias("n_codes")).join(known, "rec_id", "left")
    return out.select("rec_id", "n_codes", F.coalesce("component_id", "rec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "rec_id") == F.col("rec_id"), F.lit(True)).alias("kept"), F.coalesce(F.col("offset"), F.when(F.col("component_id").isNull(), F.lit(0))).cast("long").alias("offset"), F.coalesce("bit_error", F.when(F.col("component_id").isNull(), F.lit(0.0))).alias("bit_error"))


RATE = 4000
NOTE = 256
#: Range of a melody on either side of 440 Hz: small, so that near vectors sound alike.
OCTAVES = 0.4


#: Recordings rendered into one batch.
RENDER_ROWS = 64


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(i, RENDER_ROWS) for whole in batches for i in range(0, whole.num_rows, RENDER_ROWS)):
        pcm = []
        for vector in batch.column(1).to_pylist():
            v = np.array([0.0 if x is None or not np.isfinite(x) else x for x in vector or []])
            hz = 440.0 * 2 ** np.clip(v / max(np.abs(v).max(initial=0), 1e-9) * OCTAVES, -OCTAVES, OCTAVES)
            phase = 2 * np.pi * np.cumsum(np.repeat(hz, NOTE)) / RATE
            pcm.append((np.sin(phase) * 12000).astype("<i2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pcm, pa.binary()), pa.array(np.full(len(pcm), RATE, np.int32))], names=["rec_id", "pcm", "rate"])


def render_vectors(vectors: DataFrame, name: str = "vec_id", values: str = "embedding") -> DataFrame:
    """Test recordings (rec_id, pcm, rate): a melody with one note for each component of a vector."""
    return vectors.select(F.col(name).cast("long").alias("rec_id"), F.col(values).alias("v")).mapInArrow(_render, "rec_id long, pcm binary, rate int")
