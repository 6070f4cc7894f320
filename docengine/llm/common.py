"""Shared helpers: the folder for intermediate tables, and words and shingles of a text."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []

#: Row groups of intermediate tables, which a writing task holds in memory.
WRITE_BYTES = 16 << 20

#: Rows and bytes of an Arrow batch handed to a Python worker that holds whole texts.
TEXT_BATCH_ROWS = 1024
TEXT_BATCH_BYTES = 2 << 20
#: Bits of the filter of may_match() at most, a sixty-fourth of which are the rows it broadcasts.
FILTER_BITS = 26
#: A key is spread over several tasks if it holds more rows than this, and more than one of HOT_SHARE of all rows. So at most
#: HOT_SHARE keys are, whose list is broadcast.
HOT_ROWS, HOT_SHARE = 1000, 10_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names the folder in ``spark.checkpoint.dir``. Only where that is unset and all runs in this process, as in
    tests, a temporary folder of this machine is made, set and removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="docengine-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(path := f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path


def release(spark: SparkSession, since: int | None = 0, keep: int = 0) -> int:
    """Delete the intermediate tables made after the first since ones, but the last keep; say how many are left.

    Results that are not yet read need them. None deletes nothing.
    """
    since, end = len(_made) if since is None else since, len(_made) - keep
    for name in _made[since:end]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _made[since : max(since, end)]
    return len(_made)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("parquet.block.size", WRITE_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _flagged(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows with __may: whether their column may be in the equally named column of keys, a written table.

    A Bloom filter of one hash in words of 64 bits, of sixteen bits or more for each key. It is broadcast: its size is bounded
    by FILTER_BITS and not by the data. The fuller it is the more rows it flags; it flags every row that matches.
    """
    bits = min(1 << FILTER_BITS, 1 << max(16, (16 * keys.count()).bit_length()))

    def place(df: DataFrame) -> DataFrame:
        at = F.pmod(F.xxhash64(column), F.lit(bits))
        return df.withColumn("__word", F.shiftright(at, 6)).withColumn("__bit", (at % 64).cast("int"))

    words = place(keys.select(column)).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    found = place(rows).join(F.broadcast(words), "__word", "left")
    return found.withColumn("__may", F.coalesce(F.getbit("__bits", "__bit") == 1, F.lit(False))).drop("__word", "__bit", "__bits")


def may_match(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows without most of those whose column is not in keys, a written table; an equi-join is to follow."""
    return _flagged(rows, column, keys).where("__may").drop("__may")


def left_join(rows: DataFrame, column: str, small: DataFrame) -> DataFrame:
    """rows.join(small, column, "left"), small a written table of unique keys. Only rows that may match are shuffled."""
    more = [F.lit(None).cast(t).alias(c) for c, t in small.dtypes if c != column]
    if small.isEmpty():
        return rows.select("*", *more)
    flagged = _flagged(rows, column, small)
    joined = flagged.where("__may").drop("__may").join(small, column, "left")
    return joined.select(*rows.columns, *[c for c in small.columns if c != column]).unionByName(flagged.where("not __may").drop("__may").select("*", *more))


def with_salt(rows: DataFrame, key: str, counts: DataFrame, by: str) -> DataFrame:
    """rows with salts (into how many parts its key is dealt) and salt (its part, by a hash of column by).

    counts: a written table of key and m, its number of rows. A value for each key joins on key and salt after salted().
    """
    total = counts.agg(F.sum("m")).first()[0] or 0
    part = max(HOT_ROWS, total // HOT_SHARE)
    hot = counts.where(F.col("m") > part).select(key, F.ceil(F.col("m") / part).cast("int").alias("salts"))
    out = rows.join(F.broadcast(hot), key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    return out.withColumn("salt", F.pmod(F.xxhash64(by), F.col("salts")).cast("int"))


def salted(values: DataFrame) -> DataFrame:
    """values (one row for each key, with salts) repeated for each salt."""
    return values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, in rows and in bytes; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def frugal(leaf: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """An Arrow leaf after which the worker, which goes on to other tasks, gives unused memory back."""

    @wraps(leaf)
    def run(batches: Iterator, *args, **options) -> Iterator:
        try:
            yield from leaf(batches, *args, **options)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return run


def split_words(text: bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D; null has none."""
    return text.split() if text else []


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of all words as one shingle if they are fewer than k."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    joined = b" ".join(words)
    if n <= k:
        return np.array([digest(joined)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: n - k] + 1).tolist()]
    ends = [*gaps[k - 1 :].tolist(), len(joined)]
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends, strict=True)), np.uint64, n - k + 1))
