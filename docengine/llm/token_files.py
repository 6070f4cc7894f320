"""Token ids as Parquet list columns, in ascending doc_id order.

Rows are range-partitioned by doc_id (and by a hash of the text where a doc_id repeats often) and encoded in order. Files hold doc_id, part and row (a file's place and a row's place
in it), part_start (ids before the row in its file), n_tokens and ids. Ids are dictionary-encoded (delta-packed where the
dictionary overflows, by format version 2), the counters delta-packed; row groups and pages are small, and Parquet's column
and offset indexes let a reader fetch single documents or only the metadata.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.llm.common import bounded_batches, frugal, materialize
from docengine.llm.tokens import encoder, list_array, slices

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Offsets of up to so many files are broadcast; beyond, they are joined by a shuffle.
BROADCAST_FILES = 500_000
#: Below this share of distinct ids, ranges cut through the rows of an id.
OWN_IDS = 0.9
SCHEMA = "doc_id long, part int, row int, part_start long, n_tokens long, ids array<int>"


@frugal
def _encode(batches: Iterator[pa.RecordBatch], path: str, byte_level: bool, end: int) -> Iterator[pa.RecordBatch]:
    part, row, total = TaskContext.get().partitionId(), 0, 0
    for piece in slices(batches, 1):
        flat, at = encoder(path, byte_level, end).encode(piece.column(1))
        n = piece.num_rows
        place = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n, dtype=np.int32)), pa.array(total + at[:-1]), pa.array(np.diff(at))]
        yield pa.RecordBatch.from_arrays([piece.column(0), *place, list_array(flat, at)], names=[f.split()[0] for f in SCHEMA.split(", ")])
        row, total = row + n, total + int(at[-1])
    encoder(path, byte_level, end).forget()


def write_token_files(documents: DataFrame, path: str, tokenizer: str, end: int, byte_level: bool = True, partitions: int | None = None) -> None:
    """Encode documents (doc_id long, text string; other columns are ignored) into token files at path.

    Null texts count as empty and give the end id alone. Rows come in ascending doc_id order, those without one first; rows
    that share a doc_id are ordered by a hash of their text.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.agg(F.count("*").alias("rows"), F.approx_count_distinct("doc_id").alias("ids")).first()
    often = ids["rows"] > 2 * n and ids["ids"] < OWN_IDS * ids["rows"]  # else no doc_id can fill a partition
    tie = F.xxhash64("text")
    dealt = rows.withColumn("tie", tie).repartitionByRange(n, "doc_id", "tie").drop("tie") if often else rows.repartitionByRange(n, "doc_id")
    ordered = dealt.sortWithinPartitions("doc_id", tie)
    encoded = ordered.mapInArrow(partial(_encode, path=tokenizer, byte_level=byte_level, end=end), SCHEMA)
    (
        encoded.write.option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", "true").parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, columns: tuple[str, ...] = ("ids",), where: Column | None = None) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens and columns: the files' rows with their place in the whole stream.

    where: a condition on doc_id, part, row, part_start or n_tokens; it reaches the scan, which skips row groups and pages by
    their statistics. With columns=() no ids are read. start counts rows that where leaves out as well.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = materialize(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")), "parts")  # one row for each file
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    if parts.count() <= BROADCAST_FILES:
        base = F.broadcast(base)
    if where is not None:
        rows = rows.where(where)
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", *columns)


def read_token_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(doc_id, start, ids) of the tokens [start, stop) of the whole stream, cut at both ends; start is that of the cut ids."""
    found = read_token_files(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    low, high = F.greatest(F.lit(start) - F.col("start"), F.lit(0)), F.least(F.lit(stop) - F.col("start"), F.col("n_tokens"))
    return found.select("doc_id", (F.col("start") + low).alias("start"), F.slice("ids", (low + 1).cast("int"), (high - low).cast("int")).alias("ids"))
