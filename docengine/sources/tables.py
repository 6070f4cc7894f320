"""Scans: the tables of a folder, the lines and pages of documents, and files as bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_LINES = 40


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modified, length, content: a change of (length, modified) between reads tells a mutated source."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).withColumnRenamed("modificationTime", "modified")


def memory_files(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")


def lines(documents: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """doc_id, line (from 0), page (from 0), text; null texts have no lines."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.floor(F.col("line") / page_lines).alias("page"), "text")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, in rows and in bytes; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, also where use reads it in a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def paged(text: Column, page: Callable[[Column, Column], Column], page_lines: int = PAGE_LINES) -> Column:
    """Array of page(number from 0, its lines) of a text; null for null. Pages are cut within the row, so nothing is shuffled."""
    def cut(ls: Column) -> Column:
        numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.size(ls) - 1) / page_lines))
        return F.transform(numbers, lambda p: page(p, F.slice(ls, (p * page_lines + 1).cast("int"), F.lit(page_lines))))

    return held(F.split(text, "\n", -1), cut)
