"""Objects, revisions and references of document files, found by scanning their bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
REFERENCE = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+R\b")
KIND = re.compile(rb"/Type\s*/([A-Za-z]+)")
SCHEMA = "path string, version string, rev int, num long, gen int, offset long, kind string, has_stream boolean, body binary, refs array<long>, error string"


def scan(content: bytes) -> list[tuple]:
    """Objects in file order; a revision ends at each %%EOF. Headers inside streams are skipped with their stream."""
    m = re.search(rb"%PDF-(\d\.\d)", content[:1024])
    version = m[1].decode() if m else None
    ends = [m.start() for m in re.finditer(rb"%%EOF", content)]
    out, at = [], 0
    while m := HEADER.search(content, at):
        stop = content.find(b"endobj", m.end())
        body = content[m.end() : stop if stop >= 0 else len(content)]
        dictionary, stream, _ = body.partition(b"stream")
        kind = KIND.search(dictionary)
        out.append((version, sum(e < m.start() for e in ends), int(m[1]), int(m[2]), m.start(), kind[1].decode() if kind else None, bool(stream), body, [int(r[0]) for r in REFERENCE.findall(dictionary)]))
        at = stop + 6 if stop >= 0 else len(content)
    return out


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.string())
    for batch in batches:
        rows = []
        for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = scan(content or b"")
            rows += [(path, *r, None) for r in found] or [(path, *[None] * 9, "no objects")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 11, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def objects(files: DataFrame) -> DataFrame:
    """A row for each object of files (path, content); a file without any has one row with an error."""
    return files.select("path", "content").mapInArrow(_objects, SCHEMA)


def at_revision(found: DataFrame, rev: int | None = None) -> DataFrame:
    """The newest copy of each object, of revisions up to rev if given; later in the file wins."""
    rows = found.where("error is null") if rev is None else found.where((F.col("rev") <= rev) & F.col("error").isNull())
    w = Window.partitionBy("path", "num").orderBy(F.desc("rev"), F.desc("offset"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def references(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("num").alias("src"), F.explode("refs").alias("dst"))
