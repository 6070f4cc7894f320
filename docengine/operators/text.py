"""Extraction quality, exports and search over the lines of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.sources.tables import held, paged


def page_quality(lines: DataFrame) -> DataFrame:
    """Characters and lines of each page, and its low-confidence flag: it drew something, of which only white space came out.

    A page that drew nothing is blank, which is another thing. drew is a column of lines, if there is one; else what has
    characters was drawn.
    """
    drew = F.bool_or("drew") if "drew" in lines.columns else F.sum(F.length("text")) > 0
    return lines.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("characters"), F.count("*").alias("lines"), (drew & ~F.bool_or(T.has_text(F.col("text")))).alias("low_confidence"))


def extraction_quality(pages: DataFrame) -> DataFrame:
    """Totals of each document and its verdict: low-confidence before empty before ok."""
    total = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum("characters").alias("characters"), F.count_if(F.col("characters") == 0).alias("blank_pages"), F.count_if((F.col("characters") > 0) & ~F.col("low_confidence")).alias("text_pages"), F.count_if("low_confidence").alias("low_pages")
    )
    return with_verdict(total)


def with_verdict(total: DataFrame) -> DataFrame:
    return total.withColumn("verdict", F.when(F.col("low_pages") > 0, "low-confidence").when(F.col("characters") == 0, "empty").otherwise("ok"))


def document_pages(documents: DataFrame) -> DataFrame:
    """documents' doc_id and quality, an array of what page_quality() tells of each page; null texts have no pages."""
    def page(number: Column, ls: Column) -> Column:
        def facts(t: Column) -> Column:
            return F.struct(number.alias("page"), F.length(t).cast("long").alias("characters"), F.size(ls).cast("long").alias("lines"), ((t != "") & ~T.has_text(t)).alias("low_confidence"))

        return held(F.array_join(ls, ""), facts)

    return documents.where("text is not null").select("doc_id", paged(F.col("text"), page).alias("quality"))


def document_quality(documents: DataFrame) -> DataFrame:
    """What extraction_quality() tells, without a shuffle."""
    of = lambda f: F.size(F.filter("quality", f)).cast("long")
    total = document_pages(documents).select(
        "doc_id", F.size("quality").cast("long").alias("pages"), F.aggregate("quality", F.lit(0).cast("long"), lambda a, p: a + p["characters"]).alias("characters"), of(lambda p: p["characters"] == 0).alias("blank_pages"),
        of(lambda p: (p["characters"] > 0) & ~p["low_confidence"]).alias("text_pages"), of(lambda p: p["low_confidence"]).alias("low_pages"),
    )
    return with_verdict(total)


def to_markdown(documents: DataFrame) -> DataFrame:
    """Stripped lines with text, blank lines between them; documents without any are left out."""
    text = F.col("text")
    return documents.where(T.has_text(text)).select("doc_id", F.regexp_replace(T.strip(text), T.LINE_ENDS, "\n\n").alias("markdown"))


def with_page_separators(documents: DataFrame) -> DataFrame:
    def join(bodies: Column) -> Column:
        marked = F.transform(bodies, lambda b, i: F.concat(T.page_separator(i + 1, F.size(bodies)), F.lit("\n"), b))
        return F.array_join(marked, "\n")

    bodies = paged(F.col("text"), lambda _, ls: F.array_join(ls, "\n"))
    return documents.where("text is not null").select("doc_id", held(bodies, join).alias("text"))


def search_lines(lines: DataFrame, needle: str) -> DataFrame:
    return lines.withColumn("matches", T.match_count(F.col("text"), needle)).where("matches > 0")


def search_capped(documents: DataFrame, needle: str, cap: int) -> DataFrame:
    """Of each document the first cap matching lines, with the document's total and whether it was cut."""
    counted = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(i.cast("long").alias("line"), T.match_count(t, needle).alias("matches"), t.alias("text")))
    # the cheap test goes first; a document that passes without a matching line has no rows to explode
    found = documents.where(F.contains(F.lower("text"), F.lit(needle.lower()))).select("doc_id", F.filter(counted, lambda r: r["matches"] > 0).alias("found"))
    total = F.aggregate("found", F.lit(0).cast("long"), lambda a, r: a + r["matches"])
    rows = found.select("doc_id", total.alias("total"), (F.size("found") > cap).alias("truncated"), F.posexplode(F.slice("found", 1, cap)).alias("rank", "r"))
    return rows.select("doc_id", "r.line", "r.text", "r.matches", "total", (F.col("rank") + 1).cast("long").alias("rank"), "truncated")


def duplicates(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, digest, survivor: byte-identical rows share the smallest key. A large group is summed up before it is joined."""
    own = rows.select(key, F.sha2(body, 256).alias("digest"))
    return own.join(own.groupBy("digest").agg(F.min(key).alias("survivor")), "digest").select(key, "digest", "survivor")
