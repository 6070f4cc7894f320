"""Selecting, splitting, numbering, labelling and interleaving ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.sources.tables import paged


def parse_selection(spec: Column, count: Column) -> Column:
    """'1,3-5' to (pages, error): distinct 1-based pages in the order given, or null pages and what is wrong.

    An empty or null selection takes all pages. What is no number, lies outside of the document or runs backwards is refused.
    """
    def number(x: Column) -> Column:
        x = T.strip(x)
        return F.when(x.rlike("^[+]?[0-9]+$"), x.try_cast("long"))

    def wrong(x: Column) -> Column:
        n = number(x)
        outside = F.concat(F.lit("page "), n.cast("string"), F.lit(" is outside this document (1-"), count.cast("string"), F.lit(")"))
        return F.when(n.isNull(), F.concat(F.lit('"'), T.strip(x), F.lit('" is not a page number'))).when((n < 1) | (n > count), outside)

    def part(p: Column) -> Column:
        first = F.substring_index(p, "-", 1)
        last = F.when(F.contains(p, F.lit("-")), F.substr(p, F.length(first) + 2)).otherwise(p)
        backward = F.when(number(first) > number(last), F.concat(F.lit('page range "'), p, F.lit('" runs backwards')))
        error = F.coalesce(wrong(first), wrong(last), backward)
        return F.struct(error.alias("error"), F.when(error.isNull(), F.sequence(number(first), number(last))).alias("pages"))

    text = T.strip(F.coalesce(spec, F.lit("")))
    parts = F.transform(F.filter(F.transform(F.split(text, ","), T.strip), lambda p: p != ""), part)
    every = F.when(count >= 1, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>"))
    error = F.try_element_at(F.filter(F.transform(parts, lambda p: p["error"]), lambda e: e.isNotNull()), F.lit(1))
    error = F.when(text == "", F.lit(None)).when(count < 1, "the document has no pages").when(F.size(parts) == 0, "no pages selected").otherwise(error)
    chosen = F.when(text == "", every).when(error.isNull(), F.array_distinct(F.flatten(F.transform(parts, lambda p: p["pages"]))))
    return F.struct(chosen.alias("pages"), error.alias("error"))


def _listed(spec: Column, count: Column) -> tuple[Column, Column]:
    """The pages from 0 of '2,0-1' in the order given, repeats included, and what is wrong first."""
    def number(x: Column) -> Column:
        x = T.strip(x)
        return F.when(x.rlike("^[+]?[0-9]+$"), x.try_cast("long"))

    def part(p: Column) -> Column:
        ranged = F.contains(p, F.lit("-"))
        first = F.when(ranged, number(F.substring_index(p, "-", 1))).otherwise(number(p))
        last = F.when(ranged, number(F.substr(p, F.instr(p, "-") + 1))).otherwise(first)
        said = lambda end: F.concat(F.lit("`"), p, F.lit("` " + end))
        error = (
            F.when(first.isNull() | last.isNull(), F.when(ranged, said("is not a page range")).otherwise(said("is not a page number"))).when(first > last, F.concat(F.lit("range `"), p, F.lit("` goes backwards")))
            .when(last >= count, F.concat(F.lit("page "), F.greatest(first, count).cast("string"), F.lit(" out of range (document has "), count.cast("string"), F.lit(" pages)")))
        )
        return F.struct(error.alias("error"), F.when(error.isNull(), F.sequence(first, last)).alias("pages"))

    parts = F.transform(F.filter(F.transform(F.split(spec, ","), T.strip), lambda p: p != ""), part)
    error = F.get(F.filter(F.transform(parts, lambda p: p["error"]), lambda e: e.isNotNull()), F.lit(0))
    return F.when(error.isNull(), F.flatten(F.transform(parts, lambda p: p["pages"]))), error


def parse_indexes(spec: Column, count: Column) -> Column:
    """'0,2-4' to (pages, error): distinct pages from 0 in the order given; no pages are refused."""
    spec = F.coalesce(spec, F.lit(""))
    listed, error = _listed(spec, count)
    error = F.coalesce(error, F.when(F.size(listed) == 0, F.concat(F.lit("`"), spec, F.lit("` selects no pages"))))
    return F.struct(F.when(error.isNull(), F.array_distinct(listed)).alias("pages"), error.alias("error"))


def parse_order(spec: Column, count: Column) -> Column:
    """'2,0-1' to (pages, error): every page from 0 exactly once."""
    spec = F.coalesce(spec, F.lit(""))
    listed, error = _listed(spec, count)
    twice = F.get(F.filter(listed, lambda p, i: F.array_position(listed, p) <= i), F.lit(0))
    quoted = F.concat(F.lit("`"), spec, F.lit("` lists "))
    error = F.coalesce(
        error, F.when(F.size(listed) != count, F.concat(quoted, F.size(listed).cast("string"), F.lit(" pages but the document has "), count.cast("string"), F.lit("; reorder needs every page exactly once"))),
        F.when(twice.isNotNull(), F.concat(quoted, F.lit("page "), twice.cast("string"), F.lit(" twice"))),
    )
    return F.struct(F.when(error.isNull(), listed).alias("pages"), error.alias("error"))


def clamp_range(first: Column, last: Column, count: Column) -> Column:
    """(first, last, error) of a page range from 0, cut to the document; without a range, the whole of it."""
    end = F.greatest(count - 1, F.lit(0))
    error = F.when(first > last, "search page range is empty")
    some = lambda x, other: F.when(error.isNull(), F.when(x.isNull(), other).otherwise(F.least(x, end)))
    return F.struct(some(first, F.lit(0).cast("long")).alias("first"), some(last, end).alias("last"), error.alias("error"))


#: Fixed value: blank pages that one call may insert.
MOST_BLANK = 100


def insert_blank(rows: DataFrame, after: Column, n: int) -> DataFrame:
    """rows, numbered(), with n blank pages after the first after of them (null: at the end): position, blank, error.

    A blank page takes what else the row beside it holds. Where after lies outside of the document, its rows stay as they are
    and error says so. Each document's blanks come from one of its rows, so nothing is shuffled.
    """
    if not 1 <= n <= MOST_BLANK:
        raise ValueError(f"between 1 and {MOST_BLANK} blank pages can be inserted at once")
    at = F.coalesce(after, F.col("pages"))
    error = F.when((at > F.col("pages")) | (at < 0), F.concat(F.lit("insert position "), at.cast("string"), F.lit(" is out of range (document has "), F.col("pages").cast("string"), F.lit(" pages)")))
    page = F.col("page")
    own = F.struct((page + F.when(error.isNull() & (page >= at), n).otherwise(0)).alias("position"), F.lit(False).alias("blank"))
    blanks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((at + i).alias("position"), F.lit(True).alias("blank")))
    beside = error.isNull() & (page == F.greatest(at - 1, F.lit(0)))
    made = F.when(beside, F.concat(F.array(own), blanks)).otherwise(F.array(own))
    return rows.select("*", error.alias("error"), F.inline(made))


def spread_rows(rows: DataFrame) -> DataFrame:
    """rows, numbered(), with row and slot of a view of two pages a row; the first of an odd number stands alone."""
    shifted = F.col("page") + F.col("pages") % 2
    return rows.withColumn("row", F.floor(shifted / 2)).withColumn("slot", F.when((F.col("page") == 0) | (shifted % 2 == 0), 0).otherwise(1))


def numbered(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """rows with page (from 0) and pages within each by."""
    w = Window.partitionBy(*by)
    return rows.withColumn("page", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("pages", F.count("*").over(w))


def split_every(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("part", F.floor(F.col("page") / n))


def split_half(rows: DataFrame) -> DataFrame:
    """The first half, rounded down, and the rest; a single page is one part."""
    return rows.withColumn("part", F.when(F.col("page") < F.floor(F.col("pages") / 2), 0).otherwise(1).cast("long"))


def n_up(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("sheet", F.floor(F.col("page") / k)).withColumn("cell", F.col("page") % k)


def mix_inputs(rows: DataFrame, group: str, source: str) -> DataFrame:
    """Round robin over the sources of a group: first pages first."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy("page", source)).cast("long"))


def split_by_text(documents: DataFrame, needle: str) -> DataFrame:
    """(doc_id, page, part): a part begins at each page but the first with a line that contains needle, whatever its case.

    Documents without such a page are left out. White space around needle does not count; nothing else is refused.
    """
    needle = needle.strip().lower()
    if not needle:
        raise ValueError("nothing to look for")
    hits = paged(F.col("text"), lambda _, ls: F.exists(ls, lambda t: F.contains(F.lower(t), F.lit(needle))))
    rows = documents.select("doc_id", hits.alias("hits")).withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda p: (p == 0) | F.get("hits", p))).where(F.size("starts") > 1)
    ends = F.array_append(F.slice("starts", 2, F.size("starts")), F.size("hits"))
    parts = rows.select("doc_id", F.posexplode(F.transform(F.arrays_zip(F.col("starts"), ends.alias("ends")), lambda s: F.sequence(s["starts"], s["ends"] - 1))).alias("part", "pages"))
    return parts.select("doc_id", F.explode(F.col("pages").cast("array<bigint>")).alias("page"), F.col("part").cast("long").alias("part"))


def split_by_size(documents: DataFrame, target: int) -> DataFrame:
    """(doc_id, line, size, part, oversize): greedy runs of lines whose sizes stay within target; a larger line stands alone.

    A document is cut within its row; only a part's beginning extends the state.
    """
    sizes = F.transform(F.split("text", "\n", -1), lambda t: F.octet_length(t).cast("long"))
    start = F.struct(F.lit(0).alias("line"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, size: Column) -> Column:
        new = (s["line"] == 0) | (s["used"] + size > target)
        return F.struct((s["line"] + 1).alias("line"), F.when(new, size).otherwise(s["used"] + size).alias("used"), F.when(new, F.array_append(s["starts"], s["line"])).otherwise(s["starts"]).alias("starts"))

    rows = documents.select("doc_id", sizes.alias("sizes")).where("sizes is not null").withColumn("starts", F.aggregate("sizes", start, step, lambda s: s["starts"]))
    ends = F.array_append(F.slice("starts", 2, F.size("starts")), F.size("sizes"))
    spans = F.arrays_zip(F.col("starts"), ends.alias("ends"))
    parts = rows.select("doc_id", F.posexplode(F.transform(spans, lambda s: F.struct(s["starts"].alias("at"), F.slice("sizes", s["starts"] + 1, s["ends"] - s["starts"]).alias("sizes")))).alias("part", "p"))
    found = parts.select("doc_id", "part", F.col("p.at").alias("at"), F.posexplode("p.sizes").alias("i", "size"))
    return found.select("doc_id", (F.col("at") + F.col("i")).cast("long").alias("line"), "size", F.col("part").cast("long").alias("part"), (F.col("size") > target).alias("oversize"))


def bookmark_ranges(starts: DataFrame, by: str, start: str, last: Column) -> DataFrame:
    """(by, first, last): from each start to before the next, and a preamble before the first start."""
    w = Window.partitionBy(by).orderBy(start)
    body = starts.select(by, F.col(start).alias("first"), F.coalesce(F.lead(start).over(w) - 1, last).alias("last"))
    head = starts.groupBy(by).agg(F.min(start).alias("s")).where("s > 0").select(by, F.lit(0).cast("long").alias("first"), (F.col("s") - 1).alias("last"))
    return body.unionByName(head)


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of right's latest row at or before it: one shuffle by key, no range join."""
    rows = left.withColumn("__side", F.lit(1)).unionByName(right.select(*by, at, *values).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last(F.when(F.col("__side") == 0, F.struct(*values)), ignorenulls=True).over(w)
    return rows.withColumn("__held", held).where("__side = 1").select(*left.columns, *[F.col("__held")[v].alias(v) for v in values])


def unique_names(rows: DataFrame, by: list[str], name: str, order: list) -> DataFrame:
    """Second and later holders of a name get -2, -3 and so on; none is dropped."""
    n = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))
    return rows.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))


def latest(rows: DataFrame, by: list[str], revision: str, upto: Column | None = None) -> DataFrame:
    """The newest row of each key, of revisions up to one if given."""
    rows = rows if upto is None else rows.where(F.col(revision) <= upto)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(revision)))).where("__n = 1").drop("__n")
