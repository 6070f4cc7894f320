from pyspark.sql import functions as F

from docengine.functions import permissions, values
from docengine.operators import pages, sweep


def one(spark, column, *args):
    """The column's value for a row of args, named a, b and so on; all may be null."""
    return spark.createDataFrame([args], ", ".join(f"{n} {'boolean' if isinstance(x, bool) else 'long' if isinstance(x, int) else 'string'}" for n, x in zip("abcd", args))).select(column).head()[0]


def test_nulls_and_empty_specs(spark):
    a, n = F.col("a"), F.lit(2).cast("long")
    assert one(spark, permissions.grants(a), None).error.startswith("empty")
    assert one(spark, pages.parse_order(a, n), None).error == "`` lists 0 pages but the document has 2; reorder needs every page exactly once"
    assert one(spark, pages.parse_order(a, F.lit(0).cast("long")), "").pages == []
    assert one(spark, pages.parse_indexes(a, n), "0-99999999999").error == "page 2 out of range (document has 2 pages)"
    assert one(spark, pages.parse_indexes(a, n), "-1").error == "`-1` is not a page range"
    for f in (values.length_units, values.colour):
        assert one(spark, f(a), None) is None and one(spark, f(a), "") is None
    assert one(spark, values.part_name(F.lit(""), a), "a/../b") == "b"


def test_decisions(spark):
    a, b, c, d = map(F.col, "abcd")
    assert one(spark, permissions.may(a, b, c), 0, "print", None) is False
    assert one(spark, permissions.may(a, b, c), 8, "fly", True) is None
    assert one(spark, permissions.decision(a, b, c, d), 0, "print", True, None) == "override"
    assert one(spark, permissions.decision(a, b, c, d), 8, "print", True, "override") == "honour"


def test_ranges_without_bounds(spark):
    none, n = F.lit(None).cast("long"), F.lit(5).cast("long")
    assert one(spark, pages.clamp_range(none, none, n), 1)[:] == (0, 4, None)


def test_blank_pages(spark):
    rows = spark.createDataFrame([(1, 0, 2), (1, 1, 2)], "doc long, page long, pages long")
    at = lambda after: [(r.position, r.blank) for r in pages.insert_blank(rows, F.lit(after).cast("long"), 2).orderBy("position").collect()]
    assert at(0) == [(0, True), (1, True), (2, False), (3, False)]
    assert at(1) == [(0, False), (1, True), (2, True), (3, False)]
    assert at(None) == [(0, False), (1, False), (2, True), (3, True)]
    assert at(3) == [(0, False), (1, False)]


def test_severity_of_nothing_known(spark):
    rows = spark.createDataFrame([(1, None), (1, "odd"), (2, "notice"), (2, "ok")], "k long, s string")
    assert {r.k: r.worst for r in sweep.worst_severity(rows, ["k"], "s").collect()} == {1: "ok", 2: "notice"}
