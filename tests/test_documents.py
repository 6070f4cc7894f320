import pytest
from pyspark.sql import functions as F

from docengine.operators import pages, text
from docengine.plans import catalogue
from docengine.sources.tables import lines

SHUFFLE_FREE = ["page_quality", "extraction_quality", "to_markdown", "page_separators", "search_capped", "split_by_text", "split_by_size"]


@pytest.mark.parametrize("name", SHUFFLE_FREE)
def test_documents_are_not_shuffled(spark, sf_dir, name):
    assert "Exchange" not in catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def documents(spark):
    long = "\n".join(f"line {i} Other" if i % 45 == 0 else f"line {i}" for i in range(200))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "one\n\ntwo"), (5, "one\n\ntwo"), (6, "\n" * 85)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_pages_of_odd_texts(documents):
    got = {(r.doc_id, r.page): (r.characters, r.lines, r.low_confidence) for r in text.document_pages(documents).select("doc_id", F.inline("quality")).collect()}
    assert got[2, 0] == (0, 1, False) and got[3, 0] == (2, 2, True) and got[6, 2] == (0, 6, False)
    assert sorted(p for d, p in got if d == 4) == [0, 1, 2, 3, 4] and not any(d == 1 for d, _ in got)
    unique = documents.where("doc_id <> 5")
    same = text.page_quality(lines(unique)).collect()
    assert {(r.doc_id, r.page): (r.characters, r.lines, r.low_confidence) for r in same} == {k: v for k, v in got.items() if k[0] != 5}
    assert sorted(map(tuple, text.extraction_quality(text.page_quality(lines(unique))).collect())) == sorted(map(tuple, text.document_quality(unique).collect()))


def test_repeated_rows_stay(documents):
    assert [r.markdown for r in text.to_markdown(documents).where("doc_id = 5").collect()] == ["one\n\ntwo"] * 2


def test_search_of_odd_texts(documents):
    got = [tuple(r) for r in text.search_capped(documents, "OTHER", 2).select("doc_id", "line", "total", "rank", "truncated").collect()]
    assert got == [(4, 0, 5, 1, True), (4, 45, 5, 2, True)]


def test_parts_by_text_and_size(documents):
    parts = {r.page: r.part for r in pages.split_by_text(documents, " other ").collect()}
    assert parts == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    rows = pages.split_by_size(documents.where("doc_id in (1, 2, 4)"), 20).orderBy("doc_id", "line").collect()
    assert [(r.doc_id, r.line, r.size, r.part, r.oversize) for r in rows[:4]] == [(2, 0, 0, 0, False), (4, 0, 12, 0, False), (4, 1, 6, 0, False), (4, 2, 6, 1, False)]


def test_strip_and_line_ends_of_any_white_space(spark):
    import random
    import re

    from docengine.functions import text as T

    spaces = re.compile(f"[{re.escape(T.SPACES)}]")
    assert all(bool(spaces.match(chr(c))) == bool(re.match(r"\s", chr(c))) for c in range(0x3001) if not 0x1C <= c <= 0x1F)
    rng = random.Random(5)
    texts = ["".join(rng.choice(T.SPACES + "\n\n\n  abé\u200b") for _ in range(rng.randrange(40))) for _ in range(400)] + ["a" + " " * 200_000 + "b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: "\n\n".join(x for x in (y.strip(T.SPACES) for y in t.split("\n")) if x) for i, t in enumerate(texts)}
    assert {r.doc_id: r.markdown for r in text.to_markdown(rows).collect()} == {i: m for i, m in want.items() if m}
