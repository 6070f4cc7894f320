import base64
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docengine.functions import filters as X
from docengine.functions import geometry as G
from docengine.functions import text as T
from docengine.operators import blocks, graph, pages, ranges, sweep
from docengine.sources import cos, tables
from docengine.streaming import transfers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_filters_round_trip():
    rng = random.Random(0)
    for n in (0, 1, 100, 5000, 70000):
        data = bytes(rng.choice(b"abcab ") if n % 2 else rng.randrange(256) for _ in range(n))
        assert X.lzw_decode(X.lzw_encode(data)) == data
        assert X.flate_decode(zlib.compress(data)) == data
        assert X.ascii85_decode(base64.a85encode(data) + b"~>") == data
        assert X.hex_decode(data.hex().encode() + b">") == data
    assert X.run_length_decode(bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128]) + b"no") == b"abcxxx"
    assert X.decode_chain(["ASCIIHexDecode", "FlateDecode"], zlib.compress(b"hi").hex().encode()) == b"hi"
    with pytest.raises(X.FilterError):
        X.flate_decode(zlib.compress(b"a" * 1000), limit=10)


def test_filter_errors_stay_in_their_row(spark):
    rows = spark.createDataFrame([(bytearray(zlib.compress(b"ok")),), (bytearray(b"bad"),), (None,)], "b binary")
    got = rows.select(X.decode_column(F.col("b"), "FlateDecode").alias("d")).collect()
    assert [bytes(r.d.data) if r.d.data is not None else None for r in got] == [b"ok", None, None] and got[1].d.error


def test_text(spark):
    r = one(spark, a=T.similarity(F.lit("abc"), F.lit("abd")), b=T.similarity(F.lit(""), F.lit("")), c=T.normalize_for_compare(F.lit("a-\r\nb  ﬁ­x")), d=T.fold_for_search(F.lit("ÉCOLE ﬅ")), e=T.csv_field(F.lit('a"b')), f=T.is_rule(F.lit("- - -")), g=T.heading_level(F.lit("Title"), F.lit(14.0), F.lit(10.0)), h=T.match_count(F.lit("aAaA"), "aa"))
    assert (r.a, r.b, r.c, r.e, r.f, r.g, r.h) == (0.6667, 1.0, "ab fix", '"a""b"', True, 1, 2)
    assert r.d == "ecole ft"
    hyphens = ["well-\nknown", "- \nx", "a -\nb", "a-\n b", "1-\n2", "a-\nb-\nc", "\u00a0x\u2003\u2003y\u3000", "so\u00adft"]
    got = spark.createDataFrame([(x,) for x in hyphens], "x string").select(T.normalize_for_compare(F.col("x")).alias("n")).collect()
    assert [x.n for x in got] == ["wellknown", "- x", "a - b", "a- b", "12", "abc", "x y", "soft"]
    quoted = spark.createDataFrame([(x,) for x in ("\tx", "x\u00a0", "x y", None)], "x string").select(T.csv_field(F.col("x")).alias("c")).collect()
    assert [x.c for x in quoted] == ['"\tx"', '"x\u00a0"', "x y", ""]
    texts = ['a,b\r\n\n"x, ""y""",z\n', 'a"b"c,"d', '"a"b""c,,', "", " \t\n", 'é"",x']
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(T.parse_csv(F.col("x")).alias("c")).collect()
    assert [x.c for x in got] == [[["a", "b"], ['x, "y"', "z"]], [["abc", "d"]], [["abc", "", ""]], [], [], [["é", "x"]]]
    got = spark.createDataFrame([(n,) for n in (1, 4, 26, 27, 52, 702, 703, 1994, 3999, 4000, 475255, 2**63 - 1, 0)], "n long").select("n", T.roman(F.col("n")).alias("r"), T.alphabetic(F.col("n")).alias("a")).collect()
    assert [x.r for x in got] == ["I", "IV", "XXVI", "XXVII", "LII", "DCCII", "DCCIII", "MCMXCIV", "MMMCMXCIX", None, None, None, None]
    assert [x.a for x in got][:7] == ["A", "D", "Z", "AA", "AZ", "ZZ", "AAA"] and got[-1].a is None
    assert got[10].a == "AAAAA" and sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(got[11].a))) == 2**63 - 1


def test_geometry(spark):
    m = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("abcdef", (2, 1, 0, 3, 5, 7), strict=True)])
    r = one(spark, i=G.then(m, G.invert(m)), s=G.invert(F.struct(*[F.lit(0.0).alias(k) for k in "abcdef"])), q=G.quarter_turns(F.lit(-90)), d=G.blend("dodge", F.lit(0.5), F.lit(1.0)))
    assert [round(x, 9) for x in r.i] == [1, 0, 0, 1, 0, 0] and r.s is None and r.q == 270 and r.d == 1.0


def test_pages(spark):
    specs = ["3, 1-2,2", "4-2", "x", "1,6", "0", " ", None, ",,", "2-", " 2 - 4 ,"]
    got = [r.s for r in spark.createDataFrame([(x,) for x in specs], "x string").select(pages.parse_selection(F.col("x"), F.lit(5).cast("long")).alias("s")).collect()]
    assert [r.pages for r in got] == [[3, 1, 2], None, None, None, None, [1, 2, 3, 4, 5], [1, 2, 3, 4, 5], None, None, [2, 3, 4]]
    assert [r.error for r in got[1:5]] == ['page range "4-2" runs backwards', '"x" is not a page number', "page 6 is outside this document (1-5)", "page 0 is outside this document (1-5)"]
    assert [r.error for r in got[5:]] == [None, None, "no pages selected", '"" is not a page number', None]
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("a", 3)], "name string, seq int")
    assert [x.unique_name for x in pages.unique_names(rows, [], "name", ["seq"]).orderBy("seq").collect()] == ["a", "b", "a-2", "a-3"]


def test_ranges(spark):
    a = spark.createDataFrame([("s", 0, 5), ("s", 5, 8), ("s", 20, 10), ("s", 30, 30), ("t", 1, 2)], "set_id string, start long, end long")
    b = spark.createDataFrame([("s", 2, 3), ("s", 7, 12)], "set_id string, start long, end long")
    rows = lambda df: sorted(tuple(r) for r in df.select("set_id", "start", "end").collect())
    assert rows(ranges.merged(a)) == [("s", 0, 8), ("t", 1, 2)]
    assert rows(ranges.difference(a, b)) == [("s", 0, 2), ("s", 3, 7), ("t", 1, 2)]
    assert rows(ranges.intersection(a, b)) == [("s", 2, 3), ("s", 7, 8)]


def test_graph_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert sorted(r.node for r in graph.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()) == [1, 2, 3]
    rows = spark.createDataFrame([(1, None, 0, "r"), (2, 1, 0, "a"), (3, 2, 1, "b"), (8, 9, 0, "loop"), (9, 8, 0, "loop")], "id long, parent long, ord int, title string")
    assert sorted((r.id, r.depth) for r in graph.tree(rows).collect()) == [(1, 0), (2, 1), (3, 2)]
    chain = spark.createDataFrame([(i, i - 1 if i else None, 0, "x") for i in range(40)], "id long, parent long, ord int, title string")
    assert graph.tree(chain).count() == 40
    with pytest.raises(ValueError, match="deeper than 32"):
        graph.tree(chain, 32)


def test_blocks():
    html = "<h2>A &amp; B</h2><script>var x='</p>';</script><p>one<br>two</p><ul><li>x</li></ul><pre>\n a\n  b</pre><table><tr><td>1</td><td>2</td></tr></table>"
    assert blocks.html_blocks(html) == [("heading", 2, "A & B"), ("paragraph", 0, "one"), ("paragraph", 0, "two"), ("list_item", 0, "x"), ("code", 0, " a\n  b"), ("table_row", 0, "1 | 2")]
    md = "# T\n\npara\nmore\n\n- a\n  - b\n\n***\n> q\n```\ncode\n```\n| a | b\\|c |\n|---|---|\n"
    assert blocks.markdown_blocks(md) == [("heading", 1, "T"), ("paragraph", 0, "para more"), ("list_item", 0, "a"), ("list_item", 1, "b"), ("rule", 0, ""), ("quote", 0, "q"), ("code", 0, "code"), ("table_row", 0, "a | b|c")]


PDF = b"""%PDF-1.7
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents 9 0 R >> endobj
%%EOF
3 0 obj << /Type /Page /Parent 2 0 R >> endobj
%%EOF
"""


def test_objects(spark):
    found = cos.objects(tables.memory_files(spark, {"a.pdf": PDF, "b.pdf": b"nothing"})).cache()
    assert found.where("error is not null").count() == 1
    assert [(r.num, r.rev) for r in cos.at_revision(found).orderBy("num").collect()] == [(1, 0), (2, 0), (3, 1)]
    old = cos.at_revision(found, 0)
    assert [r.dst for r in graph.dangling(cos.references(old), old, "dst", "num").collect()] == [9]


def test_sweep(spark):
    r = one(spark, a=sweep.classify(F.lit(None), F.lit("x"), F.lit(None)), b=sweep.classify(F.lit("x"), F.lit("x"), F.lit(1.0)))
    assert (r.a, r.b) == ("ours-rejects", "match")
    sides = [("x", "x", 0.99), ("x", "x", 0.98), ("x", "x", 0.949), ("x", "x", 0.74), ("", "", 1.0), ("", "x", 0.0), ("x", "", 0.0), ("x", None, None), (None, None, None)]
    got = spark.createDataFrame(sides, "a string, b string, sim double").select(sweep.classify(F.col("a"), F.col("b"), F.col("sim")).alias("o"), sweep.classify(F.col("a"), F.col("b"), F.col("sim"), F.lit(True), F.lit(True)).alias("late")).collect()
    assert [x.o for x in got] == ["match", "diff<5", "diff<25", "diff>=25", "empty-both", "empty-ours", "empty-theirs", "theirs-rejects", "both-reject"] and got[7].late == "theirs-timeout"


def test_transfers(spark, tmp_path):
    assert transfers.insert([(0, 4), (8, 10)], 4, 8) == [(0, 10)]
    schema = "transfer long, start long, length long, size long, status int"
    chunks = [(1, 4, 4, 10, 206), (1, 0, 4, 10, 206), (1, 0, 4, 10, 206), (1, 8, 2, 10, 206), (2, 0, 5, 10, 500), (2, 5, 9, 10, 206)]
    for n, part in enumerate((chunks[:2], chunks[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = transfers.reassemble(stream).writeStream.outputMode("update").format("memory").queryName("progress").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {(r.transfer, r.received, r.next_start, r.complete, r.rejected) for r in spark.sql("select * from progress").collect()}
    assert (1, 10, 10, True, 0) in rows and any(r[0] == 2 and not r[3] and r[4] == 2 for r in rows)


def test_corrections_and_windows(spark, sf_dir):
    log = spark.createDataFrame([(1, "ok"), (2, "ok")], "seq long, outcome string")
    late = spark.createDataFrame([(2, "undone", 1), (2, "redone", 2)], "seq long, outcome string, version int")
    assert sorted((r.seq, r.outcome) for r in transfers.corrected(log, late).collect()) == [(1, "ok"), (2, "redone")]
    events = tables.table(spark, sf_dir, "events")
    assert transfers.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()
