from docengine.functions import text as T


def test_composed_accents_fold(spark):
    rows = [("ÉCOLE ﬅ", "ecole ft"), ("été", "ete"), ("co­op ½ ①", "coop 1⁄2 1"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "text string, want string")
    assert [r.got for r in df.select(T.fold_for_search(df.text).alias("got")).collect()] == [w for _, w in rows]
