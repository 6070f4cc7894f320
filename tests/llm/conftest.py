import pytest

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, label int, `count` long"
LONG = " ".join(f"word{i}" for i in range(30000))


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing column names."""
    texts = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, " \n\t "), (None, "only text"), (None, None), (5, LONG), (6, LONG), (7, "x\n\ny  z é日本\x1c!"), (7, "another text of the same id"), (8, "A B C D E F G")]
    rows = [(i, t, None if n % 3 else "en", None if n % 4 == 1 else f"s{n % 2}", None, n, "k", 1, 2) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
