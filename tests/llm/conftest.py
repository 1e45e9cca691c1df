import pytest

ODD = [None, "", " \t\n ", "word", "ä🙂\x00 ▁ ß\n\n", "a a a a " * 30, "long " + "the quick brown fox jumps over it and 12 lazy dogs " * 60]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, repeats, ties and columns whose names clash with those the operators make."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", 1, "x") for i, t in enumerate([*ODD, *ODD])]
    rows += [rows[6], (None, "the end", "en", "s", 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, id string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def few(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
