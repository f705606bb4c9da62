import pytest

ODD = [
    (1, "one two three four five six seven", "en", "a", 33),
    (1, "one two three four five six seven", "en", "a", 33),
    (1, "another text under the same id, with other words in it", "en", "b", 54),
    (2, "", "en", None, 0),
    (3, None, None, None, None),
    (None, "a row without any id at all here", "en", "a", 32),
    (4, "word " * 30000, "en", "b", 150000),
    (5, "One Two three four\tfive six\nseven", "en", "c", 33),
    (6, "é" * 5000, "fr", "c", 5000),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, a very long text, ties, repeated rows and columns of clashing names."""
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], DOCS + ", h string, n int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest test tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
