"""Tables of awkward rows for the tests of the training-data operators."""

from pyspark.sql import types as T
import pytest

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("key", T.StringType()), T.StructField("n", T.StringType()), T.StructField("score", T.StringType()),
])


def rows_of(texts, source="s"):
    return [(i, t, "en", source, len(t or ""), "k", "n", "x") for i, t in enumerate(texts)]

# null, empty, white space only, one word, a very long text, and repeated texts
ODD = [None, "", " \t\n", "word", "long word, " * 20_000, "the same text twice here", "the same text twice here", "Grüße, Ünïcödé \U0001f600   x"]


@pytest.fixture
def docs(spark):
    def make(texts, rows=None):
        return spark.createDataFrame(rows if rows is not None else rows_of(texts), DOCS)

    return make
