import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs(spark):
    """Builds documents from texts or (doc_id, text) pairs."""

    def make(*rows):
        full = [(r if isinstance(r, tuple) else (i, r)) for i, r in enumerate(rows)]
        return spark.createDataFrame([(d, t, "en", "s", len(t) if t is not None else None) for d, t in full], DOCS)

    return make


ODD_TEXTS = [None, "", " ", "\n\n", "a", "word", "a  b\t c\n d", "é字\U0001f600 ﬀ", "x" * 30_000, "the cat sat " * 3000, "same text here", "same text here"]
