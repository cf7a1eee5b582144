import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) rows."""

    def of(rows):
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOCS)

    return of


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the small given table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]


PROSE = "The quick brown fox, it jumps over the lazy dog. Pack my box with five dozen jugs; Ünïcode größer naïve façade! "


@pytest.fixture(scope="session")
def odd(make):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, white space and control characters."""
    long = " ".join(f"word{i * 7919 % 5003}" for i in range(20_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b", "en", "a"), (4, PROSE * 3, "en", "a"), (4, PROSE * 3, "en", "a"),
        (5, PROSE * 3, "de", "b"), (6, long, "en", "a"), (7, "x" * 700, "de", None), (8, "one two", "fr", "b"), (9, "é ß \U0001f600 \x00 �", "fr", "b"),
        (None, "no id at all", "en", "a"), (None, None, None, None), (10, PROSE + long[:3000], "en", "b"), (4, "another text of the same id", "en", "a"),
    ]
    return make(rows)
