from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
     T.StructField("n_chars", T.LongType()), T.StructField("name", T.StringType()), T.StructField("size", T.StringType())]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text, source) rows, with extra columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None, "clash", "clash") for i, t, s in rows], DOCS)

    return make


LONG = " ".join(f"w{i % 977}x{i}" for i in range(4_000))


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    return make_docs(
        [
            (1, "The quick brown fox jumps over the lazy dog", "a"), (2, "The quick  brown fox\njumps over the lazy dog", "a"), (3, None, "a"), (4, "", None), (5, " \n\t", "b"),
            (6, LONG, "b"), (7, LONG + " ", "b"), (8, "one", None), (8, "one", None), (None, "one", "c"), (9, "ONE", "c"), (10, "\x1f日本語 \U0001f600 ▁ ", "c"), (None, None, None),
        ]
    )
