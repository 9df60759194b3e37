from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text) or (id, text, source); further columns clash with names in use."""

    def make(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clash:
            for c in ("id", "node", "hits", "spans", "size", "key", "copies", "range", "messages", "__id", "__text", "score"):
                df = df.selectExpr("*", f"'x' AS `{c}`")
        return df

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest test documents, as a table and as {id: text}."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
