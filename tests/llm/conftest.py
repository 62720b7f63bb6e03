from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), in several partitions, with clashing extra columns."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENT)
        for name in ("length", "start", "score", "n_words", "fp", "row", "spans", "run", "host", "rank", "component_id"):
            frame = frame.selectExpr("*", f"'x' AS `{name}`")
        return frame.repartition(3) if rows else frame

    return build


@pytest.fixture(scope="session")
def some_documents(spark, folder):
    """All given documents of the smallest size, on the driver."""
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
