"""The vector index against the full scan."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import search, vector_index
from evidentia.plans import catalog

DOCS = "document_id long, embedding array<double>"


def frame(spark, vectors, odd=()):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *odd], DOCS).repartition(4)


def asked(docs, every=50):
    return docs.where(f"document_id % {every} = 0").select(F.col("document_id").alias("query_id"), F.col("embedding").alias("vector"))


def measured(index, docs, queries):
    exact = search.semantic(docs, queries, 20)
    found = vector_index.search(index, queries, 20)
    total = vector_index.recall(found, exact).agg(F.sum("hits"), F.sum("wanted")).first()
    return total[0] / total[1], found, exact


def test_recall_on_clusters_with_few_visits(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    vectors = centres[rng.integers(60, size=4000)] + 0.25 * rng.normal(size=(4000, 32))
    docs = frame(spark, vectors)
    model = vector_index.fit(docs, cells=64)
    assert model.visits < 0.1 * len(model.centroids)
    index = vector_index.build(docs, model)
    queries = asked(docs)
    recall, found, exact = measured(index, docs, queries)
    assert recall >= 0.9
    # Full vectors are fetched for two candidates per result; codes are read in the visited cells only.
    met = index.codes.join(vector_index.query_blocks(queries, model), "cell").select(F.sum(F.size("ids") * F.size("query_ids"))).first()[0]
    assert met <= 0.1 * docs.count() * queries.count()
    # What both find has one similarity; ranks are gapless and ordered as the full scan orders.
    both = found.join(exact.withColumnRenamed("similarity", "s"), ["query_id", "document_id"])
    assert both.where("abs(similarity - s) > 1e-6").isEmpty()
    rows = found.orderBy("query_id", "rank").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.query_id != b.query_id or (b.rank == a.rank + 1 and (-a.similarity, a.document_id) < (-b.similarity, b.document_id))


def test_recall_without_clusters_by_many_visits(spark):
    vectors = np.random.default_rng(2).normal(size=(3000, 24))
    docs = frame(spark, vectors)
    index = vector_index.build(docs, vector_index.fit(docs, cells=32, sample_rows=1000))
    recall, *_ = measured(index, docs, asked(docs))
    assert recall >= 0.9


def test_a_third_of_all_rows_in_one_cell(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "CODE_BLOCK", 64)
    rng = np.random.default_rng(3)
    vectors = np.concatenate([np.tile(rng.normal(size=8), (700, 1)), rng.normal(size=(1300, 8))])
    docs = frame(spark, vectors)
    index = vector_index.build(docs, vector_index.fit(docs, cells=16))
    assert index.codes.select(F.max(F.size("ids"))).first()[0] <= 64
    assert index.codes.select(F.sum(F.size("ids"))).first()[0] == 2000
    recall, *_ = measured(index, docs, asked(docs, 100))
    assert recall >= 0.9


def test_rows_without_direction_and_empty_tables(spark):
    rng = np.random.default_rng(4)
    docs = frame(spark, rng.normal(size=(50, 4)), [(900, None), (901, [0.0] * 4)])
    index = vector_index.build(docs, vector_index.fit(docs))
    assert index.vectors.count() == 50
    queries = spark.createDataFrame([(1, None), (2, [0.0] * 4), (3, [1.0, 0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    got = vector_index.search(index, queries).collect()
    assert {r.query_id for r in got} == {3} and len(got) == 50
    none = docs.limit(0)
    empty = vector_index.build(none, vector_index.fit(none))
    assert vector_index.search(empty, queries).count() == 0
    assert vector_index.search(index, queries.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [1, 3])
def test_very_few_rows(spark, rows):
    docs = frame(spark, np.eye(rows, 4))
    index = vector_index.build(docs, vector_index.fit(docs))
    assert vector_index.search(index, asked(docs, 1)).where("rank = 1 AND query_id = document_id").count() == rows


def test_first_of_equal_vectors_as_the_sql_says(spark, tmp_path):
    """Copies of a query's vector under smaller ids come before the query itself."""
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    top = source.agg({"vec_id": "max"}).first()[0] + 1
    copies = source.withColumn("vec_id", source.vec_id + top)
    source.unionByName(copies).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["q5_semantic_index"]).fetchall())
    got = sorted(tuple(r) for r in catalog.queries()["q5_semantic_index"](spark, str(tmp_path)).collect())
    assert got == want
    assert any(query != document for query, document, *_ in got)
