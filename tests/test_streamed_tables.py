from __future__ import annotations

from evidentia.plans import catalog


def test_a_streamed_table_may_be_a_folder_of_files(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    ingest = catalog.queries()["st6_ingest"]
    want = sorted(tuple(r) for r in ingest(spark, folder).collect())
    assert want and sorted(tuple(r) for r in ingest(spark, str(tmp_path)).collect()) == want
