"""A search by entities reaches every paper, however many there are."""

from __future__ import annotations

from types import SimpleNamespace

from evidentia.operators import search as S
from evidentia.plans import searching


def test_relations_reach_papers_beyond_the_first_thousand(spark):
    one = spark.range(1)
    t = SimpleNamespace(
        supplier=spark.range(3000).selectExpr("id AS s_suppkey"),
        relations=spark.range(9000).selectExpr("id AS paper_id", "concat('paper_', id) AS source_entity_id", "'a' AS target_entity_id"),
        entities=one.selectExpr("'a' AS entity_id", "'AUTHOR' AS entity_type", "'A' AS canonical_name"),
        tags=one, paper_tags=one, collection_papers=one,
    )
    dims = searching.every_paper(t)
    near = S.entity_scope(dims["relations"], dims["entities"], S.Filters(entity_types=["AUTHOR"]))
    assert sorted(int(r["paper_id"]) for r in near.collect()) == list(range(3000))
