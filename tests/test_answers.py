from __future__ import annotations

from types import SimpleNamespace

from evidentia.plans import extracting


def test_a_response_does_not_depend_on_the_order_of_its_claims(spark):
    names = "claim_id string, paper_version_id long, created_at timestamp, claim_type string, category string, statement string"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = [(f"c{i}", 1, None, "FACT", "result.main", f"statement {i}") for i in range(6)]
        links = spark.createDataFrame([(f"c{i}", f"e{i}", "SUPPORT") for i in range(6)], "claim_id string, evidence_id string, role string")
        made = []
        for order in (rows, rows[::-1]):
            claims = spark.createDataFrame(order, names).coalesce(1)
            made.append([r.content for r in extracting.answers(SimpleNamespace(claims=claims, claim_evidence=links)).collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made[0] == made[1]
    places = [made[0][0].index(f"statement {i}") for i in range(6)]
    assert places == sorted(places)
