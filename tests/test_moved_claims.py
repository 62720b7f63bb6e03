"""What the claim checks move between tasks for each claim, and that sifting loses no pair."""

from __future__ import annotations

import random

import pytest
from test_moved import moved

from evidentia.operators import corpus, overlap, verify


@pytest.fixture
def shuffled(spark):
    """No table is small enough to be sent to all tasks, as with large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    ("name", "limit"), [("v5_contradiction", 200), ("v6_consensus", 200), ("v7_falsification", 200), ("v11_verify_deep_tier", 600)]
)
def test_a_claim_that_meets_none_moves_hashes_only(shuffled, name, limit):
    assert moved(shuffled, name) < limit * 60_000


@pytest.mark.parametrize(("name", "limit"), [("v2_citation", 230), ("v3_numeric", 230), ("v13_transitions", 300)])
def test_texts_and_statements_move_once(shuffled, name, limit):
    assert moved(shuffled, name) < limit * 60_000


def subjects(spark):
    rng = random.Random(3)
    rows = {(rng.randrange(4), " ".join(sorted(rng.sample([f"word{chr(97 + k)}" for k in range(14)], rng.randint(1, 7))))) for _ in range(60)}
    rows |= {(v, f"alone{v}x{i} lonely{v}x{i} words") for v in range(4) for i in range(20)}
    return spark.createDataFrame(sorted(rows), "v int, subject string"), rows


@pytest.mark.parametrize("sent", [0, overlap.SENT_HASHES])
def test_sifting_loses_no_pair_and_keeps_no_lonely_subject(spark, monkeypatch, sent):
    monkeypatch.setattr(overlap, "SENT_HASHES", sent)
    df, rows = subjects(spark)
    met = lambda a, b: len({*a.split()} & {*b.split()}) >= max(2, len(a.split()) // 2)
    want = {(v, a, b) for v, a in rows for w, b in rows if v == w and met(a, b)}
    got = {(r["v"], r["subject"], r["other"]) for r in overlap.overlap_edges(df, ["v"], sift=True).collect()}
    assert got == want
    kept = {(r["v"], r["subject"]) for r in overlap.sharing(df, ["v"], ["v", "subject"]).collect()}
    assert {x for v, a, b in want if a != b for x in ((v, a), (v, b))} <= kept
    assert not any(s.startswith("alone") for _, s in kept)


def test_one_claim_presses_on_itself_without_any_other(spark):
    claims = spark.createDataFrame(
        [("a", "CRITIQUE", "Method alpha fails"), ("b", "CRITIQUE", "Kernel only"), ("c", "CRITIQUE", "is 12"), ("d", "FACT", "other words here")],
        "claim_id string, claim_type string, statement string",
    ).selectExpr("*", "claim_id AS paper_version_id", "'r' AS run_id", "timestamp'2024-01-01' AS created_at")
    links = spark.createDataFrame(
        [("a", "e", "COUNTER_EVIDENCE"), ("a", "f", "COUNTER_EVIDENCE"), ("b", "e", "SUPPORT"), ("c", "e", "COUNTER_EVIDENCE"), ("d", "e", "COUNTER_EVIDENCE")],
        "claim_id string, evidence_id string, role string",
    )
    got = sorted((r["claim_id"], r["details"].get("critique_claim_id")) for r in verify.falsification(verify.prepare(claims), links).collect())
    assert got == [("a", "a"), ("b", None), ("c", None), ("d", None)]


@pytest.mark.parametrize("sent", [0, 10])
def test_repeated_statements_of_a_paper_meet_and_the_others_stay(spark, monkeypatch, sent):
    monkeypatch.setattr(overlap, "SENT_HASHES", sent)
    rows = [("a", "p", 2, "Alpha  reaches 1"), ("b", "p", 1, "alpha reaches 1 "), ("c", "q", 1, "alpha reaches 1"), ("d", "p", 1, None), ("e", "p", 3, None), ("f", None, 1, "x"), ("g", None, 0, "X")]
    claims = spark.createDataFrame(rows, "claim_id string, paper_id string, created_at int, statement string")
    assert sorted(r["claim_id"] for r in corpus.distinct_statements(claims).collect()) == ["b", "c", "d", "g"]


@pytest.mark.parametrize("name", ["c5_numeric_disagreements", "c5_contradiction_map"])
def test_a_statement_that_occurs_once_does_not_move_to_find_its_like(shuffled, name):
    assert moved(shuffled, name) < 360 * 60_000


def test_claims_that_share_an_id_stay_apart(spark):
    claims = spark.createDataFrame([("a", "alpha 1"), ("a", "alpha 2")], "claim_id string, statement string")
    links = spark.createDataFrame([("a", "e")], "claim_id string, evidence_id string")
    evidence = spark.createDataFrame([("e", "alpha 2")], "evidence_id string, text string").selectExpr(
        "*", "'OCR' AS source_method", "cast(NULL AS double) AS ocr_confidence", "'RESULT' AS section_class"
    )
    facts = verify.with_facts(verify.prepare(claims), links, evidence).collect()
    assert sorted((r["statement"], r["links"], r["absent"]) for r in facts) == [("alpha 1", 1, ["1"]), ("alpha 2", 1, [])]
