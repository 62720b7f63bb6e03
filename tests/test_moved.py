"""What queries move between tasks, per input row, where it decides whether a large table fits."""

from __future__ import annotations

import random

import pytest

from evidentia import tables
from evidentia.operators import corpus, graph, overlap, postings_index, search
from evidentia.plans import catalog

FOLDER = "/root/testdata/sf0.01"  # 60,000 rows of lineitem


def moved(spark, name):
    """Bytes of shuffles written by a query, its own writing of results aside."""
    store = spark._jsparkSession.sparkContext().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        rows = store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList()).iterator()
        out = {}
        while rows.hasNext():
            stage = rows.next()
            out[stage.stageId(), stage.attemptId()] = stage.shuffleWriteBytes()
        return out

    before = stages()
    catalog.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return sum(b for key, b in stages().items() if key not in before)


@pytest.mark.parametrize(("name", "limit"), [("v5_contradiction", 650), ("c5_numeric_disagreements", 650), ("q8_search_claims", 200)])
def test_a_claim_moves_few_bytes(spark, name, limit):
    assert moved(spark, name) < limit * 60_000


def test_many_asked_words_give_the_same_ranks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a a c"), (3, "b"), (4, ""), (5, "a b")], "document_id long, index_text string")
    asked = spark.createDataFrame([("x", "a b"), ("y", "a"), ("z", "a nowhere"), ("w", "")], "query_id string, query string")
    few = sorted(tuple(r) for r in search.fts(docs, asked).collect())
    monkeypatch.setattr(search, "FEW_WORDS", 0)
    assert sorted(tuple(r) for r in search.fts(docs, asked).collect()) == few
    assert [r[:2] for r in few] == [("x", 1), ("x", 5), ("y", 1), ("y", 2), ("y", 5)]


@pytest.mark.parametrize("name", ["q4_index_top", "q4_index_matches", "q3_index_words"])
def test_an_index_moves_words_once(spark, name):
    # The texts have 2.4 million characters.
    assert moved(spark, name) < 9_000_000


def test_many_asked_words_find_the_same_in_an_index(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a a c"), (3, "b"), (4, ""), (5, "a b")], "document_id long, index_text string")
    asked = spark.createDataFrame([("x", "a b"), ("y", "a"), ("z", "a nowhere"), ("w", "")], "query_id string, query string")
    want = sorted(tuple(r) for r in search.fts(docs, asked).collect())
    index = postings_index.build(docs, buckets=2, shard_size=2)
    monkeypatch.setattr(search, "FEW_WORDS", 0)
    assert sorted(tuple(r) for r in postings_index.matches(index, asked).collect()) == want


@pytest.mark.parametrize("name", ["st6_chain_projection", "st6_chain_evidence"])
def test_a_chain_of_sinks_moves_texts_twice(spark, name):
    # Once to drop equal texts, once to their lines; the last batch, sent again, moves keys alone.
    assert moved(spark, name) < 5_000_000


def test_a_relation_meets_its_entities_once_each(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moved(spark, "g9_entity_cards") < 12_500_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cards_of_unknown_and_repeated_entities(spark):
    entities = spark.createDataFrame([("a", "A"), ("b", None), ("c", "C1"), ("c", "C2")], "entity_id string, canonical_name string")
    rows = [("1", "a", "b"), ("2", "a", "gone"), ("3", "gone", "c"), ("4", "a", "c"), ("5", None, "a"), ("6", "a", "a"), ("7", "gone", "lost")]
    relations = spark.createDataFrame(rows, "relation_id string, source_entity_id string, target_entity_id string").selectExpr("*", "'T' AS relation_type", "1 AS paper_id")
    got = sorted(tuple(r) for r in graph.entity_cards(relations, entities).select("relation_id", "entity_id", "direction", "other_id", "other_name").na.fill("-").collect())
    assert got == sorted([
        ("1", "a", "OUT", "b", "-"), ("1", "b", "IN", "a", "A"), ("2", "a", "OUT", "gone", "-"), ("3", "c", "IN", "gone", "-"),
        ("4", "a", "OUT", "c", "C1"), ("4", "a", "OUT", "c", "C2"), ("4", "c", "IN", "a", "A"), ("5", "a", "IN", "-", "-"),
        ("6", "a", "OUT", "a", "A"), ("6", "a", "IN", "a", "A"),
    ])


def test_rivals_by_pairs_of_tokens_are_those_of_all_edges(spark, monkeypatch):
    rng = random.Random(5)
    usual = list(tables.GENERIC_CLAIM_TOKENS)[:3]
    rows = []
    for i in range(150):
        words = rng.sample([f"sample{chr(97 + k)}" for k in range(24)] + usual, rng.choice([1, 2, 3, 4, 5, 6, 9, 13, 16]))
        rows.append((f"c{i:03d}", rng.randrange(12), f"2024-01-{1 + i % 9:02d}", "SUPPORTED", " ".join(words) + f" reached {10 + rng.randrange(4)}.5 percent"))
    claims = spark.createDataFrame(rows, "claim_id string, paper_id int, created_at string, support_state string, statement string")
    got = sorted(tuple(r) for r in corpus.numeric_disagreements(claims).collect())
    edges, met = overlap.overlap_edges, overlap.met_by
    monkeypatch.setattr(overlap, "overlap_edges", lambda subjects, small: edges(subjects))
    monkeypatch.setattr(overlap, "met_by", lambda *given: met(*given[:5]))
    assert len(got) > 50 and got == sorted(tuple(r) for r in corpus.numeric_disagreements(claims).collect())


def test_subjects_that_share_two_tokens_are_not_listed_in_pairs(spark):
    subjects = spark.createDataFrame([(f"a b t{i}",) for i in range(300)], "subject string")
    assert overlap.overlap_edges(subjects, small=False).count() == 0
