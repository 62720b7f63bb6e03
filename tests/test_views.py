"""Graph, tags, search, library, operations and streams on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidentia.operators import corpus, graph, library, ops, search
from evidentia.operators import tags as T
from evidentia.plans import catalog
from evidentia.session import shared_folder
from evidentia.streaming import jobs

RELATION = "relation_id string, source_entity_id string, relation_type string, target_entity_id string, paper_id string, confidence double"


@pytest.fixture(scope="module")
def relations(spark):
    rows = [("r1", "a", "X", "b", "p1", 0.1), ("r2", "b", "X", "c", "p1", 0.2), ("r3", "c", "Y", "d", "p2", 0.3), ("r4", "d", "X", "a", None, 0.4), ("r5", "d", "X", "e", "p3", 0.4)]
    return spark.createDataFrame(rows, RELATION)


@pytest.mark.parametrize(
    "depth,types,want",
    [
        (1, None, {"a": 0, "b": 1, "d": 1}),
        (2, None, {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}),
        (3, ["X"], {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}),
    ],
)
def test_neighbors(spark, relations, depth, types, want):
    seeds = spark.createDataFrame([("a",)], "entity_id string")
    nodes, edges = graph.neighbors(relations, seeds, depth, types)
    assert {r["entity_id"]: r["distance"] for r in nodes.collect()} == want
    assert {r["node"] for r in edges.collect()} == {k for k, d in want.items() if d < depth}


def test_relation_rules(spark):
    edges = spark.createDataFrame(
        [("x", "a", "X", "b", None, 0.1), ("x", "a", "X", "b", None, 0.5), ("x", "a", "X", "a", None, 0.1), ("x", "a", " ", "b", None, 0.1), ("x", "a", "X", "zz", None, 0.1)], RELATION
    )
    known = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    judged = graph.relation_problems(edges, known)
    assert sorted(r["refused"] or "" for r in judged.collect()) == ["", "", "empty_type", "self_relation", "unknown_entity"]
    merged = graph.add_relations(judged.where("refused IS NULL")).collect()
    assert [(r["confidence"], r["mentions"]) for r in merged] == [(0.5, 2)]


def test_entities_resolve_by_name_then_alias(spark):
    mentions = spark.createDataFrame([("METHOD", "ResNet 50"), ("METHOD", "RN-50"), ("METHOD", "New!"), ("METHOD", "??")], "entity_type string, name string")
    entities = spark.createDataFrame([("e1", "METHOD", "resnet 50")], "entity_id string, entity_type string, normalized_name string")
    aliases = spark.createDataFrame([("e1", "METHOD", "RN 50")], "entity_id string, entity_type string, alias string")
    got = {r["name"]: (r["entity_id"], r["created"], r["matched_alias"]) for r in graph.resolve_entities(mentions, entities, aliases).collect()}
    assert got["ResNet 50"] == ("e1", False, False) and got["RN-50"] == ("e1", False, True)
    assert got["New!"][1] and got["??"][0] is None


def test_triage(spark):
    papers = spark.createDataFrame([(p, "T1_SCAN") for p in "abcd"], "paper_id string, requested_tier string")
    members = spark.createDataFrame(
        [("k1", "a", True, None, 1), ("k1", "b", True, "T0_INDEX", 1), ("k2", "b", False, "T3_DEEP", 2), ("k1", "c", False, None, 1)],
        "collection_id string, paper_id string, pinned boolean, priority_override_tier string, added_at int",
    )
    got = {r["paper_id"]: (r["effective_tier"], r["manual_override"], r["reason_codes"]) for r in T.triage(papers, members).collect()}
    assert got == {
        "a": ("T2_FULL", False, ["USER_PINNED", "PINNED_UPGRADE"]),
        "b": ("T3_DEEP", True, ["COLLECTION_PRIORITY_OVERRIDE", "USER_PINNED"]),
        "c": ("T1_SCAN", False, ["REQUESTED_TIER"]),
        "d": ("T1_SCAN", False, ["REQUESTED_TIER"]),
    }


def test_tag_rules(spark):
    tags = spark.createDataFrame([("t1", "method", "CNN", "cnn"), ("t2", "method", "ConvNet", "convnet"), ("t3", "task", "QA", "qa")], "tag_id string, namespace string, canonical_name string, normalized_name string")
    aliases = spark.createDataFrame([("t1", "conv-net")], "tag_id string, normalized_alias string")
    moves = spark.createDataFrame([("t2", "t1"), ("t3", "t1"), ("t9", "t1")], "tag_id string, target_id string")
    conflicts = {r["tag_id"]: r["conflict"] for r in T.merge_conflicts(moves, tags).collect()}
    assert conflicts == {"t3": "namespace_conflict", "t9": "unknown_tag"}
    ok = moves.where("tag_id = 't2'")
    links = spark.createDataFrame([("p", "t1", True), ("p", "t2", True), ("q", "t2", False), ("r", "t1", True)], "paper_id string, tag_id string, is_candidate boolean")
    got = {(r["paper_id"], r["tag_id"], r["is_candidate"]) for r in T.merge_paper_tags(links, ok).collect()}
    assert got == {("p", "t1", False), ("q", "t1", False), ("r", "t1", True)}
    assert {(r["tag_id"], r["normalized_alias"]) for r in T.merge_aliases(aliases, tags, ok).collect()} == {("t1", "conv-net"), ("t1", "convnet")}
    wanted = spark.createDataFrame([("t2", "Conv Net")], "tag_id string, alias string")
    assert T.alias_conflicts(wanted, aliases).count() == 1


DOC = "document_id string, document_type string, paper_id string, content string, index_text string, embedding array<double>"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("d1", "EVIDENCE", "p1", "sparse attention kernel", "sparse attention kernel", [1.0, 0.0]),
        ("d2", "EVIDENCE", "p2", "dense attention", "dense attention", [0.0, 1.0]),
        ("d3", "CLAIM", "p1", "sparse sparse attention", "sparse sparse attention", None),
        ("d4", "PAPER", "p3", "unrelated", "unrelated", [0.6, 0.8]),
    ]
    return spark.createDataFrame(rows, DOC)


def test_hybrid_search(spark, docs):
    queries = spark.createDataFrame([("q", "sparse attention", [1.0, 0.0])], "query_id string, query string, vector array<double>")
    rows = search.hybrid_search(docs, queries, 4).orderBy("position").collect()
    assert [r["document_id"] for r in rows] == ["d1", "d3", "d4", "d2"]
    assert rows[0]["channels"] == ["filters", "fts", "semantic"] and rows[0]["scope_size"] == 4
    plain = search.hybrid_search(docs, queries.drop("vector"), 4).orderBy("position").collect()
    assert plain[-1]["score"] == 0.0 and plain[0]["warning"]
    with pytest.raises(ValueError):
        search.hybrid_search(docs, queries, 201)


def test_scope_never_widens(spark, docs, relations):
    entities = spark.createDataFrame([("a", "METHOD")], "entity_id string, entity_type string")
    none = search.Filters(entity_ids=["zz"])
    assert search.search_scope(docs, none, relations=relations, entities=entities).count() == 0
    assert search.search_scope(docs, search.Filters(paper_ids=[])).count() == 0
    hit = search.Filters(entity_types=["METHOD"], document_types=["CLAIM", "EVIDENCE"])
    got = search.search_scope(docs, hit, relations=relations, entities=entities)
    assert {r["document_id"] for r in got.collect()} == {"d1", "d3"}


def test_hash_vectors(spark):
    rows = spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", "one two two")], "document_id string, content string")
    got = {r["document_id"]: r["embedding"] for r in search.hash_embed(rows).collect()}
    assert got["a"] == got["c"] and got["b"] == [1.0] + [0.0] * 63
    assert abs(sum(v * v for v in got["a"]) - 1) < 1e-9


def test_library_scope_unread(spark):
    papers = spark.createDataFrame([(p, f"Title {p}", f"title {p}") for p in "abc"], "paper_id string, canonical_title string, normalized_title string")
    personal = spark.createDataFrame([("a", "READ"), ("b", "UNREAD")], "paper_id string, read_state string")
    got = library.library_scope(papers, read_states=(personal, ["UNREAD"]))
    assert {r["paper_id"] for r in got.collect()} == {"b", "c"}
    odd = papers.withColumn("canonical_title", F.concat("canonical_title", F.lit(" 100%_x")))
    assert library.library_scope(odd, "100%_X").count() == 3 and library.library_scope(odd, "100x").count() == 0


def test_compare_versions(spark):
    claims = spark.sql(
        "select * from values ('v1', 1, 'c1', 's1', 'method.a', 'k'), ('v2', 1, 'c2', 's2', 'method.b', 'k'), ('v1', 1, 'c3', 's3', 'result.a', 'k'),"
        " ('v2', 1, 'c4', 's4', 'result.a', 'j') as t(paper_version_id, created_at, claim_id, statement, category, protocol_key)"
    )
    chosen = spark.createDataFrame([("x", "v1"), ("x", "v2"), ("alone", "v1")], "comparison_id string, paper_version_id string")
    got = {(r["paper_version_id"], r["dimension"]): (r["comparable"], r["reason"]) for r in library.compare_versions(claims, chosen).collect()}
    # A comparison of one version is refused, in a row of its own.
    assert got.pop(("v1", None)) == (False, "refused: a comparison has 2 to 4 versions")
    assert len(got) == 14 and got[("v1", "method")] == (True, None)
    assert got[("v1", "evidence")] == (False, "different protocols") and got[("v1", "problem")] == (False, "NOT_EXTRACTED")


def test_eta_rules(spark):
    done = [(f"j{i}", f"d{i}", "t", "SUCCEEDED", f"2024-01-01 00:00:{i:02d}", f"2024-01-01 00:01:{i:02d}") for i in range(6)]
    rows = done + [
        ("j", "o1", "t", "QUEUED", None, None), ("j", "o2", "t", "RUNNING", "2024-01-02 00:00:00", None),
        ("k", "o3", "rare", "QUEUED", None, None), ("b", "o4", "t", "BLOCKED", None, None),
    ]
    df = spark.createDataFrame(rows, "job_id string, task_id string, task_type string, state string, started_at string, finished_at string")
    df = df.withColumn("started_at", F.col("started_at").cast("timestamp")).withColumn("finished_at", F.col("finished_at").cast("timestamp"))
    got = {r["job_id"]: (r["eta_p50"], r["eta_p90"]) for r in ops.eta(df, "2024-01-02 00:00:10").collect()}
    assert got["j"] == (110.0, 110.0) and got["k"] == got["b"] == (None, None) and got["j1"] == (0.0, 0.0)


def test_retry_delays(spark):
    df = spark.createDataFrame([(a, 20) for a in (1, 2, 9, 10, 20)], "attempt int, max_attempts int")
    got = [(r["next_state"], r["delay_seconds"]) for r in ops.retry_backlog(df).orderBy("attempt").collect()]
    assert got == [("QUEUED", 1), ("QUEUED", 2), ("QUEUED", 256), ("QUEUED", 300), ("FAILED", None)]


def test_task_steps_stream_matches_a_plain_loop(spark, tmp_path):
    rows = [("a", f"e{i}", i, s) for i, s in enumerate(["PENDING", "QUEUED", "SUCCEEDED", "RUNNING", "RETRYING", "QUEUED", "RUNNING", "SUCCEEDED", "QUEUED"])]
    schema = "task_id string, event_id string, occurred int, state string"
    for part in (rows[:4], rows[4:]):  # two batches, so state must survive
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["event_id"]: (r["legal"], r["retries"]) for r in jobs.run_to_end(jobs.task_steps(stream), str(tmp_path)).collect()}
    assert [k for k, v in sorted(got.items()) if not v[0]] == ["e2", "e8"]
    assert got["e7"] == (True, 1)


def test_ingest_is_idempotent(spark, folder):
    base = shared_folder(spark)
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    for run in ("one", "two"):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(folder)
        jobs.ingest(stream, f"{base}/evidence", f"{base}/checkpoint-{run}").awaitTermination()
    stored = spark.read.parquet(f"{base}/evidence")
    assert stored.count() == stored.select("evidence_id").distinct().count() > 0


def test_worker_freshness(spark):
    beats = spark.createDataFrame([("a", 100.0), ("a", 150.0), ("b", 10.0), ("c", float("nan")), ("d", -99999.0)], "identity string, last_seen double")
    got = {r["identity"]: r["state"] for r in jobs.worker_freshness(jobs.last_beats(beats), 200.0).collect()}
    assert got == {"a": "FRESH", "b": "STALE"}


def test_empty_scope_gives_no_findings(spark, folder):
    from evidentia.plans.inputs import Tables

    t = Tables(spark, folder)
    nobody = corpus.collection_scope(t.collection_papers, -1)
    views = corpus.all_views(
        t.claims, t.tags, t.paper_tags, t.relations, t.entities,
        t.paper_versions.withColumn("publication_date", F.lit(None).cast("timestamp")).withColumn("created_at", F.current_timestamp()),
        nobody,
    )
    assert all(r["findings"] == 0 for r in corpus.run_log(views, "nobody").collect())


def test_catalog_is_consistent():
    queries, oracle = catalog.queries(), catalog.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150
