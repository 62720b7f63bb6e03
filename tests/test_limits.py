"""Former caps and cuts: more rows than they allowed, and rules that once were wrong."""

from __future__ import annotations

import random

import numpy as np
import pytest

from evidentia import tables as C
from evidentia.operators import corpus, identity, library, ops, search, verify


def test_more_query_vectors_than_a_block(spark):
    rng = np.random.default_rng(0)
    docs = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(90)] + [(90, [0.0] * 8), (91, None)]
    queries = [(i, rng.normal(size=8).tolist()) for i in range(1001)] + [(2000, None)]
    a = spark.createDataFrame(docs, "document_id long, embedding array<float>")
    b = spark.createDataFrame(queries, "query_id long, vector array<double>")
    found = search.semantic(a, b, 5).collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["document_id"], r["similarity"]))
    assert len(got) == 1001
    for i in (0, 500, 1000):
        sims = sorted((-round(float(unit(np.array(v, dtype="float64")) @ unit(queries[i][1])), 6), d) for d, v in docs[:90])[:20]
        assert [(d, s) for _, d, s in sorted(got[i])] == [(d, -s) for s, d in sims]
    assert search.semantic(a, b.limit(0), 5).count() == 0


def test_ties_are_kept_at_the_cut(spark):
    docs = [(i, [1.0, 0.0]) for i in range(50)]
    a = spark.createDataFrame(docs, "document_id long, embedding array<float>").coalesce(1)
    b = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    assert sorted(r["document_id"] for r in search.semantic(a, b, 5).collect()) == list(range(20))


def test_long_statements_stay_apart(spark):
    long = "x" * 130
    rows = [("v", "experiment.metric.a", long + " one"), ("v", "experiment.metric.a", long + " two")]
    claims = spark.createDataFrame(rows, "paper_version_id string, category string, statement string")
    assert corpus.version_metrics(claims).count() == 2
    sets = claims.replace("experiment.metric.a", "experiment.dataset.a")
    assert corpus.dataset_versions(sets).count() == 2


def test_comparisons_of_other_sizes_are_refused(spark):
    chosen = [("five", f"a{i}") for i in range(5)] + [("one", "b0")] + [("two", "c0"), ("two", "c1")]
    claims = spark.createDataFrame(
        [("c0", 1, "m1", "s", "method.x", "p")],
        "paper_version_id string, created_at long, claim_id string, statement string, category string, protocol_key string",
    )
    out = library.compare_versions(claims, spark.createDataFrame(chosen, "comparison_id string, paper_version_id string")).collect()
    refused = [r for r in out if r["dimension"] is None]
    assert sorted(r["paper_version_id"] for r in refused) == ["a0", "a1", "a2", "a3", "a4", "b0"]
    assert all(r["reason"].startswith("refused") for r in refused)
    assert {r["paper_version_id"] for r in out if r["dimension"]} == {"c0", "c1"}


def test_limits_are_errors(spark):
    frame = spark.createDataFrame([(1, "t", "s")], "paper_id long, normalized_title string, state string")
    with pytest.raises(ValueError):
        library.library_page(frame, "TITLE", 0, 101)
    with pytest.raises(ValueError):
        ops.job_list(frame, None, 201)
    collections = spark.createDataFrame([("a",)], "collection_id string")
    with pytest.raises(ValueError, match="unknown collection 'b'"):
        search.search_scope(frame, search.Filters(collection_ids=["a", "b"]), members=frame, collections=collections)


def test_filters_are_not_changed(spark):
    filters = search.Filters()
    docs = spark.createDataFrame([("d", "CLAIM", "p", "text here", "text here")], "document_id string, document_type string, paper_id string, content string, index_text string")
    queries = spark.createDataFrame([("q", "text")], "query_id string, query string")
    assert search.search_documents(docs, queries, "claims", 5, filters).count() == 1
    assert filters == search.Filters()


def test_long_traces_say_that_they_are_cut(spark):
    events = spark.range(1001).selectExpr("'t' AS trace_id", "timestamp_seconds(id) AS occurred_at", "id AS event_id", "'k' AS kind", "'m' AS message")
    runs = spark.createDataFrame([], "trace_id string, started_at timestamp, run_id string, agent_type string")
    calls = spark.createDataFrame([], "trace_id string, created_at timestamp, model_call_id string")
    cut = ops.trace_timeline(events, runs, calls)
    assert cut.count() == 1000 and cut.where("truncated").count() == 1000
    assert ops.trace_rows(events, runs, calls).count() == 1001
    assert ops.trace_timeline(events.limit(3), runs, calls).where("truncated").count() == 0


def arrivals(rows, stored=()):
    """Papers one by one: the rule by itself."""
    dois = {d: p for p, d, _ in stored if d}
    titles = {}
    for p, _, t in stored:
        titles[t] = min(p, titles.get(t, p))
    has_doi = {p for p, d, _ in stored if d}
    out = {}
    for doc, title, doi in sorted(rows):
        if doi in dois:
            paper = dois[doi]
        else:
            paper = titles.setdefault(title, f"new {title}")
            if doi and paper not in has_doi:
                dois[doi] = paper
                has_doi.add(paper)
        out[doc] = paper
    return out


def groups(named):
    byname = {}
    for doc, paper in named.items():
        byname.setdefault(paper, set()).add(doc)
    return sorted(map(sorted, byname.values()))


def test_papers_of_documents_in_order(spark):
    schema = "doc_id long, title string, doi string"
    rows = [(1, "x", "1"), (2, "x", "2"), (3, "z", "2")]
    got = {r["doc_id"]: r["paper_id"] for r in identity.resolve_papers(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == got[2] != got[3]
    rng = random.Random(9)
    rows = [(i, rng.choice("abcdefgh"), rng.choice([None, "1", "2", "3", "4", "5"])) for i in range(60)]
    got = {r["doc_id"]: r["paper_id"] for r in identity.resolve_papers(spark.createDataFrame(rows, schema)).collect()}
    assert groups(got) == groups(arrivals(rows))
    stored = [("p1", "1", "a"), ("p2", None, "b"), ("p3", "9", "c")]
    papers = spark.createDataFrame(stored, "paper_id string, doi string, normalized_title string")
    found = identity.resolve_papers(spark.createDataFrame(rows, schema), papers).collect()
    want = arrivals(rows, stored)
    assert groups({r["doc_id"]: r["paper_id"] for r in found}) == groups(want)
    assert {r["doc_id"]: r["paper_id"] for r in found if r["paper_id"] in ("p1", "p2", "p3")} == {
        d: p for d, p in want.items() if p in ("p1", "p2", "p3")
    }


def declared(spark, name, rows):
    """A canonical table with nulls where a row says nothing."""
    schema = C.schema_of(name)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def test_verify_on_declared_tables(spark):
    own = "Our novel lattice sampler improves retrieval"
    claims = declared(spark, "claims", [{
        "claim_id": "c", "paper_id": "p", "paper_version_id": "v", "claim_type": "FACT", "category": "result.main",
        "statement": own + " novel", "created_by_run_id": "r",
    }])
    links = declared(spark, "claim_evidence", [{"claim_id": "c", "evidence_id": "e", "role": "SUPPORT"}])
    evidence = declared(spark, "evidence", [{
        "evidence_id": "e", "paper_version_id": "v", "section_id": "s", "text": own, "source_method": "PDF_NATIVE",
    }])
    sections = declared(spark, "sections", [{"section_id": "s", "paper_version_id": "v", "normalized_class": "RESULT"}])
    works = spark.createDataFrame([("w", own)], "work_id string, title string")
    papers = spark.createDataFrame([("p", own.upper(), None)], "paper_id string, canonical_title string, doi string")

    def verdict(**more):
        out = verify.verify(claims, links, evidence, "T3_DEEP", works=works, **more).collect()
        return {r["verifier_type"].split(".")[1]: r["verdict"] for r in out}

    plain, full = verdict(), verdict(papers=papers, sections=sections)
    assert set(plain) == {v.split(".")[1] for v in C.VERIFIERS}
    assert plain["external_novelty"] == "WARN" and full["external_novelty"] == "INCONCLUSIVE"
    assert plain["claim_scope"] == "WARN" and full["claim_scope"] == "PASS"
    # Wording beyond the first 500 characters counts too.
    late = claims.selectExpr("*").withColumn("statement", verify.F.lit("of it " * 100 + own))
    assert verify.novelty(late, works).first()["verdict"] == "WARN"
