"""Extraction, structure, evidence, ledger, identity, readers and writers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evidentia import tables as C
from evidentia.operators import evidence as E
from evidentia.operators import extraction as X
from evidentia.operators import identity as I
from evidentia.operators import ledger as L
from evidentia.operators import responses as R
from evidentia.operators import structure as S
from evidentia.sources import readers, writers


def test_page_modes(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [
        ("good", "A page with enough ordinary words to read.", 0.0, 0, [(1.0, 1.0, 10.0, 10.0)]),
        ("flood", "�" * 30 + " some words here ok then", 0.0, 0, []),
        ("stuck", "." * 60 + "abc", 0.0, 0, []),
        ("box", "A page with enough ordinary words to read.", 0.0, 0, [(5.0, 1.0, 1.0, 2.0)]),
        ("blank", "", 0.0, 0, []),
        ("scan", "ab cd", 0.9, 1, []),
        ("plate", "A page with enough ordinary words to read.", 0.7, 1, []),
        ("mixed", "A page with enough ordinary words to read.", 0.2, 1, []),
    ]
    df = spark.createDataFrame(rows, f"id string, native_text string, image_area_ratio double, n_images int, line_boxes array<{box}>")
    df = df.withColumn("width_pt", F.lit(600.0)).withColumn("height_pt", F.lit(800.0))
    got = {r["id"]: (r["mode"], r["needs_ocr"]) for r in X.classify_pages(X.text_quality(df)).collect()}
    assert got == {
        "good": ("NATIVE_TEXT", False),
        "flood": ("BROKEN_TEXT_LAYER", True),
        "stuck": ("BROKEN_TEXT_LAYER", True),
        "box": ("BROKEN_TEXT_LAYER", True),
        "blank": ("SCANNED", True),
        "scan": ("SCANNED", True),
        "plate": ("IMAGE_HEAVY", False),
        "mixed": ("MIXED", True),
    }


def test_segmenting(spark):
    kinds = [
        ("HEADING", "A long"), ("HEADING", "title"), ("BODY", "one"), ("BODY", "two"), ("CAPTION", "Figure 1: a"),
        ("BODY", "c1"), ("BODY", "c2"), ("BODY", "c3"), ("BODY", "after"), ("EQUATION", "x=y"), ("BODY", "tail"),
        ("HEADING", "References:"), ("BODY", "[1] First"), ("BODY", "wrapped"), ("BODY", "[2] Second"),
        ("HEADING", "Appendix"), ("BODY", "[3] not an entry"),
    ]
    rows = [("v", 1, 0, i, text, kind) for i, (kind, text) in enumerate(kinds)]
    rows.append(("v", 2, 0, 0, "next page", "BODY"))
    df = spark.createDataFrame(rows, "paper_version_id string, page int, block int, line int, text string, kind string")
    got = [(r["unit_type"], r["text"]) for r in X.segment_units(df).orderBy("unit").collect()]
    assert got == [
        ("HEADING", "A long\ntitle"), ("PARAGRAPH", "one\ntwo"), ("CAPTION", "Figure 1: a\nc1\nc2\nc3"),
        ("PARAGRAPH", "after"), ("EQUATION", "x=y"), ("PARAGRAPH", "tail"), ("HEADING", "References:"),
        ("REFERENCE", "[1] First\nwrapped"), ("REFERENCE", "[2] Second"), ("HEADING", "Appendix"),
        ("PARAGRAPH", "[3] not an entry"), ("PARAGRAPH", "next page"),
    ]


def test_sections(spark):
    texts = ["intro text", "#1. Introduction", "a", "#1.1 Setup", "b", "#1.1.1 Detail", "#2. Results", "c", "#2.1 More"]
    rows = [("v", 1 + i // 4, i, "HEADING" if t[0] == "#" else "PARAGRAPH", t.lstrip("#")) for i, t in enumerate(texts)]
    rows.append(("w", 1, 0, "PARAGRAPH", "only text"))
    df = spark.createDataFrame(rows, "paper_version_id string, page int, ordinal int, unit_type string, text string")
    assigned = S.assign_sections(df)
    where = {(r["paper_version_id"], r["ordinal"]): r["section"] for r in assigned.collect()}
    assert [where[("v", i)] for i in range(9)] == [0, 1, 1, 2, 2, 3, 4, 4, 5]
    got = {
        (r["paper_version_id"], r["ordinal"]): (r["original_heading"], r["level"], r["parent_ordinal"])
        for r in S.build_sections(assigned).collect()
    }
    assert got == {
        ("v", 0): ("(front matter)", 0, None),
        ("v", 1): ("1. Introduction", 0, None),
        ("v", 2): ("1.1 Setup", 1, 1),
        ("v", 3): ("1.1.1 Detail", 2, 2),
        ("v", 4): ("2. Results", 0, None),
        ("v", 5): ("2.1 More", 1, 4),
        ("w", 0): ("", 0, None),
    }


def test_depths_stop_at_cycles(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")]
    df = spark.createDataFrame(rows, "section_id string, parent_section_id string")
    got = {r["section_id"]: r["depth"] for r in S.section_depths(df).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": 1, "y": 1, "z": 0}


UNIT = (
    "paper_version_id string, unit_type string, page_number int, ordinal int, text string, source_method string,"
    f" ocr_confidence double, asset_sha256 string, content_sha256 string, bbox {C.BOX}"
)


def test_persisting_evidence_twice(spark):
    rows = [
        ("v", "PARAGRAPH", 1, 0, "a", "PDF_NATIVE", None, None, "ha", (0.0, 0.0, 1.0, 1.0)),
        ("v", "PARAGRAPH", 1, 1, "a", "PDF_NATIVE", None, None, "ha", (0.0, 0.0, 1.0, 1.0)),
        ("v", "PARAGRAPH", 1, 2, "a", "PDF_NATIVE", None, None, "ha", None),
        ("v", "PARAGRAPH", 1, 3, "b", "OCR", None, None, "hb", None),
        ("v", "PARAGRAPH", 1, 4, "b", "OCR", 0.5, None, "hb", None),
        ("v", "FIGURE", 1, 5, None, "PDF_NATIVE", None, "s1", "s1", None),
        ("v", "FIGURE", 1, 6, None, "PDF_NATIVE", None, "s9", "s9", None),
        ("v", "FIGURE", 1, 7, None, "PDF_NATIVE", None, None, "x", None),
    ]
    units = spark.createDataFrame(rows, UNIT)
    assets = spark.createDataFrame([("s1", "ast1")], "sha256 string, asset_id string")
    first = E.persist_evidence(units, assets)
    assert {(r["ordinal"], r["copies"], r["quality_state"]) for r in first.collect()} == {
        (0, 2, "GOOD"), (2, 1, "GOOD"), (4, 1, "DEGRADED"), (5, 1, "GOOD"),
    }
    assert E.persist_evidence(units, assets, first).count() == 0
    report = E.persist_report(units, assets).first()
    assert (report["created"], report["reused"], report["ocr_confidence_missing"], report["unknown_asset"], report["no_text_no_asset"]) == (4, 1, 1, 1, 1)


def test_corrections(spark):
    evidence = spark.createDataFrame(
        [("e1", "v", "old", "PDF_NATIVE", None, "h1")],
        "evidence_id string, paper_version_id string, text string, source_method string, ocr_confidence double, content_sha256 string",
    )
    fixes = spark.createDataFrame(
        [("e1", "new", None), ("e1", None, "OCR"), ("e1", None, None), ("e9", "x", None)], "evidence_id string, text string, source_method string"
    )
    got = sorted((r["supersedes_evidence_id"], r["text"] or "", r["refused"] or "") for r in E.apply_corrections(evidence, fixes).collect())
    assert got == [("e1", "new", ""), ("e1", "old", "no_change"), ("e1", "old", "ocr_confidence_missing"), ("e9", "x", "EVIDENCE_001")]


def test_locators_turn_with_the_page(spark):
    evidence = spark.createDataFrame(
        [("n", "v", 1, "PDF_NATIVE", (10.0, 20.0, 30.0, 60.0)), ("o", "v", 1, "OCR", (10.0, 20.0, 30.0, 60.0)),
         ("m", "v", 1, "MIXED_NATIVE_OCR", (10.0, 20.0, 30.0, 60.0)), ("x", "v", 1, "OCR", None), ("p", "v", 2, "OCR", (1.0, 1.0, 2.0, 2.0))],
        f"evidence_id string, paper_version_id string, page_start int, source_method string, bbox {C.BOX}",
    )
    geometry = spark.createDataFrame([("v", 1, 200.0, 100.0, 90)], "paper_version_id string, page_number int, width double, height double, rotation int")
    got = {r["evidence_id"]: (r["precision"], tuple(r["rect_norm"]) if r["rect_norm"] else None) for r in E.locators(evidence, geometry).collect()}
    assert got["n"] == ("REGION", (0.7, 0.1, 0.9, 0.3))
    assert got["o"] == ("REGION", (0.05, 0.2, 0.15, 0.6))
    assert got["m"] == got["x"] == got["p"] == ("PAGE", None)


def test_ledger(spark):
    cands = spark.createDataFrame(
        [("a", "r1", "v", "FACT", "c", "Same  Thing", 0), ("b", "r1", "v", "FACT", "c", "same thing", 1),
         ("c", "r2", "v", "INFERENCE", "c", "no link", 0), ("d", "r2", "v", "FACT", "c", "fine", 1), ("e", "r3", "v", "EXTERNAL", "c", "x", 0)],
        "candidate_id string, run_id string, paper_version_id string, claim_type string, category string, statement string, ordinal int",
    )
    links = spark.createDataFrame([("a", "e1", "SUPPORT"), ("b", "e1", "SUPPORT"), ("d", "e1", "SUPPORT"), ("e", "e1", "SUPPORT")], "candidate_id string, evidence_id string, role string")
    evidence = spark.createDataFrame([("e1", "v")], "evidence_id string, paper_version_id string")
    rows = L.ledger_append(cands, links, evidence).collect()
    assert [(r["candidate_id"], r["copies"], r["support_state"]) for r in rows] == [("a", 2, "UNVERIFIED")]
    problems = {r["candidate_id"]: r["problem"] for r in L.candidate_problems(cands, links, evidence).collect()}
    assert problems == {"a": None, "b": None, "c": "no_evidence", "d": None, "e": "external_refused"}


def test_papers_follow_the_first_doi(spark):
    docs = spark.createDataFrame(
        [(1, "Title T", None), (2, "Title T", "d1"), (3, "Other U", "d1"), (4, "Title T!", None), (5, "Known K", None), (6, "Z", "d9")],
        "doc_id int, title string, doi string",
    )
    papers = spark.createDataFrame([("pk", None, "known k"), ("p9", "d9", "else")], "paper_id string, doi string, normalized_title string")
    got = {r["doc_id"]: (r["paper_id"], r["matched_by"]) for r in I.resolve_papers(docs, papers).collect()}
    assert got[1] == got[2] == got[3] == got[4] and got[1][1] == "batch"
    assert got[5] == ("pk", "title") and got[6] == ("p9", "doi")
    dois = {r["paper_id"]: r["doi"] for r in I.paper_dois(I.resolve_papers(docs, papers), papers).collect()}
    assert dois["p9"] == "d9" and dois["pk"] is None and dois[got[1][0]] == "d1"


def test_version_labels_skip_taken(spark):
    arrivals = spark.sql("select * from values ('p', timestamp'2024-01-01'), ('p', timestamp'2024-01-02'), ('q', timestamp'2024-01-01') as t(paper_id, arrival)")
    existing = spark.createDataFrame([("p", "v1"), ("p", "v3"), ("p", "draft")], "paper_id string, version_label string")
    got = [r["version_label"] for r in I.version_labels(arrivals, existing).orderBy("paper_id", "arrival").collect()]
    assert got == ["v4", "v5", "v1"]


def test_import_states(spark):
    batch = spark.createDataFrame(
        [("a", "b1", "h1", 1, None), ("b", "b1", "h1", 1, None), ("c", "b1", "h2", 1, None), ("d", "b1", "h3", 1, "EXTRACT_001"), ("e", "b1", "h4", 1, "DISPATCH_X")],
        "item_id string, batch_id string, sha256 string, size_bytes int, error_code string",
    )
    versions = spark.createDataFrame([("h2", "v1")], "content_sha256 string, paper_version_id string")
    got = {r["item_id"]: r["state"] for r in I.import_items(batch, versions).collect()}
    assert got == {"a": "IMPORTED", "b": "DUPLICATE", "c": "DUPLICATE", "d": "FAILED", "e": "RETRYABLE"}


def response(claims, status="SUCCESS", **more):
    return json.dumps({"status": status, "claims": claims, **more})


def cand(statement, kind="FACT", refs=(("e1", "SUPPORT"),)):
    return {"claim_type": kind, "category": "c", "statement": statement, "evidence": [{"evidence_id": e, "role": r} for e, r in refs]}


def test_responses(spark):
    raw = [
        ("refusal", "I'm sorry, but I cannot"), ("prose", "hello"), ("list", "[1]"), ("shape", '{"status": "MAYBE"}'),
        ("fence", "```json\n" + response([cand("Alpha reaches 82.5")]) + "\n```"),
        ("dup", response([cand("Same here"), cand("same  here")])),
        ("many", response([cand(f"Alpha {i}") for i in range(41)])),
        ("alien", response([cand("Alpha", refs=[("e2", "SUPPORT")])])),
        ("gone", response([cand("Alpha", refs=[("zz", "SUPPORT")])])),
        ("mixed", response([cand("Alpha reaches 82.5"), cand("Alpha reaches 99"), cand("Bare", "INFERENCE", ()), cand("Ctx alpha", refs=[("e1", "CONTEXT")])])),
        ("spam", response([cand("Alpha reaches 82.5")], warnings=["w"] * 51)),
    ]
    df = spark.createDataFrame([(i, "v", t) for i, t in raw], "response_id string, paper_version_id string, content string")
    parsed = R.parse_payload(df)
    codes = {r["response_id"]: r["code"] for r in parsed.collect()}
    assert codes["refusal"] == "LLM_005" and codes["prose"] == codes["list"] == "LLM_003" and codes["shape"] == "LLM_004"
    evidence = spark.createDataFrame([("e1", "v", "Alpha reaches 82.5 points"), ("e2", "w", "Alpha")], "evidence_id string, paper_version_id string, text string")
    got = {}
    for r in R.validate_candidates(parsed, evidence).orderBy("response_id", "position").collect():
        got.setdefault(r["response_id"], []).append(r["outcome"])
    assert got["fence"] == ["KEPT"]
    assert set(got["dup"]) == {"REJECTED:duplicate_statement"} and set(got["many"]) == {"REJECTED:too_many_claims"}
    assert got["alien"] == ["REJECTED:EVIDENCE_002"] and got["gone"] == ["REJECTED:EVIDENCE_001"]
    assert got["mixed"] == ["KEPT", "DROPPED:unsupported", "DROPPED:no_provenance", "DROPPED:no_support"]
    assert got["spam"] == ["REJECTED:too_many_warnings"]


@pytest.mark.parametrize(
    "layout,record,want",
    [
        ("crossref", {"DOI": "10.1/x", "title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "container-title": ["V"], "issued": {"date-parts": [[2020, 1]]}}, ("10.1/x", "T", ["A B", "C"], "V", 2020, False)),
        ("openalex", {"id": "W1", "display_name": "T", "doi": "https://doi.org/10.1/x", "authorships": [{"author": {"display_name": "A"}}], "publication_year": 2021}, ("W1", "T", ["A"], None, 2021, False)),
        ("semantic_scholar", {"paperId": "s1", "title": " ", "authors": [{"name": "A"}]}, ("s1", " ", ["A"], None, None, True)),
        ("semantic_scholar", {"paperId": "s1", "title": "T", "authors": [{"name": None}]}, ("s1", "T", [None], None, None, True)),
    ],
)
def test_metadata_layouts(spark, layout, record, want):
    df = spark.createDataFrame([(json.dumps(record),)], "content string")
    r = R.normalize_metadata(df, layout).first()
    assert (r["identifier"], r["title"], r["authors"], r["venue"], r["year"], r["malformed"]) == want


def test_reports_and_tables(spark, tmp_path):
    unit = {"unit_type": "PARAGRAPH", "page_number": 1, "ordinal": 0, "text": "t", "source_method": "OCR", "flags": []}
    good = {"run_id": "r", "paper_version_id": "v", "page_count": 1, "pages": [{"page_number": 1, "mode": "SCANNED", "units": [unit]}]}
    path = tmp_path / "reports.json"
    path.write_text(json.dumps(good) + "\n{broken\n")
    reports, bad = readers.read_reports(spark, str(path), lines=True)
    assert bad.count() == 1
    assert [(r["page"], r["text"]) for r in readers.report_units(reports).collect()] == [(1, "t")]
    # One indented object per file, as they are stored.
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "a.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "whole" / "b.json").write_text("{\n broken")
    reports, bad = readers.read_reports(spark, str(tmp_path / "whole"))
    assert bad.count() == 1
    assert [(r["page"], r["text"]) for r in readers.report_units(reports).collect()] == [(1, "t")]
    schema = C.schema_of("claims")
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "store" / "claims"))
    assert readers.read_table(spark, str(tmp_path / "store"), "claims").schema == schema
    for name in C.TABLES:
        assert C.schema_of(name).fields


def test_inventory_and_upsert(spark, tmp_path):
    root = tmp_path / "data"
    (root / "objects" / "pdf").mkdir(parents=True)
    (root / "objects" / "pdf" / "a").write_bytes(b"abc")
    (root / "temp").mkdir()
    (root / "temp" / "b").write_bytes(b"de")
    rows = {r["storage_key"]: (r["size_bytes"], r["storage_class"]) for r in readers.object_inventory(spark, str(root)).collect()}
    assert rows == {"objects/pdf/a": (3, "objects"), "temp/b": (2, "temp")}
    hashed = readers.object_inventory(spark, str(root), hashes=True).where("storage_class = 'temp'").first()
    assert len(hashed["actual_sha256"]) == 64
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k int, v string")
    target = str(tmp_path / "t")
    for _ in range(2):
        writers.upsert_new(batch, target, ["k"])
    assert spark.read.parquet(target).count() == 2


def test_events_drop_unknown_fields(spark, tmp_path):
    path = tmp_path / "events.json"
    path.write_text(json.dumps({"provider": "p", "kind": "attempt", "status": "OK", "api_key": "sk-secret", "occurred": "2024-01-01T00:00:00"}) + "\n")
    df = readers.read_events(spark, str(path))
    assert "api_key" not in df.columns and df.first()["status"] == "OK"
    assert readers.read_events(spark, str(tmp_path), stream=True).isStreaming


def test_merkle_hash_follows_the_members_alone(spark):
    def tree(ids, leaf=4, parts=3):
        frame = spark.createDataFrame([("k", i) for i in ids], "k string, id string").repartition(parts)
        return [tuple(r) for r in L.merkle_hash(frame, ["k"], "id", leaf).collect()]

    ids = [f"m{i}" for i in range(1500)]
    (whole,) = tree(ids)
    assert whole[1:3] == (1500, 2)
    assert tree([*reversed(ids), *ids[:40], None], parts=7) == [whole]
    for changed in (ids[1:], [*ids, "x"], ["y", *ids[1:]], ids[:-1] + ["z"]):
        assert tree(changed)[0][3] != whole[3]
    sizes = {n: tree(ids[:n])[0][2] for n in (1, 4, 5, 1024, 1025)}
    assert sizes == {1: 0, 4: 0, 5: 1, 1024: 1, 1025: 2}
    assert tree([]) == []


def test_merkle_hash_spreads_one_key_and_reads_its_members_once(spark):
    ids = spark.range(5000).select(F.lit("k").alias("k"), F.col("id").cast("string").alias("id"))
    plan = L.merkle_hash(ids, ["k"], "id", 4)._jdf.queryExecution().executedPlan().toString()
    # Once for the sizes and once for the leaves, not once for each level of the tree.
    assert plan.count("sha2(cast(id") <= 2
    assert "hashpartitioning(k#" in plan and "__first#" in plan


def test_units_without_an_asset_are_not_one_group(spark):
    units = spark.range(400).select(
        F.col("id").alias("paper_version_id"), F.lit("PARAGRAPH").alias("unit_type"), F.lit(1).alias("page_number"),
        F.lit(0).alias("ordinal"), F.concat(F.lit("text "), "id").alias("text"), F.lit("PDF_NATIVE").alias("source_method"),
        F.lit(None).cast("double").alias("ocr_confidence"), F.lit(None).cast("string").alias("bbox"),
        F.expr("CASE id % 4 WHEN 0 THEN 'known' WHEN 1 THEN 'lost' END").alias("asset_sha256"), F.sha2(F.concat(F.lit("text "), "id"), 256).alias("content_sha256"),
    )
    assets = spark.createDataFrame([("known", "a1")], "sha256 string, asset_id string").hint("merge")
    judged = E.judge_units(units, assets)
    assert "__place" not in judged.columns
    got = {tuple(r) for r in judged.groupBy("asset_sha256", "asset_id", "excluded").count().collect()}
    assert got == {("known", "a1", None, 100), ("lost", None, "unknown_asset", 100), (None, None, None, 200)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        alone = judged.where("asset_sha256 IS NULL").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert alone > 1
