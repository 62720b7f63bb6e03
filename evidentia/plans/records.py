"""Queries over evidence, ledger and identity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import evidence as E
from evidentia.operators import identity as I
from evidentia.operators import keyed as K
from evidentia.operators import ledger as L
from evidentia.plans import duck
from evidentia.plans.registry import query
from evidentia.sources import readers, writers

# Document lines seen as extracted units; the expressions run in both engines.
UNIT = {
    "paper_version_id": "doc_id",
    "page_number": "cast(1 + floor(ordinal / 40) AS int)",
    "ordinal": "cast(ordinal AS int)",
    "unit_type": "CASE WHEN length(line) < 40 THEN 'HEADING' ELSE 'PARAGRAPH' END",
    "text": "CASE WHEN length(line) > 5 THEN line END",
    "source_method": "CASE WHEN doc_id % 3 = 0 THEN 'OCR' ELSE 'PDF_NATIVE' END",
    "ocr_confidence": "CASE WHEN doc_id % 3 = 0 AND ordinal % 7 > 0 THEN cast(ordinal % 10 AS double) / 10 END",
    "asset_sha256": "CASE WHEN ordinal % 13 = 5 THEN concat('sha_', cast(doc_id % 10 AS string)) END",
    "bbox": "cast(NULL AS string)",
}
LINES = """
lines AS MATERIALIZED (SELECT doc_id, ordinal, line FROM (
  SELECT doc_id, unnest(range(len(parts))) AS ordinal, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(replace(text, chr(0), chr(65533)), chr(10)) AS parts FROM documents) a) b
  WHERE NOT regexp_full_match(line, '[\\s\\x{FFFD}\\x{00A0}]*'))"""
UNITS = LINES + """,
units AS MATERIALIZED (SELECT """ + ", ".join(f"{v} AS {k}" for k, v in UNIT.items()) + """,
  sha256(line) AS content_sha256 FROM lines),
assets AS (SELECT concat('sha_', cast(i AS string)) AS sha256, concat('ast_', cast(i AS string)) AS asset_id
  FROM (SELECT DISTINCT doc_id % 10 AS i FROM documents WHERE doc_id % 10 < 8) q),
judged AS MATERIALIZED (SELECT u.*, asset_id, CASE WHEN source_method = 'OCR' AND ocr_confidence IS NULL THEN 'ocr_confidence_missing'
    WHEN asset_sha256 IS NOT NULL AND asset_id IS NULL THEN 'unknown_asset'
    WHEN text IS NULL AND asset_id IS NULL THEN 'no_text_no_asset' END AS excluded,
  CASE WHEN source_method <> 'PDF_NATIVE' AND (ocr_confidence IS NULL OR ocr_confidence < 0.6) THEN 'DEGRADED'
    ELSE 'GOOD' END AS quality_state
  FROM units u LEFT JOIN assets a ON u.asset_sha256 = a.sha256)"""
IDENT = "paper_version_id, unit_type, page_number, content_sha256, source_method, ocr_confidence, quality_state, asset_id"


def units(t):
    lines = readers.text_lines(t.documents)
    return lines.select(
        *[F.expr(v).alias(k) for k, v in UNIT.items()], F.sha2("line", 256).alias("content_sha256")
    )


def assets(t):
    tens = t.documents.select((F.col("doc_id") % 10).alias("i")).where("i < 8").distinct()
    return tens.select(
        F.concat(F.lit("sha_"), F.col("i")).alias("sha256"),
        F.concat(F.lit("ast_"), F.col("i")).alias("asset_id"),
    )


@query("s3_text_lines", f"WITH {LINES} SELECT doc_id, ordinal, line FROM lines")
def s3(t):
    return readers.text_lines(t.documents).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("e15_persist_evidence", f"""WITH {UNITS}
SELECT {IDENT}, min(ordinal) AS ordinal, count(*) AS copies FROM judged WHERE excluded IS NULL GROUP BY {IDENT}""")
def e15(t):
    return E.persist_evidence(units(t), assets(t)).drop("evidence_id", "bbox", "text")


@query("e15_persist_report", f"""WITH {UNITS}, made AS (SELECT paper_version_id, count(*) AS created FROM (
  SELECT DISTINCT {IDENT} FROM judged WHERE excluded IS NULL) q GROUP BY paper_version_id)
SELECT j.paper_version_id, count(*) AS units,
  count(*) FILTER (WHERE excluded = 'ocr_confidence_missing') AS ocr_confidence_missing,
  count(*) FILTER (WHERE excluded = 'unknown_asset') AS unknown_asset,
  count(*) FILTER (WHERE excluded = 'no_text_no_asset') AS no_text_no_asset,
  coalesce(max(created), 0) AS created, count(*) FILTER (WHERE excluded IS NULL) - coalesce(max(created), 0) AS reused
FROM judged j LEFT JOIN made m ON j.paper_version_id = m.paper_version_id GROUP BY j.paper_version_id""")
def e15_report(t):
    return E.persist_report(units(t), assets(t))


@query("e16_apply_corrections", """
SELECT evidence_id AS supersedes_evidence_id, concat(text, ' (fixed)') AS text, 'PDF_NATIVE' AS source_method,
  sha256(concat(text, ' (fixed)')) AS content_sha256, ocr_confidence, page_start, paper_version_id,
  cast(NULL AS varchar) AS refused
FROM evidence WHERE section_class = 'RESULT'""")
def e16(t):
    base = t.evidence.withColumn("content_sha256", F.sha2("text", 256)).drop("supersedes_evidence_id")
    fixes = t.evidence.where("section_class = 'RESULT'").select(
        "evidence_id",
        F.concat("text", F.lit(" (fixed)")).alias("text"),
        F.lit("PDF_NATIVE").alias("source_method"),
    )
    return E.apply_corrections(base, fixes).select(
        "supersedes_evidence_id", "text", "source_method", "content_sha256", "ocr_confidence",
        "page_start", "paper_version_id", "refused",
    )


def history(t):
    return t.evidence_history.withColumn(
        "quality_state", X.unit_quality(F.col("source_method"), F.col("ocr_confidence"))
    )


QUALITY = ("CASE WHEN source_method = 'OCR' AND (ocr_confidence IS NULL OR ocr_confidence < 0.6)"
           " THEN 'DEGRADED' ELSE 'GOOD' END")


@query("p4_list_active_evidence", f"""
SELECT evidence_id, paper_version_id, page_start FROM evidence_history h
WHERE NOT EXISTS (SELECT 1 FROM evidence_history s WHERE s.supersedes_evidence_id = h.evidence_id
  AND s.paper_version_id = h.paper_version_id)
  AND {QUALITY} = 'GOOD' AND evidence_type IN ('PARAGRAPH', 'TABLE')""")
def p4(t):
    return E.list_evidence(
        history(t), types=["PARAGRAPH", "TABLE"], qualities=["GOOD"], include_superseded=False
    ).select("evidence_id", "paper_version_id", "page_start")


@query("p5_evidence_on_page", """
SELECT evidence_id, substr(text, 1, 2000) AS text FROM evidence WHERE 3 BETWEEN page_start AND page_end""")
def p5(t):
    return E.evidence_on_page(t.evidence, 3).select("evidence_id", "text")


@query("j7_evidence_on_pages", """
SELECT p.paper_version_id, p.page, e.evidence_id
FROM (SELECT DISTINCT paper_version_id, page_start AS page FROM evidence) p JOIN evidence e
  ON p.paper_version_id = e.paper_version_id AND p.page BETWEEN e.page_start AND e.page_end""")
def j7(t):
    pages = t.evidence.select("paper_version_id", F.col("page_start").alias("page")).distinct()
    return E.evidence_on_pages(t.evidence, pages).select("paper_version_id", "page", "evidence_id")


@query("p6_typed_evidence", """
SELECT paper_version_id, evidence_id, page_start FROM (SELECT *, row_number() OVER (PARTITION BY paper_version_id ORDER BY page_start, evidence_id) AS rn
  FROM evidence_history h WHERE evidence_type = 'TABLE' AND evidence_id NOT IN (
    SELECT supersedes_evidence_id FROM evidence_history WHERE supersedes_evidence_id IS NOT NULL)) q WHERE rn <= 20""")
def p6(t):
    return E.typed_evidence(history(t), "TABLE").select("paper_version_id", "evidence_id", "page_start")


@query("a4_version_summary", f"""
WITH h AS (SELECT *, {QUALITY} AS quality_state FROM evidence_history)
SELECT t.paper_version_id, evidence_total, evidence_superseded, evidence_total - evidence_superseded AS evidence_active,
  by_type, by_quality
FROM (SELECT paper_version_id, count(*) AS evidence_total, count(DISTINCT supersedes_evidence_id) AS evidence_superseded
  FROM h GROUP BY 1) t
JOIN (SELECT paper_version_id, list_sort(list(concat(k, '=', n))) AS by_type FROM (SELECT paper_version_id,
  evidence_type AS k, count(*) AS n FROM h GROUP BY 1, 2) q GROUP BY 1) a ON t.paper_version_id = a.paper_version_id
JOIN (SELECT paper_version_id, list_sort(list(concat(k, '=', n))) AS by_quality FROM (SELECT paper_version_id,
  quality_state AS k, count(*) AS n FROM h GROUP BY 1, 2) q GROUP BY 1) b ON t.paper_version_id = b.paper_version_id""")
def a4(t):
    out = E.version_summary(history(t))
    return out.withColumn(
        "by_type", F.transform("by_type", lambda e: F.concat_ws("=", e["evidence_type"], e["n"]))
    ).withColumn(
        "by_quality", F.transform("by_quality", lambda e: F.concat_ws("=", e["quality_state"], e["n"]))
    )


# Boxes and page geometry derived from the evidence rows.
BOX = ("cast(page_start * 10 AS double)", "cast(length(text) AS double)",
       "cast(page_start * 10 + length(text) AS double)", "cast(length(text) * 2 - 60 AS double)")


@query("e17_locators", f"""
WITH b AS (SELECT evidence_id, paper_version_id, page_start, source_method, {BOX[0]} AS x0, {BOX[1]} AS y0, {BOX[2]} AS x1,
  {BOX[3]} AS y1, 100.0 AS w, 120.0 AS h, CASE paper_version_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 180 ELSE 270 END AS rot FROM evidence),
r AS (SELECT *, CASE WHEN source_method = 'OCR' OR rot = 0 THEN x0 WHEN rot = 90 THEN w - y1 WHEN rot = 180 THEN w - x1 ELSE y0 END AS l,
  CASE WHEN source_method = 'OCR' OR rot = 0 THEN y0 WHEN rot = 90 THEN x0 WHEN rot = 180 THEN h - y1 ELSE h - x1 END AS t,
  CASE WHEN source_method = 'OCR' OR rot = 0 THEN x1 WHEN rot = 90 THEN w - y0 WHEN rot = 180 THEN w - x0 ELSE y1 END AS rr,
  CASE WHEN source_method = 'OCR' OR rot = 0 THEN y1 WHEN rot = 90 THEN x1 WHEN rot = 180 THEN h - y0 ELSE h - x0 END AS bb FROM b),
c AS (SELECT *, greatest(l, 0) / w AS fx0, greatest(t, 0) / h AS fy0, least(rr, w) / w AS fx1, least(bb, h) / h AS fy1,
  x1 > x0 AND y1 > y0 AS sane FROM r)
SELECT evidence_id, CASE WHEN ok THEN 'REGION' ELSE 'PAGE' END AS "precision", CASE WHEN ok THEN round(fx0, 6) END AS x0,
  CASE WHEN ok THEN round(fy0, 6) END AS y0, CASE WHEN ok THEN round(fx1, 6) END AS x1, CASE WHEN ok THEN round(fy1, 6) END AS y1
FROM (SELECT *, sane AND fx1 > fx0 AND fy1 > fy0 AS ok FROM c) q""")
def e17(t):
    boxed = t.evidence.withColumn(
        "bbox", F.struct(*[F.expr(e).alias(n) for n, e in zip(("x0", "y0", "x1", "y1"), BOX)])
    )
    geometry = t.evidence.select("paper_version_id", F.col("page_start").alias("page_number")).distinct().select(
        "*",
        F.lit(100.0).alias("width"),
        F.lit(120.0).alias("height"),
        (F.col("paper_version_id") % 4 * 90).cast("int").alias("rotation"),
    )
    out = E.locators(boxed, geometry)
    return out.select(
        "evidence_id", "precision", *[F.round(f"rect_norm.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")]
    )


# ---- ledger -----------------------------------------------------------------

CANDIDATE = {
    "candidate_id": "claim_id",
    "run_id": "concat(cast(paper_version_id AS string), '_', cast(cast(created_at AS date) AS string))",
    "paper_version_id": "paper_version_id",
    "claim_type": "claim_type",
    "category": "category",
    "statement": "statement",
    "ordinal": "created_at",
}


def candidates(t):
    return t.claims.select(*[F.expr(v).alias(k) for k, v in CANDIDATE.items()])


CAND = "cand AS MATERIALIZED (SELECT " + ", ".join(f"{v} AS {k}" for k, v in CANDIDATE.items()) + " FROM claims)"
PROBLEMS = CAND + """, cites AS (SELECT l.claim_id, count(*) AS n, bool_or(role = 'SUPPORT') AS sup,
  bool_or(e.evidence_id IS NULL) AS unknown, bool_or(e.paper_version_id <> c.paper_version_id) AS alien
  FROM claim_evidence l JOIN cand c ON c.candidate_id = l.claim_id LEFT JOIN evidence e ON e.evidence_id = l.evidence_id GROUP BY l.claim_id),
judged AS MATERIALIZED (SELECT c.*, CASE WHEN claim_type = 'EXTERNAL' THEN 'external_refused'
  WHEN claim_type = 'FACT' AND NOT coalesce(sup, false) THEN 'fact_without_support' WHEN n IS NULL THEN 'no_evidence'
  WHEN unknown THEN 'unknown_evidence' WHEN coalesce(alien, false) THEN 'evidence_of_other_version' END AS problem
  FROM cand c LEFT JOIN cites ON cites.claim_id = c.candidate_id)"""


def links(t):
    return t.claim_evidence.withColumnRenamed("claim_id", "candidate_id")


@query("d7_candidate_problems", f"WITH {PROBLEMS} SELECT candidate_id, run_id, problem FROM judged")
def d7_problems(t):
    return L.candidate_problems(candidates(t), links(t), t.evidence).select("candidate_id", "run_id", "problem")


@query("d7_ledger_append", f"""WITH {PROBLEMS}
SELECT run_id, paper_version_id, lower({duck.squeeze('statement')}) AS normalized_statement,
  arg_min(candidate_id, (ordinal, candidate_id)) AS candidate_id, count(*) AS copies
FROM judged WHERE run_id NOT IN (SELECT run_id FROM judged WHERE problem IS NOT NULL)
GROUP BY run_id, paper_version_id, lower({duck.squeeze('statement')})""")
def d7(t):
    return L.ledger_append(candidates(t), links(t), t.evidence).select(
        "run_id", "paper_version_id", "normalized_statement", "candidate_id", "copies"
    )


@query("d8_external_claims", """
WITH r AS (SELECT DISTINCT s_suppkey AS paper_version_id, concat('Supplier#', s_nationkey) AS identifier, s_name, s_nationkey FROM supplier)
SELECT paper_version_id, identifier, 'external.metadata.title' AS category, concat('title: "', s_name, '"') AS statement FROM r
UNION ALL SELECT paper_version_id, identifier, 'external.metadata.year', concat('year: ', cast(2000 + s_nationkey AS string))
FROM r WHERE s_nationkey % 2 = 0""")
def d8(t):
    records = t.supplier.select(
        F.col("s_suppkey").alias("paper_version_id"),
        F.lit("mock").alias("provider"),
        F.concat(F.lit("Supplier#"), F.col("s_nationkey")).alias("identifier"),
        F.sha2("s_name", 256).alias("content_hash"),
        F.concat(F.lit('"'), "s_name", F.lit('"')).alias("title"),
        F.lit(None).cast("string").alias("authors"),
        F.lit(None).cast("string").alias("venue"),
        F.when(F.col("s_nationkey") % 2 == 0, (F.lit(2000) + F.col("s_nationkey")).cast("string")).alias("year"),
        F.lit(None).cast("string").alias("doi"),
    )
    return L.external_claims(records).select("paper_version_id", "identifier", "category", "statement")


def findings(t):
    sources = t.claims.where("category = 'result.main'").select(
        F.concat_ws("/", "paper_version_id", "category").alias("finding_id"), "claim_id"
    )
    heads = t.paper_versions.select(
        F.concat_ws("/", "paper_version_id", F.lit("result.main")).alias("finding_id"),
        "paper_id",
        "paper_version_id",
        F.lit("corpus.summary").alias("category"),
        F.concat(F.lit("Results of "), F.col("paper_version_id")).alias("statement"),
    )
    return heads, sources


@query("d9_materialize_findings", """
SELECT v.paper_version_id, CASE WHEN n IS NULL THEN 'no_source_claims' WHEN ev IS NULL THEN 'no_evidence' END AS refused, ev AS evidence_count
FROM paper_versions v LEFT JOIN (SELECT c.paper_version_id, count(DISTINCT c.claim_id) AS n, nullif(count(DISTINCT l.evidence_id), 0) AS ev
  FROM claims c LEFT JOIN claim_evidence l ON c.claim_id = l.claim_id WHERE category = 'result.main' GROUP BY 1) q
ON v.paper_version_id = q.paper_version_id""")
def d9(t):
    heads, sources = findings(t)
    made, _, refused = L.materialize_findings(heads, sources, t.claims, t.claim_evidence)
    back = heads.select("finding_id", "paper_version_id")
    return made.select("paper_version_id", F.lit(None).cast("string").alias("refused"), "evidence_count").unionByName(
        refused.join(back, "finding_id").select(
            "paper_version_id", "refused", F.lit(None).cast("long").alias("evidence_count")
        )
    )


@query("d12_claim_revision", """
SELECT claim_id, substr(sha256(concat_ws('|', claim_id, support_state, statement,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '')), 1, 16) AS revision FROM claims""")
def d12(t):
    return L.claim_revision(t.claims)


@query("d13_selection_hash", """
WITH s AS (SELECT DISTINCT p.collection_id, cast(v.paper_version_id AS string) AS id
  FROM collection_papers p JOIN paper_versions v ON p.paper_id = v.paper_id),
h AS (SELECT collection_id, count(*) AS selected, sum(cast(concat('0x', substr(sha256(id), 1, 12)) AS bigint)) AS total FROM s GROUP BY 1)
SELECT collection_id, selected, substr(sha256(concat(selected, '|', total)), 1, 16) AS selection_hash FROM h""")
def d13(t):
    rows = t.collection_papers.join(t.paper_versions, "paper_id")
    return L.selection_hash(rows, ["collection_id"], "paper_version_id")


def merkle_level(level: int) -> str:
    """Checking SQL of one level of the tree."""
    above = f"n{level + 1}"
    return f"""n{level} AS (SELECT * FROM {above} WHERE length(block) <> {2 * level} UNION ALL
  SELECT claim_type, selected, depth, substr(block, 1, {2 * level - 2}), sha256(string_agg(concat(block, h), '' ORDER BY concat(block, h)))
  FROM {above} WHERE length(block) = {2 * level} GROUP BY 1, 2, 3, 4)"""


@query("d13_merkle_hash", f"""
WITH m AS (SELECT DISTINCT claim_type, sha256(claim_id) AS h FROM claims), s AS (SELECT claim_type, count(*) AS selected FROM m GROUP BY 1),
d AS (SELECT *, cast(selected > 16 AS int) + cast(selected > 4096 AS int) + cast(selected > 1048576 AS int) + cast(selected > 268435456 AS int) AS depth FROM s),
n5 AS (SELECT claim_type, selected, depth, substr(h, 1, 2 * depth) AS block, sha256(string_agg(h, '' ORDER BY h)) AS h FROM m JOIN d USING (claim_type) GROUP BY 1, 2, 3, 4),
{", ".join(merkle_level(k) for k in (4, 3, 2, 1))}
SELECT claim_type, selected, depth, substr(h, 1, 16) AS selection_hash FROM n1""")
def d13_merkle(t):
    """All claims of a type as one set, with small leaves so that the tree has several levels."""
    return L.merkle_hash(t.claims, ["claim_type"], "claim_id", 16)


@query("d13_scope_revision", """
SELECT substr(sha256(array_to_string(list_sort(list(p)), '|')), 1, 16) AS revision FROM (
  SELECT concat('claims|', count(*), '|', strftime(max(created_at), '%Y-%m-%d %H:%M:%S')) AS p FROM claims
  UNION ALL SELECT concat('tasks|', count(*), '|', strftime(max(created_at), '%Y-%m-%d %H:%M:%S')) FROM tasks) q""")
def d13_scope(t):
    return L.scope_revision({"claims": t.claims, "tasks": t.tasks})


# ---- identity ---------------------------------------------------------------


@query("d1_content_fingerprint", """
SELECT doc_id, content_sha256, min(doc_id) OVER w AS keeper, count(*) OVER w AS copies,
  doc_id <> min(doc_id) OVER w AS is_duplicate
FROM (SELECT doc_id, sha256(text) AS content_sha256 FROM documents) q WINDOW w AS (PARTITION BY content_sha256)""")
def d1(t):
    return I.content_fingerprint(t.documents)


TITLE_UNITS = LINES + """,
u AS MATERIALIZED (SELECT doc_id, ordinal, line, CASE WHEN length(line) < 40 THEN 'HEADING' ELSE 'PARAGRAPH' END AS kind FROM lines
  WHERE ordinal < 40),
titles AS MATERIALIZED (SELECT d.doc_id, source, n_chars, CASE WHEN source = 'src1' THEN 'Given title' END AS opt,
  CASE WHEN source = 'src2' THEN ' Meta  ' END AS meta,
  (SELECT arg_min(line, ordinal) FROM u WHERE u.doc_id = d.doc_id AND kind = 'HEADING') AS heading,
  (SELECT arg_max(line, (length(line), -ordinal)) FROM (SELECT * FROM u WHERE u.doc_id = d.doc_id
     AND length(line) BETWEEN 12 AND 300 ORDER BY ordinal LIMIT 5) q) AS longest,
  concat('doc_', d.doc_id) AS stem FROM documents d),
resolved AS MATERIALIZED (SELECT doc_id, n_chars, coalesce(opt, trim(meta), """ + duck.squeeze("heading") + ", " + duck.squeeze("longest") + """, stem) AS title,
  CASE WHEN opt IS NOT NULL THEN 'option' WHEN meta IS NOT NULL THEN 'metadata' WHEN heading IS NOT NULL THEN 'heading'
    WHEN longest IS NOT NULL THEN 'longest_unit' ELSE 'file_stem' END AS title_rule FROM titles)"""


def titles(t):
    docs = t.documents.select(
        "doc_id",
        F.when(F.col("source") == "src1", "Given title").alias("option_title"),
        F.when(F.col("source") == "src2", " Meta  ").alias("metadata_title"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("file_stem"),
    )
    rows = readers.text_lines(t.documents).select(
        "doc_id",
        (F.floor(F.col("ordinal") / 40) + 1).cast("int").alias("page_number"),
        "ordinal",
        F.when(F.length("line") < 40, "HEADING").otherwise("PARAGRAPH").alias("unit_type"),
        F.col("line").alias("text"),
    )
    return I.resolve_title(docs, rows)


@query("d3_resolve_title", f"WITH {TITLE_UNITS} SELECT doc_id, title, title_rule FROM resolved")
def d3(t):
    return titles(t)


# Documents one by one, in order; the state is the map from each registered DOI to its paper's title.
@query("d2_resolve_papers", f"""WITH RECURSIVE {TITLE_UNITS},
n AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, CASE WHEN n_chars % 3 = 0 THEN concat('10.1/', cast(n_chars AS string)) END AS doi,
  trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize(title)), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM resolved),
step AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, NULL::VARCHAR AS work, MAP(['']::VARCHAR[], [NULL]::VARCHAR[]) AS dois
  UNION ALL SELECT n.i, n.doc_id, coalesce(dois[n.doi], n.title),
    CASE WHEN n.doi IS NULL OR dois[n.doi] IS NOT NULL OR list_contains(map_values(dois), n.title) THEN dois ELSE map_concat(dois, MAP([n.doi], [n.title])) END
  FROM step JOIN n ON n.i = step.i + 1)
SELECT n.doc_id, doi, title AS normalized_title, concat('pap_', substr(sha256(work), 1, 32)) AS paper_id, 'batch' AS matched_by
FROM n JOIN step USING (i)""")
def d2(t):
    docs = titles(t).join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id",
        "title",
        F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("10.1/"), F.col("n_chars"))).alias("doi"),
    )
    return I.resolve_papers(docs)


@query("d4_version_labels", """
WITH a AS (SELECT o_custkey AS paper_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
x AS (SELECT o_custkey AS paper_id, count(*) AS stored, list(DISTINCT o_orderkey % 9 + 1) AS taken FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1)
SELECT a.paper_id, o_orderkey, concat('v', list_filter(range(coalesce(stored, 0) + 1, coalesce(stored, 0) + k + 11), lambda n: NOT list_contains(coalesce(taken, []), n))[k]) AS version_label
FROM a LEFT JOIN x ON a.paper_id = x.paper_id""")
def d4(t):
    arrivals = t.orders.select(
        F.col("o_custkey").alias("paper_id"), F.struct("o_orderdate", "o_orderkey").alias("arrival")
    )
    existing = t.orders.where("o_orderkey % 7 = 0").select(
        F.col("o_custkey").alias("paper_id"), F.concat(F.lit("v"), F.col("o_orderkey") % 9 + 1).alias("version_label")
    )
    labelled = I.version_labels(arrivals, existing, F.trunc("arrival.o_orderdate", "month"))
    return labelled.select("paper_id", "arrival.o_orderkey", "version_label")


@query("d5_import_report", """
WITH i AS (SELECT doc_id, source, sha256(text) AS h, n_chars, CASE WHEN lang = 'es' THEN 'DISPATCH_TIMEOUT' WHEN lang = 'de' THEN 'EXTRACT_001' END AS err FROM documents),
known AS (SELECT DISTINCT h FROM i WHERE source = 'src0'), first_ok AS (SELECT h, min(doc_id) AS f FROM i WHERE err IS NULL GROUP BY h),
s AS (SELECT i.*, CASE WHEN known.h IS NOT NULL THEN 'DUPLICATE' WHEN starts_with(err, 'DISPATCH') THEN 'RETRYABLE' WHEN err IS NOT NULL THEN 'FAILED'
  WHEN doc_id <> f THEN 'DUPLICATE' ELSE 'IMPORTED' END AS state FROM i LEFT JOIN known ON i.h = known.h LEFT JOIN first_ok ON i.h = first_ok.h)
SELECT source AS batch_id, count(*) AS items, count(*) FILTER (WHERE state = 'IMPORTED') AS imported, count(*) FILTER (WHERE state = 'DUPLICATE') AS duplicate,
  count(*) FILTER (WHERE state = 'FAILED') AS failed, count(*) FILTER (WHERE state = 'RETRYABLE') AS retryable, cast(sum(n_chars) AS bigint) AS bytes
FROM s GROUP BY source""")
def d5(t):
    batch = t.documents.select(
        F.col("doc_id").alias("item_id"),
        F.col("source").alias("batch_id"),
        F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").alias("size_bytes"),
        F.when(F.col("lang") == "es", "DISPATCH_TIMEOUT").when(F.col("lang") == "de", "EXTRACT_001").alias("error_code"),
    )
    versions = t.documents.where("source = 'src0'").select(
        F.sha2("text", 256).alias("content_sha256"), F.col("doc_id").alias("paper_version_id")
    )
    return I.import_report(I.import_items(batch, versions))


KEYS = "concat('pdf/sha256/', substr(h, 1, 2), '/', h)"
STORED = f"""
d AS (SELECT doc_id, sha256(text) AS h, n_chars, lang, source FROM documents),
a AS MATERIALIZED (SELECT h, concat('ast_', h) AS asset_id, {KEYS} AS storage_key, max(n_chars) AS size_bytes FROM d GROUP BY h),
inv AS MATERIALIZED (SELECT {KEYS} AS storage_key, CASE WHEN max(source) = 'src7' THEN sha256('x') ELSE h END AS actual, max(n_chars) AS size_bytes FROM d
  GROUP BY h HAVING max(lang) <> 'es' UNION ALL SELECT concat('temp/', cast(doc_id AS string)), h, n_chars FROM d WHERE source = 'src3')"""


def stored(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), "n_chars", "lang", "source")
    key = F.concat(F.lit("pdf/sha256/"), F.substring("h", 1, 2), F.lit("/"), "h")
    grouped = d.groupBy("h").agg(
        F.max("lang").alias("lang"), F.max("source").alias("source"), F.max("n_chars").alias("size_bytes")
    )
    assets = grouped.select(
        F.concat(F.lit("ast_"), "h").alias("asset_id"), key.alias("storage_key"), F.col("h").alias("sha256"), "size_bytes"
    )
    inventory = grouped.where("lang <> 'es'").select(
        key.alias("storage_key"),
        F.when(F.col("source") == "src7", F.sha2(F.lit("x"), 256)).otherwise(F.col("h")).alias("actual_sha256"),
        "size_bytes",
    ).unionByName(
        d.where("source = 'src3'").select(
            F.concat(F.lit("temp/"), F.col("doc_id")).alias("storage_key"), F.col("h").alias("actual_sha256"), F.col("n_chars").alias("size_bytes")
        )
    )
    return assets, inventory


@query("d6_content_dedup_report", f"""WITH {STORED}
SELECT (SELECT count(*) FROM a) AS assets_total, (SELECT cast(sum(size_bytes) AS bigint) FROM a) AS assets_bytes,
  count(*) AS duplicate_objects, cast(coalesce(sum(size_bytes), 0) AS bigint) AS duplicate_bytes, coalesce(sum(size_bytes), 0) = 0 AS dedup_effective
FROM inv WHERE storage_key NOT IN (SELECT storage_key FROM a)""")
def d6(t):
    return I.content_dedup_report(*stored(t))


@query("d14_integrity_check", f"""WITH {STORED}
SELECT coalesce(a.storage_key, inv.storage_key) AS storage_key, a.asset_id, CASE WHEN a.asset_id IS NULL THEN 'UNKNOWN_OBJECT'
  WHEN actual IS NULL THEN 'MISSING_OBJECT' WHEN actual <> a.h THEN 'OBJECT_MISMATCH' ELSE 'OK' END AS status
FROM a FULL JOIN inv ON a.storage_key = inv.storage_key""")
def d14(t):
    found, inventory = stored(t)
    versions = found.select("asset_id", F.col("sha256").alias("content_sha256"))
    return I.integrity_check(inventory, found, versions)


@query("d11_idempotency_keys", """
SELECT concat(task_type, ':', substr(sha256(concat(task_type, '|', cast(job_id AS string), '|', cast(stage_no AS string))), 1, 40)) AS idempotency_key,
  min(task_id) AS first_task, count(*) - 1 AS reused FROM tasks GROUP BY task_type, job_id, stage_no""")
def d11(t):
    keyed = I.task_keys(t.tasks, ["task_type", "job_id", "stage_no"])
    return I.first_dispatch(keyed, ["task_id"]).select(
        "idempotency_key", F.col("first.task_id").alias("first_task"), "reused"
    )


@query("s6_upsert_new", """
SELECT 'new' AS outcome, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) q
UNION ALL SELECT 'reused', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) q""")
def s6(t):
    target = t.lineitem.join(
        t.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"
    )
    new, reused = writers.split_new(t.lineitem, target, ["l_orderkey", "l_linenumber"])
    return new.agg(F.count("*").alias("n")).select(F.lit("new").alias("outcome"), "n").unionByName(
        reused.agg(F.count("*").alias("n")).select(F.lit("reused").alias("outcome"), "n")
    )


@query("s7_delete_version", "SELECT evidence_id FROM evidence WHERE paper_version_id NOT IN (SELECT paper_version_id FROM paper_versions WHERE version_no = 1)")
def s7(t):
    return writers.delete_version(t.evidence, t.paper_versions.where("version_no = 1")).select("evidence_id")


@query("d10_normalize", """
SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(t), 'ß', 'ss'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title,
  trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(t)), 'ß', 'ss'), '[^\\p{L}\\p{N}_\\s-]', ' ', 'g'), '[\\s_/\\\\]+', '-', 'g'), '-{2,}', '-', 'g'), '-') AS tag,
  trim(regexp_replace(replace(lower(trim(t)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS entity
FROM (SELECT doc_id, text AS t FROM documents) q""")
def d10(t):
    return t.documents.select(
        "doc_id",
        X.normalize_title(F.col("text")).alias("title"),
        X.normalize_tag(F.col("text")).alias("tag"),
        X.normalize_entity(F.col("text")).alias("entity"),
    )
