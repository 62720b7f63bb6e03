"""Verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import audit, overlap, verify
from evidentia.plans import duck
from evidentia.plans.registry import query
from evidentia.tables import VERIFIERS


def facts(t):
    prepared = verify.prepare(t.claims)
    return verify.with_facts(prepared, t.claim_evidence, t.evidence)


# One row per claim with what its links say, as plain SQL.
FACTS = f"""
WITH prep AS MATERIALIZED (
  SELECT *, {duck.tokens('statement')} AS tokens, {duck.numbers('statement')} AS numbers FROM claims),
cited AS MATERIALIZED (
  SELECT l.claim_id, string_agg(e.text, ' ') AS body, count(*) AS links, count(e.evidence_id) AS resolved,
    min(CASE WHEN e.evidence_id IS NULL THEN l.evidence_id END) AS first_missing,
    coalesce(bool_or(source_method = 'OCR'), false) AS ocr_sourced,
    count(*) FILTER (WHERE source_method = 'OCR' AND (ocr_confidence IS NULL OR ocr_confidence < 0.9)) AS low_rows,
    list_distinct(list(section_class)) AS classes
  FROM claim_evidence l LEFT JOIN evidence e ON l.evidence_id = e.evidence_id GROUP BY l.claim_id),
facts AS MATERIALIZED (
  SELECT p.*, coalesce(links, 0) AS links, coalesce(resolved, 0) AS resolved, first_missing,
    coalesce(ocr_sourced, false) AS ocr_sourced, coalesce(low_rows, 0) AS low_rows, classes,
    coalesce(body, '') AS body, replace(coalesce(body, ''), ',', '') AS flat
  FROM prep p LEFT JOIN cited c ON p.claim_id = c.claim_id),
checked AS MATERIALIZED (
  SELECT *, len(list_filter(tokens, lambda w: contains(lower(body), w))) AS token_hits,
    list_filter(numbers, lambda n: NOT contains(flat, n)) AS absent,
    list_filter(list_filter(numbers, lambda n: NOT contains(flat, n)), lambda n:
      len(list_filter({duck.numbers('flat')}, lambda c: length(c) = length(n) AND hamming(c, n) = 1)) > 0) AS near
  FROM facts)
"""
# hamming() needs equal lengths, so it is applied through a guarded form.
FACTS = FACTS.replace("length(c) = length(n) AND hamming(c, n) = 1",
                      "CASE WHEN length(c) = length(n) THEN hamming(c, n) = 1 ELSE false END")


@query("v1_existence", FACTS + """
SELECT claim_id, CASE WHEN links = 0 OR links > resolved THEN 'FAIL' ELSE 'PASS' END AS verdict,
  links - resolved AS missing, first_missing FROM checked""")
def v1(t):
    f = facts(t)
    return verify.existence(f).select(
        "claim_id",
        "verdict",
        F.col("details")["missing"].cast("long").alias("missing"),
        F.col("details")["first_missing"].alias("first_missing"),
    )


@query("v2_citation", FACTS + """
SELECT claim_id, CASE WHEN resolved = 0 THEN 'FAIL' WHEN len(tokens) = 0 THEN 'WARN'
  WHEN token_hits / len(tokens) >= 0.5 THEN 'PASS' WHEN token_hits / len(tokens) >= 0.25 THEN 'WARN'
  ELSE 'FAIL' END AS verdict, token_hits, len(tokens) AS token_total FROM checked""")
def v2(t):
    return verify.citation(facts(t)).select(
        "claim_id",
        "verdict",
        F.col("details")["token_hits"].cast("long").alias("token_hits"),
        F.col("details")["token_total"].cast("long").alias("token_total"),
    )


@query("v3_numeric", FACTS + """
SELECT claim_id, CASE WHEN len(absent) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict,
  CASE WHEN len(near) > 0 AND ocr_sourced THEN 'ocr_digit_corruption' WHEN len(near) > 0
    THEN 'numeric_mismatch' WHEN len(absent) > 0 THEN 'invented_number' END AS kind,
  array_to_string(absent, ' ') AS absent FROM checked""")
def v3(t):
    return verify.numeric(facts(t)).select(
        "claim_id",
        "verdict",
        F.col("details")["kind"].alias("kind"),
        F.col("details")["absent"].alias("absent"),
    )


@query("v4_claim_scope", FACTS + f"""
SELECT claim_id, CASE WHEN loose AND hypothesis THEN 'FAIL' WHEN loose THEN 'WARN'
    WHEN unequal THEN 'FAIL' ELSE 'PASS' END AS verdict
FROM (SELECT claim_id, regexp_matches(body, {duck.quote(X.HYPOTHESIS)}) AS hypothesis,
  starts_with(category, 'result.') AND claim_type = 'FACT'
    AND NOT coalesce(list_has_any(classes, ['RESULT', 'EXPERIMENT']), false) AS loose,
  regexp_matches(statement, {duck.quote(X.COMPARATIVE)})
    AND regexp_matches(body, {duck.quote(X.BUDGET_DISPARITY)}) AS unequal FROM checked) q""")
def v4(t):
    return verify.claim_scope(facts(t)).select("claim_id", "verdict")


PAIRS = f"""
WITH prep AS MATERIALIZED (
  SELECT *, {duck.tokens('statement')} AS tokens, {duck.numbers('statement')} AS numbers FROM claims),
words AS MATERIALIZED (SELECT claim_id, paper_version_id, unnest(tokens) AS w FROM prep),
pairs AS MATERIALIZED (
  SELECT a.claim_id AS a_id, b.claim_id AS b_id, count(*) AS shared
  FROM words a JOIN words b ON a.paper_version_id = b.paper_version_id AND a.w = b.w
    AND a.claim_id <> b.claim_id
  GROUP BY a.claim_id, b.claim_id),
near_claims AS MATERIALIZED (
  SELECT a.claim_id, a.numbers AS a_numbers, b.claim_id AS b_id, b.numbers AS b_numbers,
    a.run_id AS a_run, b.run_id AS b_run, b.created_at AS b_at, b.claim_type AS b_type
  FROM pairs JOIN prep a ON a.claim_id = a_id JOIN prep b ON b.claim_id = b_id
  WHERE shared >= greatest(2, len(a.tokens) // 2))
"""


@query("v5_contradiction", PAIRS + """
SELECT p.claim_id, CASE WHEN conflicting_claim_id IS NULL THEN 'PASS' ELSE 'FAIL' END AS verdict,
  conflicting_claim_id
FROM prep p LEFT JOIN (SELECT claim_id, arg_min(b_id, (b_at, b_id)) AS conflicting_claim_id
  FROM near_claims WHERE len(a_numbers) > 0 AND len(b_numbers) > 0 AND a_numbers <> b_numbers
  GROUP BY claim_id) c ON p.claim_id = c.claim_id""")
def v5(t):
    return verify.contradiction(verify.prepare(t.claims)).select(
        "claim_id", "verdict", F.col("details")["conflicting_claim_id"].alias("conflicting_claim_id")
    )


@query("v16_counter_evidence", PAIRS + """
SELECT c.claim_id, c.rival_id, e.evidence_id FROM (SELECT claim_id, arg_min(b_id, (b_at, b_id)) AS rival_id
  FROM near_claims WHERE len(a_numbers) > 0 AND len(b_numbers) > 0 AND a_numbers <> b_numbers GROUP BY claim_id) c
JOIN claim_evidence e ON e.claim_id = c.rival_id""")
def v16_counter(t):
    """Evidence that the contradicting claims cite."""
    verdicts = verify.contradiction(verify.prepare(t.claims))
    return audit.counter_claims(verdicts, t.claim_evidence).select("claim_id", "rival_id", "evidence_id")


@query("v6_consensus", PAIRS + """
SELECT p.claim_id, CASE WHEN coalesce(n, 0) = 0 THEN 'INCONCLUSIVE' WHEN rival IS NOT NULL THEN 'FAIL'
  ELSE 'PASS' END AS verdict, coalesce(n, 0) AS independent_count, rival AS disagreeing_claim_id
FROM prep p LEFT JOIN (SELECT claim_id, count(*) AS n,
  arg_min(b_id, (b_at, b_id)) FILTER (WHERE len(a_numbers) > 0 AND len(b_numbers) > 0
    AND a_numbers <> b_numbers) AS rival
  FROM near_claims WHERE a_run <> b_run GROUP BY claim_id) c ON p.claim_id = c.claim_id""")
def v6(t):
    return verify.consensus(verify.prepare(t.claims)).select(
        "claim_id",
        "verdict",
        F.col("details")["independent_count"].cast("long").alias("independent_count"),
        F.col("details")["disagreeing_claim_id"].alias("disagreeing_claim_id"),
    )


@query("v7_falsification", PAIRS + """
, countered AS (SELECT DISTINCT claim_id FROM claim_evidence WHERE role = 'COUNTER_EVIDENCE'),
with_self AS (SELECT claim_id, b_id, b_at, b_type FROM near_claims UNION ALL
  SELECT claim_id, claim_id, created_at, claim_type FROM prep WHERE len(tokens) >= 2)
SELECT p.claim_id, CASE WHEN critique_claim_id IS NULL THEN 'PASS' ELSE 'WARN' END AS verdict,
  critique_claim_id
FROM prep p LEFT JOIN (SELECT o.claim_id, arg_min(b_id, (b_at, b_id)) AS critique_claim_id
  FROM with_self o WHERE b_type = 'CRITIQUE' AND b_id IN (SELECT claim_id FROM countered)
  GROUP BY o.claim_id) c ON p.claim_id = c.claim_id""")
def v7(t):
    return verify.falsification(verify.prepare(t.claims), t.claim_evidence).select(
        "claim_id", "verdict", F.col("details")["critique_claim_id"].alias("critique_claim_id")
    )


@query("v8_ocr_sensitivity", FACTS + """
SELECT claim_id, CASE WHEN low_rows > 0 AND len(numbers) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict,
  low_rows FROM checked""")
def v8(t):
    return verify.ocr_sensitivity(facts(t)).select(
        "claim_id", "verdict", F.col("details")["low_rows"].cast("long").alias("low_rows")
    )


def works(t):
    """Parts stand for the known external works."""
    return t.part.select(
        F.col("p_partkey").alias("work_id"),
        F.concat(
            F.lit("part-"), "p_partkey", F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_partkey"
        ).alias("title"),
    )


@query("v9_novelty", f"""
WITH works AS MATERIALIZED (SELECT work_id, {duck.tokens('title')} AS wt FROM (SELECT p_partkey AS work_id,
  concat('part-', p_partkey, ' ', replace(p_name, ' ', '-'), '-', p_partkey) AS title FROM part) q),
asserting AS MATERIALIZED (SELECT claim_id, list_filter({duck.tokens('statement')},
  lambda w: NOT list_contains([{duck.in_list(verify.NOVELTY_FILLER)}], w)) AS ct
  FROM claims WHERE claim_type <> 'EXTERNAL' AND regexp_matches(statement, {duck.quote(X.NOVELTY)})),
pairs AS (SELECT claim_id, work_id, count(*) AS shared, any_value(n) AS n
  FROM (SELECT claim_id, len(ct) AS n, unnest(ct) AS w FROM asserting) a
  JOIN (SELECT work_id, unnest(wt) AS w FROM works) b ON a.w = b.w GROUP BY claim_id, work_id),
hits AS (SELECT claim_id, count(*) AS candidates, min(work_id) AS first_work FROM pairs
  WHERE shared >= 2 AND shared / n >= 0.5 GROUP BY claim_id)
SELECT c.claim_id, CASE WHEN candidates IS NULL THEN 'INCONCLUSIVE' ELSE 'WARN' END AS verdict,
  candidates, first_work FROM claims c LEFT JOIN hits h ON c.claim_id = h.claim_id""")
def v9(t):
    return verify.novelty(t.claims, works(t)).select(
        "claim_id",
        "verdict",
        F.col("details")["candidates"].cast("long").alias("candidates"),
        F.col("details")["first_work"].cast("long").alias("first_work"),
    )


# Verdicts of the four evidence checks, as SQL.
BASIC = FACTS + f""",
judged AS MATERIALIZED (
  SELECT claim_id, support_state, CASE WHEN links = 0 OR links > resolved THEN 'FAIL' ELSE 'PASS' END AS existence,
    CASE WHEN resolved = 0 THEN 'FAIL' WHEN len(tokens) = 0 THEN 'WARN' WHEN token_hits / len(tokens) >= 0.5
      THEN 'PASS' WHEN token_hits / len(tokens) >= 0.25 THEN 'WARN' ELSE 'FAIL' END AS citation,
    CASE WHEN len(absent) > 0 THEN 'FAIL' ELSE 'PASS' END AS num,
    CASE WHEN loose AND hypothesis THEN 'FAIL' WHEN loose THEN 'WARN' WHEN unequal THEN 'FAIL' ELSE 'PASS' END AS scope
  FROM (SELECT *, regexp_matches(body, {duck.quote(X.HYPOTHESIS)}) AS hypothesis,
    starts_with(category, 'result.') AND claim_type = 'FACT'
      AND NOT coalesce(list_has_any(classes, ['RESULT', 'EXPERIMENT']), false) AS loose,
    regexp_matches(statement, {duck.quote(X.COMPARATIVE)})
      AND regexp_matches(body, {duck.quote(X.BUDGET_DISPARITY)}) AS unequal FROM checked) q),
states AS MATERIALIZED (SELECT claim_id, support_state, CASE
  WHEN 'FAIL' IN (existence, citation, num, scope) THEN 'UNSUPPORTED'
  WHEN 'WARN' IN (existence, citation, num, scope) THEN 'PARTIALLY_SUPPORTED' ELSE 'SUPPORTED' END AS new_state
  FROM judged)
"""


def full_tier(t, tier="T2_FULL"):
    return verify.verify(t.claims, t.claim_evidence, t.evidence, tier)


@query("v11_verify_full_tier", BASIC + """
SELECT claim_id, unnest(['verification.evidence_existence', 'verification.citation', 'verification.numeric',
  'verification.claim_scope']) AS verifier_type, unnest([existence, citation, num, scope]) AS verdict FROM judged""")
def v11(t):
    return full_tier(t).select("claim_id", "verifier_type", "verdict")


@query("v12_support_state", BASIC + "SELECT claim_id, new_state AS support_state FROM states")
def v12(t):
    return verify.support_state(full_tier(t))


@query("v13_transitions", BASIC + """
SELECT support_state, new_state, count(*) AS claims,
  count(*) FILTER (WHERE support_state <> new_state) AS changed
FROM states GROUP BY support_state, new_state""")
def v13(t):
    return verify.transitions(t.claims, full_tier(t))


NOVEL = f"""
works AS MATERIALIZED (SELECT work_id, {duck.tokens('title')} AS wt FROM (SELECT p_partkey AS work_id,
  concat('part-', p_partkey, ' ', replace(p_name, ' ', '-'), '-', p_partkey) AS title FROM part) q),
asserting AS (SELECT claim_id, list_filter({duck.tokens('statement')},
  lambda w: NOT list_contains([{duck.in_list(verify.NOVELTY_FILLER)}], w)) AS ct
  FROM claims WHERE claim_type <> 'EXTERNAL' AND regexp_matches(statement, {duck.quote(X.NOVELTY)})),
novel AS MATERIALIZED (SELECT DISTINCT claim_id FROM (SELECT claim_id, work_id, count(*) AS shared, any_value(n) AS n
  FROM (SELECT claim_id, len(ct) AS n, unnest(ct) AS w FROM asserting) a
  JOIN (SELECT work_id, unnest(wt) AS w FROM works) b ON a.w = b.w GROUP BY claim_id, work_id) p WHERE shared >= 2 AND shared / n >= 0.5)"""
PEERS = PAIRS[PAIRS.index("words AS MATERIALIZED"):]
DEEP = BASIC.rstrip() + ",\n" + PEERS.rstrip() + "," + NOVEL + """,
countered AS (SELECT DISTINCT claim_id FROM claim_evidence WHERE role = 'COUNTER_EVIDENCE'),
pressed AS (SELECT claim_id FROM near_claims WHERE b_type = 'CRITIQUE' AND b_id IN (SELECT claim_id FROM countered)
  UNION SELECT claim_id FROM prep WHERE claim_type = 'CRITIQUE' AND len(tokens) >= 2 AND claim_id IN (SELECT claim_id FROM countered)),
against AS (SELECT DISTINCT claim_id FROM near_claims WHERE len(a_numbers) > 0 AND len(b_numbers) > 0 AND a_numbers <> b_numbers),
others AS (SELECT claim_id, bool_or(len(a_numbers) > 0 AND len(b_numbers) > 0 AND a_numbers <> b_numbers) AS differs FROM near_claims WHERE a_run <> b_run GROUP BY 1),
deep AS MATERIALIZED (SELECT j.claim_id, [existence, citation, num, scope, CASE WHEN a.claim_id IS NULL THEN 'PASS' ELSE 'FAIL' END,
    CASE WHEN o.claim_id IS NULL THEN 'INCONCLUSIVE' WHEN differs THEN 'FAIL' ELSE 'PASS' END, CASE WHEN p.claim_id IS NULL THEN 'PASS' ELSE 'WARN' END,
    CASE WHEN c.low_rows > 0 AND len(c.numbers) > 0 THEN 'WARN' ELSE 'PASS' END, CASE WHEN n.claim_id IS NULL THEN 'INCONCLUSIVE' ELSE 'WARN' END] AS v
  FROM judged j JOIN checked c ON c.claim_id = j.claim_id LEFT JOIN against a ON a.claim_id = j.claim_id LEFT JOIN others o ON o.claim_id = j.claim_id
  LEFT JOIN pressed p ON p.claim_id = j.claim_id LEFT JOIN novel n ON n.claim_id = j.claim_id)
"""


@query("v11_verify_deep_tier", DEEP + f"""
SELECT verifier_type, verdict, count(*) AS claims FROM (SELECT unnest([{duck.in_list(VERIFIERS)}]) AS verifier_type, unnest(v) AS verdict FROM deep) q GROUP BY 1, 2""")
def v11_deep(t):
    verdicts = verify.verify(t.claims, t.claim_evidence, t.evidence, "T3_DEEP", works(t))
    return verdicts.groupBy("verifier_type", "verdict").agg(F.count("*").alias("claims"))


@query("v12_deep_support_state", DEEP + """
SELECT claim_id, CASE WHEN v[5] = 'FAIL' OR v[6] = 'FAIL' THEN 'DISPUTED' WHEN list_contains(v, 'FAIL') THEN 'UNSUPPORTED' WHEN list_contains(v, 'WARN') THEN 'PARTIALLY_SUPPORTED'
  WHEN list_contains(v, 'PASS') THEN 'SUPPORTED' ELSE 'INSUFFICIENT_EVIDENCE' END AS support_state FROM deep""")
def v12_deep(t):
    return verify.support_state(
        verify.verify(t.claims, t.claim_evidence, t.evidence, "T3_DEEP", works(t))
    )


@query("v10_external", """
SELECT s_suppkey AS supplier, k AS field, CASE WHEN k = 'title' OR s_acctbal > 3000 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM supplier, (SELECT unnest(['title', 'year']) AS k) q""")
def v10(t):
    """Supplier records as stored sources; some stated years differ from the source."""
    base = t.supplier.select("*", F.explode(F.array(F.lit("title"), F.lit("year"))).alias("field"))
    year = F.lit(1990) + F.col("s_nationkey")
    stated = F.when(F.col("s_acctbal") > 3000, year).otherwise(year + 1)
    cid = F.concat_ws("/", "s_suppkey", "field")
    claims = base.select(
        cid.alias("claim_id"),
        F.lit("EXTERNAL").alias("claim_type"),
        F.when(F.col("field") == "title", F.concat(F.lit('title: "'), "s_name", F.lit('"')))
        .otherwise(F.concat(F.lit("year: "), stated))
        .alias("statement"),
    )
    provenances = base.select(
        F.concat(F.lit("prov/"), cid).alias("provenance_id"),
        cid.alias("claim_id"),
        F.lit("mock").alias("source_provider"),
        F.col("s_name").alias("source_identifier"),
        F.lit("2024-01-01").cast("timestamp").alias("retrieved_at"),
        F.sha2("s_name", 256).alias("content_hash"),
        F.to_json(F.struct(F.col("s_name").alias("title"), year.alias("year"))).alias("citation_text"),
    )
    return verify.external(claims, provenances).select(
        F.split_part("claim_id", F.lit("/"), F.lit(1)).cast("long").alias("supplier"),
        F.split_part("claim_id", F.lit("/"), F.lit(2)).alias("field"),
        "verdict",
    )


@query("j6_overlap_edges", f"""
WITH subjects AS MATERIALIZED (SELECT DISTINCT paper_version_id,
  array_to_string({duck.tokens('statement')}, ' ') AS subject FROM claims),
words AS MATERIALIZED (SELECT *, unnest(string_split(subject, ' ')) AS w FROM subjects WHERE subject <> ''),
pairs AS (SELECT a.paper_version_id, a.subject, b.subject AS other, count(*) AS shared
  FROM words a JOIN words b ON a.paper_version_id = b.paper_version_id AND a.w = b.w
  GROUP BY a.paper_version_id, a.subject, b.subject)
SELECT paper_version_id, subject, other, shared FROM pairs
WHERE shared >= greatest(2, len(string_split(subject, ' ')) // 2)""")
def j6(t):
    return overlap.overlap_edges(verify.prepare(t.claims), ["paper_version_id"], sift=True).withColumn(
        "shared", F.size("shared").cast("long")
    )
