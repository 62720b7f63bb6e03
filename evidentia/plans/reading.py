"""Queries over audit and library operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia import tables as C
from evidentia.functions import text as X
from evidentia.operators import audit as A
from evidentia.operators import evidence as E
from evidentia.operators import keyed as K
from evidentia.operators import library as L
from evidentia.plans import duck
from evidentia.plans.registry import query


@query("j8_claim_trail", """
SELECT c.claim_id, c.run_id, r.agent_type, l.evidence_id, e.page_start, l.evidence_id IS NOT NULL AND e.evidence_id IS NULL AS missing
FROM claims c LEFT JOIN runs r ON c.run_id = r.run_id LEFT JOIN claim_evidence l ON c.claim_id = l.claim_id
LEFT JOIN evidence e ON l.evidence_id = e.evidence_id""")
def j8(t):
    return A.claim_trail(t.claims, t.claim_evidence, t.evidence, t.runs).select(
        "claim_id", "run_id", "agent_type", "evidence_id", "page_start", "missing"
    )


@query("v14_claim_audit", """
SELECT claim_id, evidence_links, missing_evidence, verification_count, missing_evidence = 0 AND verification_count > 0 AND evidence_links > 0 AS complete
FROM (SELECT c.claim_id, coalesce(n, 0) AS evidence_links, coalesce(m, 0) AS missing_evidence, coalesce(v, 0) AS verification_count FROM claims c
LEFT JOIN (SELECT l.claim_id, count(*) AS n, count(*) FILTER (WHERE e.evidence_id IS NULL) AS m FROM claim_evidence l
  LEFT JOIN evidence e ON l.evidence_id = e.evidence_id GROUP BY 1) a ON c.claim_id = a.claim_id
LEFT JOIN (SELECT claim_id, count(*) AS v FROM verifications GROUP BY 1) b ON c.claim_id = b.claim_id) q""")
def v14(t):
    return A.claim_audit(t.claims, t.claim_evidence, t.evidence, t.runs, t.verifications).select(
        "claim_id", "evidence_links", "missing_evidence", "verification_count", "complete"
    )


QUALITY = ("CASE WHEN source_method = 'OCR' AND (ocr_confidence IS NULL OR ocr_confidence < 0.6)"
           " THEN 'DEGRADED' ELSE 'GOOD' END")


def quality(t):
    return t.evidence.withColumn(
        "quality_state", X.unit_quality(F.col("source_method"), F.col("ocr_confidence"))
    )


@query("v15_version_audit", f"""
WITH latest AS (SELECT claim_id, verifier_type, arg_max(verdict, (created_at, verification_id)) AS verdict FROM verifications GROUP BY 1, 2),
v AS (SELECT claim_id, bool_or(verifier_type = 'verification.ocr_sensitivity' AND verdict <> 'PASS') AS v_ocr,
  bool_or(verifier_type = 'verification.numeric' AND verdict <> 'PASS') AS v_num,
  bool_or(verifier_type IN ('verification.independent_consensus', 'verification.contradiction') AND verdict <> 'PASS') AS v_dis,
  bool_or(verdict = 'FAIL') AS v_fail FROM latest GROUP BY 1),
weak AS (SELECT DISTINCT l.claim_id FROM claim_evidence l JOIN evidence e ON l.evidence_id = e.evidence_id
  WHERE source_method = 'OCR' AND ({QUALITY} = 'DEGRADED' OR ocr_confidence < 0.8)),
single AS (SELECT run_id FROM model_calls GROUP BY run_id HAVING count(DISTINCT concat(provider_id, model_id)) = 1),
f AS (SELECT c.*, coalesce(v_ocr, false) OR weak.claim_id IS NOT NULL AS ocr, coalesce(v_num, false) AS num, coalesce(v_dis, false) AS dis,
  coalesce(v_fail, false) AS fail, single.run_id IS NOT NULL AS one FROM claims c LEFT JOIN v ON c.claim_id = v.claim_id
  LEFT JOIN weak ON c.claim_id = weak.claim_id LEFT JOIN single ON c.run_id = single.run_id)
SELECT paper_version_id, count(*) AS claim_count, count(*) FILTER (WHERE support_state = 'SUPPORTED') AS verified_claims,
  count(*) FILTER (WHERE support_state IN ('UNSUPPORTED', 'INSUFFICIENT_EVIDENCE')) AS unsupported_claims, count(*) FILTER (WHERE ocr) AS ocr_sensitive_claims,
  count(*) FILTER (WHERE num) AS numeric_conflicts, count(*) FILTER (WHERE dis) AS agent_disagreements, count(*) FILTER (WHERE one) AS single_model_claims,
  count(*) FILTER (WHERE claim_type = 'EXTERNAL') AS external_inferences,
  count(*) FILTER (WHERE support_state IN ('DISPUTED', 'UNSUPPORTED', 'INSUFFICIENT_EVIDENCE') OR ocr OR fail) AS high_risk_claims,
  count(*) FILTER (WHERE support_state = 'DISPUTED') AS disputed_claims
FROM f GROUP BY 1""")
def v15(t):
    return A.version_audit(
        A.audit_sections(t.claims, t.claim_evidence, quality(t), t.verifications, t.model_calls)
    )


REVIEW = f"""
WITH checks AS (SELECT claim_id, count(*) FILTER (WHERE verdict <> 'PASS') AS problems,
  arg_min(verifier_type, (-epoch_us(created_at), verification_id)) FILTER (WHERE verdict <> 'PASS') AS worst FROM verifications GROUP BY 1),
dec AS (SELECT claim_id, arg_max(decision, (created_at, decision_id)) AS decision FROM review_decisions GROUP BY 1),
cnt AS (SELECT claim_id, count(*) AS n, count(*) FILTER (WHERE role = 'COUNTER_EVIDENCE') AS m FROM claim_evidence GROUP BY 1),
items AS (SELECT c.claim_id, canonical_title AS paper_title, CASE WHEN support_state IN ('DISPUTED', 'UNSUPPORTED') THEN 'HIGH' ELSE 'NORMAL' END AS impact,
  CASE WHEN problems IS NULL THEN 'NOT_VERIFIED' WHEN problems = 0 THEN 'SUPPORT_STATE' ELSE CASE worst {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.REVIEW_GROUPS.items())} END END AS review_group,
  coalesce(problems, 0) AS problems, coalesce(n, 0) AS evidence_count, coalesce(m, 0) AS counter_evidence_count, decision AS personal_decision,
  substr(sha256(concat_ws('|', c.claim_id, support_state, statement, strftime(c.created_at, '%Y-%m-%dT%H:%M:%S'), '')), 1, 16) AS claim_revision
FROM claims c LEFT JOIN checks ON c.claim_id = checks.claim_id LEFT JOIN dec ON c.claim_id = dec.claim_id LEFT JOIN cnt ON c.claim_id = cnt.claim_id
LEFT JOIN papers p ON c.paper_id = p.paper_id
WHERE support_state IN ({duck.in_list(C.RISKY_STATES)}) AND coalesce(decision, '') <> 'SEEN')
"""


def review(t):
    return A.review_items(t.claims, t.verifications, t.review_decisions, t.claim_evidence, t.papers)


@query("v16_review_items", REVIEW + "SELECT * FROM items")
def v16(t):
    return review(t).drop("paper_id", "paper_version_id")


@query("v16_review_page", REVIEW + "SELECT claim_id, impact, review_group FROM items ORDER BY impact <> 'HIGH', claim_id LIMIT 50 OFFSET 50")
def v16_page(t):
    return A.review_page(review(t), 50).select("claim_id", "impact", "review_group")


@query("v16_page_total", REVIEW + "SELECT claim_id, (SELECT count(*) FROM items) AS total FROM items ORDER BY impact <> 'HIGH', claim_id LIMIT 50 OFFSET 50")
def v16_total(t):
    return A.review_page(review(t), 50).select("claim_id", "total")


@query("w1_latest_verdicts", """
SELECT claim_id, verifier_type, arg_max(verdict, (created_at, verification_id)) AS verdict, max(created_at) AS created_at FROM verifications GROUP BY 1, 2""")
def w1(t):
    return A.latest_verdicts(t.verifications).drop("verification_id")


@query("w2_takeaways", """
SELECT paper_id, arg_max(claim_id, (created_at, claim_id)) AS claim_id, arg_max(statement, (created_at, claim_id)) AS statement
FROM claims WHERE category = 'result.main' GROUP BY 1""")
def w2(t):
    return L.takeaways(t.claims).select("paper_id", "claim_id", "statement")


@query("w3_evidence_context", """
WITH s AS (SELECT paper_version_id, evidence_id, page_start, section_class, CASE WHEN section_class IN ('RESULT', 'EXPERIMENT') THEN 0
    WHEN section_class IN ('TITLE', 'ABSTRACT') THEN 1 END AS band, concat('[', evidence_id, '] ', substr(text, 1, 900)) AS block FROM evidence),
r AS (SELECT *, row_number() OVER w AS rn, sum(length(block)) OVER (w ROWS UNBOUNDED PRECEDING) AS chars, count(*) OVER (PARTITION BY paper_version_id) AS n
  FROM s WHERE band IS NOT NULL WINDOW w AS (PARTITION BY paper_version_id ORDER BY band, page_start, evidence_id))
SELECT paper_version_id, count(*) AS units, string_agg(block, chr(10) || chr(10) ORDER BY rn) AS context, count(*) < max(n) AS truncated
FROM r WHERE rn <= 60 AND (rn = 1 OR chars <= 3000) GROUP BY 1""")
def w3(t):
    sections = t.evidence.select(
        "paper_version_id", "section_id", F.col("section_class").alias("normalized_class")
    ).distinct()
    return E.evidence_context(t.evidence, sections, ["RESULT", "EXPERIMENT"], max_chars=3000).withColumn(
        "units", F.col("units").cast("long")
    )


@query("w8_synthesis_lines", """
SELECT v.paper_version_id, line_no, line, CASE WHEN line IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE 'READY' END AS status FROM paper_versions v
LEFT JOIN (SELECT paper_version_id, row_number() OVER (PARTITION BY paper_version_id ORDER BY created_at, claim_id) AS line_no,
  concat('[', claim_id, '] (', claim_type, '/', category, ') ', statement) AS line FROM claims
  WHERE support_state IN ('SUPPORTED', 'PARTIALLY_SUPPORTED')) q ON v.paper_version_id = q.paper_version_id""")
def w8(t):
    return L.synthesis_lines(t.claims, t.paper_versions)


# ---- library ----------------------------------------------------------------


def order_papers(t):
    """Orders seen as library papers."""
    return t.orders.select(
        F.col("o_orderkey").alias("paper_id"),
        F.concat(F.lit("Order "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey")).alias("canonical_title"),
        F.lower(F.concat(F.lit("Order "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey"))).alias("normalized_title"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_custkey").alias("collection_id"),
    )


OP = """op AS (SELECT o_orderkey AS paper_id, concat('Order ', o_orderpriority, ' ', o_orderkey) AS canonical_title,
  lower(concat('Order ', o_orderpriority, ' ', o_orderkey)) AS normalized_title, o_orderdate AS created_at, o_custkey, o_orderstatus FROM orders)"""


def scope(t):
    personal = t.orders.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("paper_id"),
        F.when(F.col("o_orderstatus") == "F", "READ").otherwise("READING").alias("read_state"),
    )
    years = t.lineitem.select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_shipdate").alias("publication_date")
    )
    relations = t.relations
    return L.library_scope(
        order_papers(t),
        "urgent",
        years=(years, [1997, 1998]),
        entities=(relations, ["author_1", "author_2", "method_Brand#3"]),
        read_states=(personal, ["UNREAD", "READING"]),
    )


SCOPE = OP + """, scoped AS (SELECT * FROM op WHERE contains(lower(canonical_title), 'urgent')
  AND paper_id IN (SELECT l_orderkey FROM lineitem WHERE year(l_shipdate) IN (1997, 1998))
  AND paper_id IN (SELECT paper_id FROM relations WHERE source_entity_id IN ('author_1', 'author_2', 'method_Brand#3')
    OR target_entity_id IN ('author_1', 'author_2', 'method_Brand#3'))
  AND o_orderstatus IN ('P', 'O'))"""


@query("p7_library_scope", f"WITH {SCOPE} SELECT paper_id, canonical_title FROM scoped")
def p7(t):
    return scope(t).select("paper_id", "canonical_title")


@query("t1_library_page", f"WITH {OP} SELECT paper_id, created_at FROM op ORDER BY created_at DESC, paper_id LIMIT 51 OFFSET 100")
def t1(t):
    return L.library_page(order_papers(t), "RECENT", 100).select("paper_id", "created_at")


@query("t1_library_page_by_title", f"WITH {OP} SELECT paper_id, normalized_title FROM op ORDER BY normalized_title, paper_id LIMIT 101")
def t1_title(t):
    return L.library_page(order_papers(t), "TITLE", 0, L.MAX_PAGE).select("paper_id", "normalized_title")


@query("p8_claim_candidates", """
SELECT claim_id, created_at FROM claims WHERE paper_id IN (SELECT paper_id FROM collection_papers WHERE pinned)
  AND contains(lower(statement), 'outperforms') AND support_state IN ('DISPUTED', 'SUPPORTED') ORDER BY created_at DESC, claim_id LIMIT 50""")
def p8(t):
    return L.claim_candidates(
        t.claims, t.collection_papers.where("pinned"), "Outperforms", ["DISPUTED", "SUPPORTED"]
    ).select("claim_id", "created_at")


@query("p9_entity_search", """
SELECT entity_id, canonical_name FROM entities WHERE entity_type IN ('METHOD', 'AUTHOR') AND contains(lower(canonical_name), '1')
ORDER BY canonical_name, entity_id LIMIT 50""")
def p9(t):
    named = t.entities.withColumn("normalized_name", F.lower("canonical_name"))
    return L.entity_search(named, "1", ["METHOD", "AUTHOR"]).select("entity_id", "canonical_name")


def like_any(prefixes):
    return "(" + " OR ".join(f"starts_with(category, '{p}')" for p in prefixes) + ")"


@query("p10_module_split", f"""
WITH m AS ({' UNION ALL '.join(f"SELECT paper_version_id, '{n}' AS module FROM claims WHERE {like_any(p)}" for n, p in L.MODULES)}),
grid AS (SELECT paper_version_id, unnest([{duck.in_list(n for n, _ in L.MODULES)}]) AS module FROM paper_versions),
c AS (SELECT paper_version_id, module, count(*) AS n FROM m GROUP BY 1, 2)
SELECT g.paper_version_id, g.module, coalesce(n, 0) AS claims, CASE WHEN n IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS state
FROM grid g LEFT JOIN c ON g.paper_version_id = c.paper_version_id AND g.module = c.module""")
def p10(t):
    return L.module_split(t.claims, t.paper_versions)


TIER = "CASE s_nationkey % 4 WHEN 0 THEN 'T0_INDEX' WHEN 1 THEN 'T1_SCAN' WHEN 2 THEN 'T2_FULL' ELSE 'T3_DEEP' END"


@query("p11_stage_plan", f"""
WITH p AS (SELECT s_suppkey AS paper_id, {TIER} AS tier FROM supplier),
stage_of AS ({' UNION ALL '.join(f"SELECT '{t}' AS tier, '{s}' AS stage" for t, ss in C.TIER_STAGES.items() for s in ss)}),
steps AS ({' UNION ALL '.join(f"SELECT {i} AS stage_no, '{s}' AS stage" for i, s in enumerate(C.STAGES))})
SELECT paper_id, stage, stage_no, EXISTS (SELECT 1 FROM stage_of o WHERE o.tier = p.tier AND o.stage = steps.stage) AS allowed FROM p CROSS JOIN steps""")
def p11(t):
    return L.stage_plan(
        t.supplier.select(F.col("s_suppkey").alias("paper_id"), F.expr(TIER).alias("tier"))
    ).select("paper_id", "stage", "stage_no", "allowed")


SCANNING = ", ".join(repr(a) for a in C.SCAN_AGENTS)


def tiered(t):
    return t.supplier.select(F.col("s_suppkey").alias("paper_id"), F.expr(TIER).alias("tier"))


@query("p11_agent_plan", f"""
WITH p AS (SELECT s_suppkey AS paper_id, {TIER} AS tier FROM supplier), a AS (SELECT DISTINCT agent_type FROM runs),
x AS (SELECT *, tier IN ('T2_FULL', 'T3_DEEP') OR (tier = 'T1_SCAN' AND agent_type IN ({SCANNING})) AS allowed FROM p CROSS JOIN a)
SELECT paper_id, agent_type, allowed, CASE WHEN NOT allowed THEN concat('agent ', agent_type, ' requires ', CASE WHEN agent_type IN ({SCANNING}) THEN 'T1_SCAN' ELSE 'T2_FULL' END,
  '; this paper''s tier is ', tier) END AS reason FROM x""")
def p11_agents(t):
    return L.agent_plan(tiered(t), t.runs).drop("tier")


def by_tier(values: dict[str, int]) -> str:
    return "CASE tier " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


@query("p11_tier_budgets", f"""
WITH p AS (SELECT s_suppkey AS paper_id, {TIER} AS tier FROM supplier), o AS (SELECT DISTINCT paper_version_id, paper_id FROM paper_versions),
c AS (SELECT paper_id, max(n) AS n FROM (SELECT paper_version_id, count(*) AS n FROM claims GROUP BY 1) q JOIN o USING (paper_version_id) GROUP BY 1),
u AS (SELECT paper_id, max(n) AS n FROM (SELECT paper_version_id, count(*) AS n FROM evidence GROUP BY 1) q JOIN o USING (paper_version_id) GROUP BY 1),
x AS (SELECT p.paper_id, tier, coalesce(c.n, 0) AS claims, coalesce(u.n, 0) AS units, {by_tier(C.TIER_MAX_CLAIMS)} AS max_claims,
  {by_tier(C.TIER_CONTEXT_UNITS)} AS context_units, {by_tier(C.TIER_VERIFIER_COUNT)} AS verifiers
  FROM p LEFT JOIN c ON c.paper_id = p.paper_id LEFT JOIN u ON u.paper_id = p.paper_id)
SELECT *, list_filter([CASE WHEN claims > max_claims THEN 'claims' END, CASE WHEN units > context_units THEN 'context_units' END], lambda v: v IS NOT NULL) AS over FROM x""")
def p11_budgets(t):
    return L.tier_budgets(tiered(t), t.claims, t.evidence, t.paper_versions)


@query("p12_profile_claims", "SELECT claim_id FROM claims WHERE run_id IN (SELECT run_id FROM runs WHERE agent_type = 'agents.method')")
def p12(t):
    return L.profile_claims(t.claims, t.runs, "methods").select("claim_id")


@query("p13_notes", """
SELECT concat('n', conv_id, '_', turn) AS note_id, text AS body FROM conversations WHERE role = 'assistant'""")
def p13(t):
    rows = t.conversations.select(
        F.concat(F.lit("n"), "conv_id", F.lit("_"), "turn").alias("note_id"),
        F.col("role").alias("owner_id"),
        F.col("text").alias("body"),
        F.col("turn").alias("updated_at"),
    )
    return L.notes(rows, "assistant").select("note_id", "body")


@query("j9_techniques", "SELECT l_suppkey AS paper_id, p_partkey AS technique_id, p_name FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) b JOIN part ON l_partkey = p_partkey")
def j9(t):
    bridge = t.lineitem.select(
        F.col("l_suppkey").alias("paper_id"), F.col("l_partkey").alias("technique_id")
    ).distinct()
    techniques = t.part.select(F.col("p_partkey").alias("technique_id"), "p_name")
    return L.techniques_for_papers(techniques, bridge)


@query("j1_paper_tags", """
SELECT paper_id, g.namespace, g.canonical_name, is_candidate FROM paper_tags p JOIN tags g ON p.tag_id = g.tag_id WHERE NOT is_candidate""")
def j1(t):
    return (
        t.paper_tags.where("NOT is_candidate")
        .join(t.tags, "tag_id")
        .select("paper_id", "namespace", "canonical_name", "is_candidate")
    )


@query("j10_latest_verdict_join", """
SELECT c.claim_id, q.verdict, q.created_at FROM claims c LEFT JOIN (SELECT claim_id, arg_max(verdict, (created_at, verification_id)) AS verdict,
  max(created_at) AS created_at FROM verifications GROUP BY 1) q ON c.claim_id = q.claim_id""")
def j10(t):
    newest = K.latest_by(t.verifications, ["claim_id"], ["created_at", "verification_id"])
    return t.claims.select("claim_id").join(newest.select("claim_id", "verdict", "created_at"), "claim_id", "left")


# ---- aggregates -------------------------------------------------------------


@query("a2_audit_counts", """
SELECT paper_version_id, support_state, count(*) AS claims FROM claims GROUP BY ROLLUP (paper_version_id, support_state) HAVING paper_version_id IS NOT NULL""")
def a2(t):
    return L.audit_counts(t.claims)


@query("a3_evidence_counts", "SELECT claim_id, count(*) AS evidence_count FROM claim_evidence GROUP BY 1")
def a3(t):
    return L.evidence_counts(t.claim_evidence)


def counted_sql(table, column, name):
    return f"""(SELECT paper_version_id, list_sort(list(concat(k, '=', n))) AS {name} FROM (SELECT paper_version_id, {column} AS k, count(*) AS n
  FROM {table} GROUP BY 1, 2) q GROUP BY 1)"""


@query("a5_paper_context", f"""
SELECT v.paper_version_id, v.paper_id, coalesce(c.n, 0) AS claims, claims_by_state, categories, coalesce(e.n, 0) AS evidence, evidence_by_quality,
  evidence_by_method, coalesce(g.tags, 0) AS tags, coalesce(g.cand, 0) AS candidate_tags
FROM paper_versions v LEFT JOIN (SELECT paper_version_id, count(*) AS n, list_sort(list_distinct(list(category))) AS categories FROM claims GROUP BY 1) c
  ON v.paper_version_id = c.paper_version_id
LEFT JOIN {counted_sql('claims', 'support_state', 'claims_by_state')} cs ON v.paper_version_id = cs.paper_version_id
LEFT JOIN (SELECT paper_version_id, count(*) AS n FROM evidence GROUP BY 1) e ON v.paper_version_id = e.paper_version_id
LEFT JOIN {counted_sql('evidence', QUALITY, 'evidence_by_quality')} eq ON v.paper_version_id = eq.paper_version_id
LEFT JOIN {counted_sql('evidence', 'source_method', 'evidence_by_method')} em ON v.paper_version_id = em.paper_version_id
LEFT JOIN (SELECT paper_id, count(*) AS tags, count(*) FILTER (WHERE is_candidate) AS cand FROM paper_tags GROUP BY 1) g ON v.paper_id = g.paper_id""")
def a5(t):
    return L.paper_context(t.claims, quality(t), t.paper_tags, t.paper_versions)


@query("a6_paper_analysis", """
SELECT paper_version_id, category, claim_id, row_number() OVER (PARTITION BY paper_version_id, category ORDER BY created_at, claim_id) AS position FROM claims""")
def a6(t):
    return L.paper_analysis(t.claims).select("paper_version_id", "category", "claim_id", "position")


@query("a7_collection_stats", """
SELECT collection_id, count(*) AS papers, count(*) FILTER (WHERE pinned) AS pinned, count(priority_override_tier) AS overrides FROM collection_papers GROUP BY 1""")
def a7(t):
    return L.collection_stats(t.collection_papers)


DATED = """dated AS (SELECT paper_version_id, paper_id, min(created_at) AS publication_date, min(created_at) AS created_at FROM claims GROUP BY 1, 2)"""


def dated(t):
    return t.claims.groupBy("paper_version_id", "paper_id").agg(
        F.min("created_at").alias("publication_date"), F.min("created_at").alias("created_at")
    )


@query("a8_collection_workspace", f"""
WITH {DATED}, pv AS (SELECT paper_version_id, count(*) AS n, bool_or(support_state <> 'UNVERIFIED') AS done FROM claims GROUP BY 1)
SELECT m.collection_id, max(s.k) AS selected_papers, count(d.paper_version_id) AS versions, cast(coalesce(sum(n), 0) AS bigint) AS claims,
  count(*) FILTER (WHERE done) AS analyzed_versions, min(year(publication_date)) AS first_year, max(year(publication_date)) AS last_year
FROM collection_papers m JOIN (SELECT collection_id, count(*) AS k FROM collection_papers GROUP BY 1) s ON m.collection_id = s.collection_id
LEFT JOIN dated d ON m.paper_id = d.paper_id LEFT JOIN pv ON d.paper_version_id = pv.paper_version_id GROUP BY 1""")
def a8(t):
    return L.collection_workspace(t.collection_papers, dated(t), t.claims)


@query("a8_collection_insights", """
SELECT collection_id, rn - 1 AS position, claim_id, statement FROM (SELECT m.collection_id, claim_id, statement, row_number() OVER (PARTITION BY m.collection_id
  ORDER BY CASE support_state WHEN 'DISPUTED' THEN 0 ELSE 1 END, created_at, claim_id) AS rn
  FROM claims c JOIN collection_papers m ON c.paper_id = m.paper_id WHERE support_state IN ('DISPUTED', 'PARTIALLY_SUPPORTED')) q WHERE rn <= 6""")
def a8_insights(t):
    return L.collection_insights(t.collection_papers, t.paper_versions, t.claims).withColumn(
        "position", F.col("position").cast("long")
    )


@query("a9_compare_papers", """
WITH v AS (SELECT paper_id, max(paper_version_id) AS paper_version_id FROM paper_versions GROUP BY 1),
per AS (SELECT v.paper_id, category, count(*) AS claims, count(*) FILTER (WHERE support_state = 'SUPPORTED') AS supported
  FROM claims c JOIN v ON c.paper_version_id = v.paper_version_id GROUP BY 1, 2)
SELECT paper_id, category, claims, supported, count(*) OVER (PARTITION BY category) = (SELECT count(*) FROM v) AS shared FROM per""")
def a9(t):
    latest = t.paper_versions.groupBy("paper_id").agg(
        F.max("paper_version_id").alias("paper_version_id")
    )
    return L.compare_papers(t.claims, latest)


PROTOCOL = "CASE WHEN starts_with(category, 'method.') THEN 'p1' WHEN starts_with(category, 'result.') THEN concat('p', cast(run_id AS string)) END"


@query("a10_compare_versions", f"""
WITH v AS (SELECT paper_id AS comparison_id, paper_version_id FROM paper_versions),
grid AS (SELECT comparison_id, paper_version_id, unnest([{duck.in_list(n for n, _ in L.DIMENSIONS)}]) AS dimension FROM v),
m AS ({' UNION ALL '.join(f"SELECT paper_version_id, '{n}' AS dimension, created_at, claim_id, statement, {PROTOCOL} AS pk FROM claims WHERE {like_any(p)}" for n, p in L.DIMENSIONS)}),
f AS (SELECT paper_version_id, dimension, arg_min(claim_id, (created_at, claim_id)) AS claim_id, arg_min(statement, (created_at, claim_id)) AS value,
  arg_min(coalesce(pk, ''), (created_at, claim_id)) AS pk FROM m GROUP BY 1, 2),
c AS (SELECT g.comparison_id, g.paper_version_id, g.dimension, claim_id, value, nullif(pk, '') AS pk FROM grid g LEFT JOIN f ON g.paper_version_id = f.paper_version_id AND g.dimension = f.dimension),
s AS (SELECT comparison_id, dimension, count(DISTINCT coalesce(pk, '')) = 1 AS same_key FROM c GROUP BY 1, 2)
SELECT c.comparison_id, paper_version_id, c.dimension, claim_id, value, same_key AND pk IS NOT NULL AS comparable FROM c JOIN s ON c.dimension = s.dimension AND c.comparison_id = s.comparison_id""")
def a10(t):
    claims = t.claims.withColumn(
        "protocol_key",
        F.when(F.col("category").startswith("method."), "p1").when(
            F.col("category").startswith("result."), F.concat(F.lit("p"), "run_id")
        ),
    )
    versions = t.paper_versions.select(F.col("paper_id").alias("comparison_id"), "paper_version_id")
    return L.compare_versions(claims, versions).drop("reason")


@query("a21_paper_list", f"""
WITH {DATED}, page AS (SELECT paper_id, canonical_title FROM papers ORDER BY normalized_title, paper_id LIMIT 51),
latest AS (SELECT paper_id, arg_max(paper_version_id, (created_at, paper_version_id)) AS pv, arg_max(publication_date, (created_at, paper_version_id)) AS pd FROM dated GROUP BY 1),
best AS (SELECT paper_id, arg_max(claim_id, (created_at, claim_id)) AS claim_id, arg_max(statement, (created_at, claim_id)) AS takeaway FROM claims WHERE category = 'result.main' GROUP BY 1)
SELECT p.paper_id, pv AS paper_version_id, year(pd) AS year, coalesce(g.n, 0) AS tags, CASE WHEN s_acctbal > 0 THEN 'T1_SCAN' ELSE 'T2_FULL' END AS tier, takeaway,
  coalesce(e.n, 0) AS takeaway_evidence, CASE WHEN s_nationkey > 12 THEN 'READ' ELSE 'UNREAD' END AS read_state, coalesce(a.n, 0) AS claims, coalesce(a.d, 0) AS disputed
FROM page p JOIN latest l ON p.paper_id = l.paper_id JOIN supplier ON s_suppkey = p.paper_id LEFT JOIN (SELECT paper_id, count(*) AS n FROM paper_tags GROUP BY 1) g ON g.paper_id = p.paper_id
LEFT JOIN best b ON b.paper_id = p.paper_id LEFT JOIN (SELECT claim_id, count(*) AS n FROM claim_evidence GROUP BY 1) e ON e.claim_id = b.claim_id
LEFT JOIN (SELECT paper_version_id, count(*) AS n, count(*) FILTER (WHERE support_state = 'DISPUTED') AS d FROM claims GROUP BY 1) a ON a.paper_version_id = pv""")
def a21(t):
    page = L.library_page(t.papers, "TITLE")
    triage = t.supplier.select(
        F.col("s_suppkey").alias("paper_id"),
        F.col("s_suppkey").alias("triage_id"),
        F.lit(1).alias("created_at"),
        F.when(F.col("s_acctbal") > 0, "T1_SCAN").otherwise("T2_FULL").alias("effective_tier"),
    )
    personal = t.supplier.where("s_nationkey > 12").select(
        F.col("s_suppkey").alias("paper_id"), F.lit("READ").alias("read_state")
    )
    return L.paper_list(page, dated(t), t.paper_tags, triage, t.claims, t.claim_evidence, personal).drop("year_missing")


@query("a22_paper_summary", f"""
WITH {DATED} SELECT p.paper_id, canonical_title, arg_max(paper_version_id, (created_at, paper_version_id)) AS paper_version_id
FROM papers p LEFT JOIN dated d ON p.paper_id = d.paper_id GROUP BY 1, 2""")
def a22(t):
    return L.paper_summary(t.papers, dated(t)).select("paper_id", "canonical_title", "paper_version_id")


@query("a22_workspaces", """
WITH v AS (SELECT *, sha256(cast(paper_version_id AS string)) AS h FROM paper_versions)
SELECT v.paper_id, v.paper_version_id, count(claim_id) AS claims, count(DISTINCT run_id) AS runs,
  concat(substr(any_value(h), 1, 12), '-', count(claim_id), '-', count(DISTINCT run_id)) AS analysis_revision
FROM v LEFT JOIN claims c ON v.paper_version_id = c.paper_version_id GROUP BY 1, 2""")
def a22_workspace(t):
    versions = t.paper_versions.withColumn("content_sha256", F.sha2(F.col("paper_version_id").cast("string"), 256))
    return L.workspaces(versions, t.claims)
