"""Queries over tags, the graph and the corpus views."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia import tables as C
from evidentia.functions import text as X
from evidentia.operators import corpus as V
from evidentia.operators import graph as G
from evidentia.operators import tags as T
from evidentia.plans import duck
from evidentia.plans.registry import query

# ---- functions -------------------------------------------------------------------


@query("f1_statement_numbers", f"SELECT claim_id, {duck.numbers('statement')} AS numbers FROM claims")
def f1(t):
    return t.claims.select("claim_id", X.statement_numbers(F.col("statement")).alias("numbers"))


@query("f1_document_numbers", f"SELECT doc_id, {duck.numbers('text')} AS numbers FROM documents")
def f1_docs(t):
    return t.documents.select("doc_id", X.statement_numbers(F.col("text")).alias("numbers"))


@query("f2_significant_tokens", f"SELECT doc_id, {duck.tokens('text')} AS tokens FROM documents")
def f2(t):
    return t.documents.select("doc_id", X.significant_tokens(F.col("text")).alias("tokens"))


@query("f3_claim_subject", f"SELECT claim_id, {duck.subject('statement')} AS subject FROM claims")
def f3(t):
    return t.claims.select("claim_id", X.claim_subject(F.col("statement")).alias("subject"))


METRIC = """CASE WHEN regexp_extract(statement, '(\\d+(?:[.,]\\d+)?\\s*%?)', 1) = '' THEN substr(statement, 1, 60)
  ELSE coalesce(nullif(array_to_string(string_split(trim(regexp_replace(regexp_replace(substr(statement,
    instr(statement, regexp_extract(statement, '(\\d+(?:[.,]\\d+)?\\s*%?)', 1)) + length(regexp_extract(statement, '(\\d+(?:[.,]\\d+)?\\s*%?)', 1))),
    '^[ ,.;:]+|[ ,.;:]+$', '', 'g'), '\\s+', ' ', 'g')), ' ')[1:4], ' '), ''), substr(statement, 1, 60)) END"""


@query("f4_metric_phrase", f"SELECT claim_id, {METRIC} AS metric FROM claims")
def f4(t):
    return t.claims.select("claim_id", X.metric_phrase(F.col("statement")).alias("metric"))


@query("f5_one_character_apart", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN length(cast(l_partkey AS varchar)) = length(cast(l_suppkey AS varchar))
  THEN hamming(cast(l_partkey AS varchar), cast(l_suppkey AS varchar)) = 1 ELSE false END AS apart FROM lineitem""")
def f5(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        X.one_character_apart(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("apart"),
    )


@query("f6_wording_predicates", f"""
SELECT claim_id, regexp_matches(statement, {duck.quote(X.COMPARATIVE)}) AS comparative, regexp_matches(statement, {duck.quote(X.NOVELTY)}) AS novelty,
  regexp_matches(statement, {duck.quote(X.HYPOTHESIS)}) AS hypothesis, regexp_matches(statement, {duck.quote(X.BUDGET_DISPARITY)}) AS budget,
  regexp_matches(statement, {duck.quote(X.REFUSAL)}) AS refusal FROM claims""")
def f6(t):
    s = F.col("statement")
    return t.claims.select(
        "claim_id",
        s.rlike(X.COMPARATIVE).alias("comparative"),
        s.rlike(X.NOVELTY).alias("novelty"),
        s.rlike(X.HYPOTHESIS).alias("hypothesis"),
        s.rlike(X.BUDGET_DISPARITY).alias("budget"),
        s.rlike(X.REFUSAL).alias("refusal"),
    )


def prefix_case(column, pairs, other="NULL"):
    return "CASE " + " ".join(f"WHEN starts_with({column}, '{p}') THEN '{v}'" for p, v in pairs) + f" ELSE {other} END"


@query("f7_category_maps", f"""
SELECT claim_id, split_part(category, '.', 1) AS namespace, {prefix_case('category', C.CATEGORY_ENTITY)} AS entity_type,
  {prefix_case('category', C.CATEGORY_RELATION, "'RELATED_TO'")} AS relation_type FROM claims""")
def f7(t):
    c = F.col("category")
    return t.claims.select(
        "claim_id",
        X.category_namespace(c).alias("namespace"),
        X.entity_type_for(c).alias("entity_type"),
        X.relation_for(c).alias("relation_type"),
    )


@query("f8_unit_quality", """
SELECT evidence_id, CASE WHEN source_method = 'OCR' AND (ocr_confidence IS NULL OR ocr_confidence < 0.6) THEN 'DEGRADED' ELSE 'GOOD' END AS quality_state FROM evidence""")
def f8(t):
    return t.evidence.select(
        "evidence_id", X.unit_quality(F.col("source_method"), F.col("ocr_confidence")).alias("quality_state")
    )


@query("f9_durations", """
SELECT event_id, year(ts) AS year, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0 AS seconds FROM events""")
def f9(t):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return t.events.select(
        "event_id",
        F.year("ts").alias("year"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)) / 1000000.0).alias("seconds"),
    )


@query("f12_json_fields", """
SELECT event_id, cast(json_extract_string(props, '$.k') AS integer) AS k, json_extract_string(props, '$.k') = '69' AS is_69 FROM events""")
def f12(t):
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.get_json_object("props", "$.k") == "69").alias("is_69"),
    )


@query("f13_observed_metric", """
SELECT event_id, CASE WHEN value IS NULL OR event_id % 4 = 0 THEN 'UNKNOWN' WHEN epoch_us(TIMESTAMP '2024-01-16 00:00:00') - epoch_us(ts) > 300000000
  THEN 'STALE' ELSE 'FRESH' END AS state FROM events""")
def f13(t):
    now = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return t.events.select(
        "event_id",
        X.observed_state(F.col("value"), F.col("event_id") % 4, F.col("ts").cast("timestamp"), now).alias("state"),
    )


# ---- tags ------------------------------------------------------------------------


def aliases(t):
    return t.tags.where("namespace = 'method'").select(
        "tag_id", F.concat(F.lit("alias-of-"), F.regexp_replace("normalized_name", "#", "-")).alias("normalized_alias")
    )


NAMES = """names AS (SELECT CASE p_size % 4 WHEN 0 THEN 'Method' WHEN 1 THEN 'novelty' WHEN 2 THEN 'domain' ELSE 'bogus' END AS namespace,
  CASE WHEN p_partkey % 3 = 0 THEN concat('Alias of ', replace(lower(p_brand), '#', ' ')) WHEN p_partkey % 3 = 1 THEN '--' ELSE p_name END AS name FROM part)"""


@query("g1_resolve_tags", f"""
WITH {NAMES}, n AS (SELECT DISTINCT lower(trim(namespace)) AS namespace, name,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9_\\s-]', ' ', 'g'), '[\\s_/]+', '-', 'g'), '-{{2,}}', '-', 'g'), '-') AS normalized_name FROM names),
al AS (SELECT tag_id, namespace, concat('alias-of-', replace(normalized_name, '#', '-')) AS normalized_name FROM tags WHERE namespace = 'method')
SELECT n.namespace, n.name, n.normalized_name, CASE WHEN n.namespace = 'bogus' THEN 'unknown_namespace' WHEN n.normalized_name = '' THEN 'empty_name' END AS rejected,
  al.tag_id IS NOT NULL AS matched_alias, CASE WHEN n.namespace <> 'bogus' AND n.normalized_name <> '' THEN coalesce(al.tag_id, concat(n.namespace, '/', n.normalized_name)) END AS tag_id
FROM n LEFT JOIN al ON n.namespace = al.namespace AND n.normalized_name = al.normalized_name""")
def g1(t):
    names = t.part.select(
        F.expr("CASE p_size % 4 WHEN 0 THEN 'Method' WHEN 1 THEN 'novelty' WHEN 2 THEN 'domain' ELSE 'bogus' END").alias("namespace"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat('Alias of ', replace(lower(p_brand), '#', ' '))"
               " WHEN p_partkey % 3 = 1 THEN '--' ELSE p_name END").alias("name"),
    ).distinct()
    return T.resolve_tags(names, t.tags, aliases(t)).drop("created")


OFFERS = """offers AS (SELECT l_suppkey AS paper_id, p_brand AS tag_id, l_discount < 0.05 AS is_candidate FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def offers(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("paper_id"),
        F.col("p_brand").alias("tag_id"),
        (F.col("l_discount") < 0.05).alias("is_candidate"),
    )


@query("g2_attach_tags", f"WITH {OFFERS} SELECT paper_id, tag_id, bool_and(is_candidate) AS is_candidate FROM offers GROUP BY 1, 2")
def g2(t):
    return T.attach_tags(offers(t))


MOVES = "moves AS (SELECT tag_id, concat(namespace, '/Brand#1') AS target_id FROM tags WHERE canonical_name IN ('Brand#1', 'Brand#2', 'Brand#3'))"


def moves(t):
    return t.tags.where(F.col("canonical_name").isin("Brand#1", "Brand#2", "Brand#3")).select(
        "tag_id", F.concat("namespace", F.lit("/Brand#1")).alias("target_id")
    )


@query("g3_merge_tags", f"""
WITH {MOVES} SELECT paper_id, coalesce(target_id, p.tag_id) AS tag_id, bool_and(CASE WHEN target_id IS NOT NULL THEN false ELSE is_candidate END) AS is_candidate
FROM paper_tags p LEFT JOIN (SELECT * FROM moves WHERE tag_id <> target_id) m ON p.tag_id = m.tag_id GROUP BY 1, 2""")
def g3(t):
    return T.merge_paper_tags(t.paper_tags, moves(t))


@query("g3_confirm_tags", """
SELECT paper_id, p.tag_id, is_candidate AND g.namespace <> 'method' AS is_candidate FROM paper_tags p JOIN tags g ON p.tag_id = g.tag_id""")
def g3_confirm(t):
    return T.confirm_tags(t.paper_tags, t.tags.where("namespace = 'method'"))


@query("g3_action_preview", "SELECT DISTINCT paper_id FROM paper_tags p JOIN tags g ON p.tag_id = g.tag_id WHERE canonical_name = 'Brand#7'")
def g3_preview(t):
    return T.action_preview(t.paper_tags, t.tags.where("canonical_name = 'Brand#7'"))


@query("g4_candidate_tags", f"""
SELECT DISTINCT paper_id, split_part(category, '.', 1) AS namespace, substr(category, instr(category, '.') + 1) AS name FROM claims
WHERE split_part(category, '.', 1) IN ({duck.in_list(C.TAG_NAMESPACES)})""")
def g4(t):
    return T.candidate_tags_from_claims(t.claims)


@query("g10_triage", """
WITH m AS (SELECT paper_id, bool_or(pinned) AS pinned, max(priority_override_tier) AS ov FROM collection_papers GROUP BY 1),
j AS (SELECT s_suppkey AS paper_id, CASE s_nationkey % 3 WHEN 0 THEN 'T0_INDEX' WHEN 1 THEN 'T1_SCAN' ELSE 'T3_DEEP' END AS requested_tier, pinned, ov FROM supplier JOIN m ON paper_id = s_suppkey),
r AS (SELECT *, CASE WHEN pinned AND (ov IS NULL OR ov < 'T2_FULL') THEN greatest(requested_tier, 'T2_FULL') ELSE requested_tier END AS recommended_tier FROM j)
SELECT paper_id, requested_tier, recommended_tier, coalesce(ov, recommended_tier) AS effective_tier, ov IS NOT NULL AS manual_override,
  CASE WHEN ov IS NULL AND NOT pinned AND requested_tier = recommended_tier THEN ['REQUESTED_TIER'] ELSE list_filter([CASE WHEN ov IS NOT NULL THEN 'COLLECTION_PRIORITY_OVERRIDE' END,
    CASE WHEN pinned THEN 'USER_PINNED' END, CASE WHEN ov IS NULL AND requested_tier <> recommended_tier THEN 'PINNED_UPGRADE' END], lambda x: x IS NOT NULL) END AS reason_codes,
  CASE WHEN pinned THEN 1.0::double ELSE 0.0::double END AS user_relevance FROM r""")
def g10(t):
    papers = t.supplier.select(
        F.col("s_suppkey").alias("paper_id"),
        F.expr("CASE s_nationkey % 3 WHEN 0 THEN 'T0_INDEX' WHEN 1 THEN 'T1_SCAN' ELSE 'T3_DEEP' END").alias("requested_tier"),
    )
    return T.triage(papers, t.collection_papers.withColumn("added_at", F.lit(0)))


@query("g11_upsert_memberships", """
WITH b AS (SELECT c_nationkey AS collection_id, c_custkey AS paper_id, c_acctbal > 3000 AS pinned, CASE WHEN c_acctbal < 1000 THEN 'T2_FULL' END AS tier,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'note' END AS note FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier))
SELECT coalesce(e.collection_id, b.collection_id) AS collection_id, coalesce(e.paper_id, b.paper_id) AS paper_id, coalesce(e.pinned, false) OR coalesce(b.pinned, false) AS pinned,
  coalesce(tier, priority_override_tier) AS priority_override_tier, b.note FROM collection_papers e FULL JOIN b ON e.collection_id = b.collection_id AND e.paper_id = b.paper_id""")
def g11(t):
    batch = t.customer.select(
        F.col("c_nationkey").alias("collection_id"),
        F.col("c_custkey").alias("paper_id"),
        (F.col("c_acctbal") > 3000).alias("pinned"),
        F.when(F.col("c_acctbal") < 1000, "T2_FULL").alias("priority_override_tier"),
        F.when(F.col("c_mktsegment") == "BUILDING", "note").alias("note"),
        F.lit(1).alias("added_at"),
    )
    collections = t.nation.select(F.col("n_nationkey").alias("collection_id"))
    stored = t.collection_papers.withColumn("note", F.lit(None).cast("string"))
    kept, _ = T.upsert_memberships(stored, batch, collections, t.papers)
    return kept


# ---- graph -------------------------------------------------------------------------


@query("g5_resolve_entities", """
SELECT DISTINCT 'METHOD' AS entity_type, p_name AS name, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', ' ', 'g')) AS normalized_name FROM part""")
def g5(t):
    mentions = t.part.select(F.lit("METHOD").alias("entity_type"), F.col("p_name").alias("name")).distinct()
    return G.resolve_entities(mentions).select("entity_type", "name", "normalized_name")


@query("g6_add_relations", """
SELECT source_entity_id, relation_type, target_entity_id, paper_id, max(confidence) AS confidence, count(*) AS mentions FROM (
  SELECT concat('s', l_suppkey) AS source_entity_id, 'RELATED_TO' AS relation_type, concat('p', l_partkey) AS target_entity_id,
    CASE WHEN l_tax > 0.02 THEN l_orderkey END AS paper_id, l_discount AS confidence FROM lineitem) q GROUP BY 1, 2, 3, 4""")
def g6(t):
    edges = t.lineitem.select(
        F.concat(F.lit("s"), "l_suppkey").alias("source_entity_id"),
        F.lit("RELATED_TO").alias("relation_type"),
        F.concat(F.lit("p"), "l_partkey").alias("target_entity_id"),
        F.when(F.col("l_tax") > 0.02, F.col("l_orderkey")).alias("paper_id"),
        F.col("l_discount").alias("confidence"),
    )
    return G.add_relations(edges).drop("relation_id")


@query("g7_link_claims", f"""
WITH e AS (SELECT claim_id, paper_id, {prefix_case('category', C.CATEGORY_ENTITY)} AS entity_type, {duck.subject('statement')} AS name,
  {prefix_case('category', C.CATEGORY_RELATION, "'RELATED_TO'")} AS relation_type FROM claims),
n AS (SELECT claim_id, count(DISTINCT evidence_id) AS n FROM claim_evidence GROUP BY 1)
SELECT paper_id, relation_type, entity_type, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS normalized_name, count(*) AS claims,
  cast(coalesce(sum(n), 0) AS bigint) AS evidence_links FROM e LEFT JOIN n ON e.claim_id = n.claim_id WHERE entity_type IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2, 3, 4""")
def g7(t):
    return G.link_claims(t.claims, t.claim_evidence).select(
        "paper_id", "relation_type", "entity_type", "normalized_name", "claims", "evidence_links"
    )


BFS = """ends AS MATERIALIZED (SELECT source_entity_id AS node, target_entity_id AS other FROM relations UNION ALL SELECT target_entity_id, source_entity_id FROM relations),
d0 AS (SELECT 'author_1' AS entity_id, 0 AS distance), d1 AS (SELECT DISTINCT other AS entity_id, 1 AS distance FROM ends WHERE node = 'author_1'),
d2 AS (SELECT DISTINCT other AS entity_id, 2 AS distance FROM ends WHERE node IN (SELECT entity_id FROM d1) AND other <> 'author_1'),
reached AS MATERIALIZED (SELECT entity_id, min(distance) AS distance FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) q GROUP BY 1)"""


def seed(t):
    return t.entities.where("entity_id = 'author_1'")


@query("g8_neighbors", f"WITH {BFS} SELECT entity_id, distance FROM reached")
def g8(t):
    return G.neighbors(t.relations, seed(t), 2)[0]


@query("g9_entity_cards", """
SELECT node AS entity_id, relation_id, direction, other AS other_id, canonical_name AS other_name FROM (
  SELECT source_entity_id AS node, target_entity_id AS other, 'OUT' AS direction, relation_id FROM relations
  UNION ALL SELECT target_entity_id, source_entity_id, 'IN', relation_id FROM relations) q LEFT JOIN entities e ON e.entity_id = q.other
WHERE node IN (SELECT entity_id FROM entities)""")
def g9(t):
    return G.entity_cards(t.relations, t.entities).select("entity_id", "relation_id", "direction", "other_id", "other_name")


@query("t5_capped_graph", f"""
WITH {BFS}, shown AS (SELECT entity_id FROM reached ORDER BY distance, entity_id LIMIT 40)
SELECT relation_id FROM relations WHERE source_entity_id IN (SELECT entity_id FROM shown) AND target_entity_id IN (SELECT entity_id FROM shown) ORDER BY relation_id LIMIT 80""")
def t5(t):
    nodes, _ = G.neighbors(t.relations, seed(t), 2)
    return G.capped_graph(nodes, t.relations)[1].select("relation_id")


# ---- corpus views --------------------------------------------------------------------


@query("p1_claims_scan", """
SELECT claim_id FROM claims WHERE paper_id IN (SELECT paper_id FROM collection_papers WHERE pinned) AND claim_type IN ('FACT', 'CRITIQUE')
  AND (starts_with(category, 'result.') OR starts_with(category, 'contribution.'))""")
def p1(t):
    return V.claims_scan(
        t.claims, t.collection_papers.where("pinned"), prefixes=("result.", "contribution."), types=["FACT", "CRITIQUE"]
    ).select("claim_id")


@query("p1_empty_scope", "SELECT claim_id FROM claims WHERE false")
def p1_empty(t):
    return V.claims_scan(t.claims, V.collection_scope(t.collection_papers, -1)).select("claim_id")


TOPICS = f"""topics AS MATERIALIZED (SELECT g.namespace, g.normalized_name, min(canonical_name) AS topic, count(DISTINCT p.paper_id) AS paper_count,
  count(DISTINCT claim_id) AS claim_count, bool_and(is_candidate) AS candidate_tag FROM paper_tags p JOIN tags g ON p.tag_id = g.tag_id
  LEFT JOIN (SELECT claim_id, paper_id, split_part(category, '.', 1) AS ns FROM claims) c ON c.paper_id = p.paper_id AND c.ns = g.namespace
  WHERE g.namespace IN ({duck.in_list(C.TOPIC_NAMESPACES)}) GROUP BY 1, 2)"""


@query("c1_topic_landscape", f"WITH {TOPICS} SELECT * FROM topics")
def c1(t):
    return V.topic_landscape(t.claims, t.tags, t.paper_tags)


@query("j2_topic_claims", f"""
SELECT g.namespace, g.normalized_name, p.paper_id, claim_id FROM paper_tags p JOIN tags g ON p.tag_id = g.tag_id
LEFT JOIN claims c ON c.paper_id = p.paper_id AND starts_with(c.category, concat(g.namespace, '.')) WHERE g.namespace IN ({duck.in_list(C.TOPIC_NAMESPACES)})""")
def j2(t):
    return V.topic_claims(t.claims, t.tags, t.paper_tags)


GENEALOGY = """ends AS (SELECT source_entity_id AS node, relation_type, paper_id FROM relations UNION ALL SELECT target_entity_id, relation_type, paper_id FROM relations)"""


@query("c2_method_genealogy", f"""
WITH {GENEALOGY} SELECT node AS entity_id, min(canonical_name) AS method, count(DISTINCT paper_id) AS paper_count, list_sort(list_distinct(list(relation_type))) AS relation_types
FROM ends JOIN entities ON entity_id = node WHERE entity_type = 'METHOD' GROUP BY 1""")
def c2(t):
    return V.method_genealogy(t.relations, t.entities)


@query("c2_rooted_edges", f"""
WITH {BFS} SELECT relation_id FROM relations WHERE source_entity_id IN (SELECT entity_id FROM reached) OR target_entity_id IN (SELECT entity_id FROM reached)""")
def c2_edges(t):
    return V.genealogy_edges(t.relations, root=seed(t)).select("relation_id")


DATASETS = f"""ds AS MATERIALIZED (SELECT *, coalesce({duck.subject('statement')}, statement) AS dataset FROM claims WHERE starts_with(category, 'experiment.dataset'))"""


@query("c3_dataset_landscape", f"""
WITH {DATASETS}, m AS (SELECT paper_version_id, count(*) AS n FROM claims WHERE starts_with(category, 'experiment.metric') GROUP BY 1),
v AS (SELECT DISTINCT dataset, paper_version_id FROM ds),
a AS (SELECT dataset, count(*) AS version_count, cast(coalesce(sum(n), 0) AS bigint) AS metric_claims FROM v LEFT JOIN m ON v.paper_version_id = m.paper_version_id GROUP BY 1)
SELECT ds.dataset, count(*) AS claim_count, count(DISTINCT paper_id) AS paper_count, max(version_count) AS version_count, max(metric_claims) AS metric_claims
FROM ds JOIN a ON ds.dataset = a.dataset GROUP BY 1""")
def c3(t):
    return V.dataset_landscape(t.claims)


@query("c3_version_metrics", "SELECT DISTINCT paper_version_id, statement AS metric_statement FROM claims WHERE starts_with(category, 'experiment.metric')")
def c3_metrics(t):
    return V.version_metrics(t.claims)


@query("c4_benchmark_rows", f"""
WITH {DATASETS}, n AS (SELECT paper_id, count(DISTINCT dataset) AS k FROM ds GROUP BY 1)
SELECT claim_id, c.paper_id, paper_version_id, {METRIC} AS metric, {duck.numbers('statement')} AS "values", support_state, coalesce(k, 0) AS datasets, k IS NULL AS unspecified
FROM claims c LEFT JOIN n ON c.paper_id = n.paper_id WHERE starts_with(category, 'result.') AND len({duck.numbers('statement')}) > 0""")
def c4(t):
    return V.benchmark_rows(t.claims)


@query("c4_paper_datasets", f"WITH {DATASETS} SELECT DISTINCT paper_id, dataset FROM ds")
def c4_datasets(t):
    return V.paper_datasets(t.claims)


# The data sets named first and last: a choice that the data give, whatever their size.
CHOSEN = "(SELECT min(dataset) FROM ds UNION SELECT max(dataset) FROM ds)"


def chosen_datasets(t):
    names = V.dataset_claims(t.claims).agg(F.min("dataset"), F.max("dataset")).first()
    return sorted({n for n in names if n is not None})


@query("c3_dataset_metrics", f"""
WITH {DATASETS} SELECT DISTINCT dataset, c.statement AS metric_statement FROM (SELECT DISTINCT dataset, paper_version_id FROM ds WHERE dataset IN {CHOSEN}) v
JOIN claims c ON c.paper_version_id = v.paper_version_id WHERE starts_with(c.category, 'experiment.metric')""")
def c3_of_datasets(t):
    return V.dataset_metrics(t.claims, chosen_datasets(t))


@query("c4_benchmark_cells", f"""
WITH {DATASETS}, n AS (SELECT DISTINCT paper_id, dataset FROM ds),
r AS (SELECT claim_id, paper_id, paper_version_id, {METRIC} AS metric, {duck.numbers('statement')} AS "values", support_state FROM claims
  WHERE starts_with(category, 'result.') AND len({duck.numbers('statement')}) > 0)
SELECT r.*, dataset FROM r JOIN n ON r.paper_id = n.paper_id WHERE dataset IN {CHOSEN}
UNION ALL SELECT r.*, '(unspecified)' FROM r WHERE paper_id NOT IN (SELECT paper_id FROM ds)""")
def c4_cells(t):
    return V.benchmark_cells(t.claims, [*chosen_datasets(t), "(unspecified)"])


@query("c9_collaborations", """
WITH a AS (SELECT DISTINCT paper_id, target_entity_id AS author_id FROM relations WHERE relation_type = 'AUTHORED_BY'),
top AS (SELECT author_id FROM a GROUP BY 1 ORDER BY count(*) DESC, author_id LIMIT 5)
SELECT a.paper_id, a.author_id, b.author_id AS coauthor_id FROM a JOIN top USING (author_id) JOIN a b ON a.paper_id = b.paper_id WHERE a.author_id <> b.author_id""")
def c9_pairs(t):
    authored = V.authorships(t.relations, t.entities).select("paper_id", "author_id").distinct()
    top = authored.groupBy("author_id").count().orderBy(F.desc("count"), "author_id").limit(5)
    return V.collaborations(authored, top)


DISAGREE = f"""
uniq AS MATERIALIZED (SELECT paper_id, lower({duck.squeeze('statement')}) AS s, arg_min(claim_id, (created_at, claim_id)) AS claim_id, min(created_at) AS created_at,
  arg_min(statement, (created_at, claim_id)) AS statement, arg_min(support_state, (created_at, claim_id)) AS support_state,
  arg_min(category, (created_at, claim_id)) AS category FROM claims GROUP BY 1, 2),
num AS MATERIALIZED (SELECT * FROM (SELECT *, {duck.tokens('statement')} AS tokens, {duck.numbers('statement')} AS numbers FROM uniq) q WHERE len(numbers) > 0 AND len(tokens) > 0),
sets AS MATERIALIZED (SELECT DISTINCT array_to_string(tokens, ' ') AS subject, tokens FROM num),
w AS MATERIALIZED (SELECT subject, unnest(tokens) AS w FROM sets),
cand AS (SELECT a.subject AS l, b.subject AS r FROM w a JOIN w b ON a.w = b.w WHERE NOT list_contains([{duck.in_list(C.GENERIC_CLAIM_TOKENS)}], a.w) GROUP BY 1, 2),
ok AS MATERIALIZED (SELECT l, r FROM cand JOIN sets a ON a.subject = l JOIN sets b ON b.subject = r
  WHERE len(list_intersect(a.tokens, b.tokens)) >= greatest(2, len(a.tokens) // 2)),
pairs AS (SELECT a.claim_id AS left_id, a.created_at AS left_at, a.paper_id AS left_paper, array_to_string(a.numbers, ' ') AS left_numbers, b.claim_id,
    b.paper_id, array_to_string(b.tokens, ' ') AS subject, array_to_string(b.numbers, ' ') AS numbers, b.support_state
  FROM ok JOIN num a ON array_to_string(a.tokens, ' ') = l JOIN num b ON array_to_string(b.tokens, ' ') = r
  WHERE a.paper_id <> b.paper_id AND a.numbers <> b.numbers AND (a.created_at, a.claim_id) < (b.created_at, b.claim_id)),
numeric_d AS MATERIALIZED (SELECT claim_id, paper_id, subject, numbers, support_state, arg_min(left_id, (left_at, left_id)) AS first_rival_id,
  arg_min(left_paper, (left_at, left_id)) AS first_rival_paper, arg_min(left_numbers, (left_at, left_id)) AS first_rival_numbers FROM pairs GROUP BY 1, 2, 3, 4, 5)"""


@query("c5_numeric_disagreements", f"WITH {DISAGREE} SELECT * FROM numeric_d")
def c5_numeric(t):
    return V.numeric_disagreements(t.claims)


@query("c5_contradiction_map", f"""WITH {DISAGREE}
SELECT 'numeric_disagreement' AS kind, claim_id AS item_id, paper_id, concat(first_rival_numbers, ' vs ', numbers) AS summary, first_rival_id AS related_id FROM numeric_d
UNION ALL SELECT 'contradicts_relation', relation_id, paper_id, concat(source_entity_id, ' CONTRADICTS ', target_entity_id), NULL FROM relations WHERE relation_type = 'CONTRADICTS'
UNION ALL SELECT concat('claim_', lower(support_state)), claim_id, paper_id, statement, NULL FROM uniq WHERE support_state IN ('DISPUTED', 'UNSUPPORTED')""")
def c5(t):
    return V.contradiction_map(t.claims, t.relations)


@query("c6_innovation_map", """
WITH a AS (SELECT paper_id, count(*) FILTER (WHERE category = 'contribution.declared') AS declared, count(*) FILTER (WHERE category = 'contribution.technical') AS technical,
  count(*) FILTER (WHERE category = 'contribution.overstated') AS overstated FROM claims WHERE starts_with(category, 'contribution.') GROUP BY 1),
b AS (SELECT paper_id, count(DISTINCT canonical_name) AS novelty_tags FROM paper_tags p JOIN tags g ON p.tag_id = g.tag_id WHERE namespace = 'novelty' GROUP BY 1)
SELECT coalesce(a.paper_id, b.paper_id) AS paper_id, coalesce(declared, 0) AS declared, coalesce(technical, 0) AS technical, coalesce(overstated, 0) AS overstated,
  coalesce(novelty_tags, 0) AS novelty_tags FROM a FULL JOIN b ON a.paper_id = b.paper_id""")
def c6(t):
    return V.innovation_map(t.claims, t.tags, t.paper_tags)


@query("c6_innovation_refs", """
SELECT paper_id, category, claim_id, statement AS value FROM claims WHERE category IN ('contribution.declared', 'contribution.technical', 'contribution.overstated')
UNION ALL SELECT paper_id, 'novelty', NULL, canonical_name FROM paper_tags p JOIN tags g ON p.tag_id = g.tag_id WHERE namespace = 'novelty'""")
def c6_refs(t):
    return V.innovation_refs(t.claims, t.tags, t.paper_tags)


@query("c7_technique_mining", f"""
SELECT category AS aspect, coalesce({duck.subject('statement')}, 'unspecified') AS technique, count(*) AS claim_count, count(DISTINCT paper_id) AS paper_count
FROM claims WHERE starts_with(category, 'technique.') GROUP BY 1, 2""")
def c7(t):
    return V.technique_mining(t.claims)


@query("c8_reliability_landscape", """
SELECT paper_id, category, count(*) AS findings, cast(sum(count(*)) OVER (PARTITION BY paper_id) AS bigint) AS paper_findings
FROM claims WHERE starts_with(category, 'reliability.') GROUP BY 1, 2""")
def c8(t):
    return V.reliability_landscape(t.claims)


@query("c9_authorships", """
SELECT DISTINCT paper_id, target_entity_id AS author_id, canonical_name AS author FROM relations JOIN entities ON entity_id = target_entity_id WHERE relation_type = 'AUTHORED_BY'""")
def c9_authorships(t):
    return V.authorships(t.relations, t.entities)


@query("c9_author_network", """
WITH a AS (SELECT DISTINCT paper_id, target_entity_id AS author_id, canonical_name AS author FROM relations JOIN entities ON entity_id = target_entity_id WHERE relation_type = 'AUTHORED_BY'),
k AS (SELECT paper_id, count(*) AS team FROM a GROUP BY 1)
SELECT author_id, min(author) AS author, count(*) AS paper_count, cast(sum(team - 1) AS bigint) AS coauthor_links FROM a JOIN k ON a.paper_id = k.paper_id GROUP BY 1""")
def c9(t):
    return V.author_network(t.relations, t.entities)


@query("c10_gap_candidates", f"""
WITH {TOPICS} SELECT CASE category WHEN 'research.gap' THEN 'explicit_gap' ELSE category END AS kind, claim_id AS item_id, 1 AS paper_count FROM claims
WHERE category IN ({duck.in_list(V.GAP_CATEGORIES)}) UNION ALL SELECT 'thin_topic', concat(namespace, '/', normalized_name), paper_count FROM topics WHERE paper_count <= 98""")
def c10(t):
    return V.gap_candidates(t.claims, t.tags, t.paper_tags, min_papers=98)


@query("c11_negative_results", f"""
SELECT CASE WHEN support_state IN ('UNSUPPORTED', 'DISPUTED', 'RETRACTED') THEN concat('claim_', lower(support_state)) ELSE 'failure_report' END AS kind, claim_id, paper_id, category, support_state
FROM claims WHERE support_state IN ('UNSUPPORTED', 'DISPUTED', 'RETRACTED') OR starts_with(category, 'critique.')
  OR {' OR '.join(f"contains(lower(statement), '{w}')" for w in X.FAILURE_WORDS)}""")
def c11(t):
    return V.negative_results(t.claims)


DATED = "dated AS (SELECT paper_version_id, paper_id, min(created_at) AS created_at FROM claims GROUP BY 1, 2)"


def dated(t):
    return t.claims.groupBy("paper_version_id", "paper_id").agg(F.min("created_at").alias("created_at")).withColumn(
        "publication_date", F.lit(None).cast("timestamp")
    )


@query("c12_temporal_trends", f"WITH {DATED} SELECT year(created_at) AS year, count(*) AS version_count, count(DISTINCT paper_id) AS paper_count FROM dated GROUP BY 1")
def c12(t):
    return V.temporal_trends(dated(t))


@query("c12_topic_trends", f"""
WITH {DATED}, y AS (SELECT DISTINCT year(created_at) AS year, paper_id FROM dated)
SELECT year, concat(namespace, '/', canonical_name) AS topic, count(*) AS paper_count FROM y JOIN paper_tags p ON y.paper_id = p.paper_id JOIN tags g ON p.tag_id = g.tag_id
WHERE namespace IN ({duck.in_list(C.TOPIC_NAMESPACES)}) GROUP BY 1, 2""")
def c12_topics(t):
    return V.topic_trends(dated(t), t.tags, t.paper_tags)


def scoped(sql: str) -> str:
    for name in ("claims", "paper_tags", "relations", "dated"):
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {name} ", f"{word} s_{name} ").replace(f"{word} {name})", f"{word} s_{name})")
    return sql


def view_count(kind: str, source: str) -> str:
    digest = f"substr(sha256('corpus.{kind}|'), 1, 16)"
    return f"SELECT 'corpus.{kind}' AS agent_type, 'pinned' AS scope, {digest} AS config_hash, count(*) AS findings FROM ({source}) q"


SUBJECT_OR = f"coalesce({duck.subject('statement')}, 'unspecified')"
ALL_VIEWS = f"""WITH {DATED}, pinned AS (SELECT paper_id FROM collection_papers WHERE pinned),
s_claims AS MATERIALIZED (SELECT * FROM claims WHERE paper_id IN (SELECT paper_id FROM pinned)), s_paper_tags AS (SELECT * FROM paper_tags WHERE paper_id IN (SELECT paper_id FROM pinned)),
s_relations AS (SELECT * FROM relations WHERE paper_id IN (SELECT paper_id FROM pinned)), s_dated AS (SELECT * FROM dated WHERE paper_id IN (SELECT paper_id FROM pinned)),
""" + scoped(f"{TOPICS}, {DATASETS}, {DISAGREE}, {GENEALOGY}") + " " + " UNION ALL ".join(
    scoped(view_count(kind, source))
    for kind, source in {
        "topic_landscape": "SELECT * FROM topics",
        "method_genealogy": "SELECT DISTINCT node FROM ends JOIN entities ON entity_id = node WHERE entity_type = 'METHOD'",
        "dataset_landscape": "SELECT DISTINCT dataset FROM ds",
        "benchmark_matrix": f"SELECT claim_id FROM claims WHERE starts_with(category, 'result.') AND len({duck.numbers('statement')}) > 0",
        "contradiction_map": "SELECT claim_id FROM numeric_d UNION ALL SELECT relation_id FROM relations WHERE relation_type = 'CONTRADICTS'"
        " UNION ALL SELECT claim_id FROM uniq WHERE support_state IN ('DISPUTED', 'UNSUPPORTED')",
        "innovation_map": "SELECT paper_id FROM claims WHERE starts_with(category, 'contribution.') UNION SELECT paper_id FROM paper_tags p JOIN tags g ON p.tag_id = g.tag_id WHERE namespace = 'novelty'",
        "technique_mining": f"SELECT DISTINCT category, {SUBJECT_OR} FROM claims WHERE starts_with(category, 'technique.')",
        "reliability_landscape": "SELECT DISTINCT paper_id, category FROM claims WHERE starts_with(category, 'reliability.')",
        "author_network": "SELECT DISTINCT target_entity_id FROM relations JOIN entities ON entity_id = target_entity_id WHERE relation_type = 'AUTHORED_BY'",
        "gap_candidates": f"SELECT claim_id FROM claims WHERE category IN ({duck.in_list(V.GAP_CATEGORIES)}) UNION ALL SELECT normalized_name FROM topics WHERE paper_count <= 1",
        "negative_results": "SELECT claim_id FROM claims WHERE support_state IN ('UNSUPPORTED', 'DISPUTED', 'RETRACTED') OR starts_with(category, 'critique.') OR "
        + " OR ".join(f"contains(lower(statement), '{w}')" for w in X.FAILURE_WORDS),
        "temporal_trends": "SELECT DISTINCT year(created_at) FROM dated ",
    }.items()
)


@query("c13_all_views", ALL_VIEWS)
def c13(t):
    scope = t.collection_papers.where("pinned").select("paper_id")
    views = V.all_views(t.claims, t.tags, t.paper_tags, t.relations, t.entities, dated(t), scope)
    return V.run_log(views, "pinned")


@query("a20_claim_refs", """
SELECT aspect, technique, t.claim_id, evidence_id FROM (SELECT category AS aspect, coalesce(SUBJECT, 'unspecified') AS technique, claim_id FROM claims
  WHERE starts_with(category, 'technique.')) t LEFT JOIN (SELECT DISTINCT claim_id, evidence_id FROM claim_evidence) l ON l.claim_id = t.claim_id""".replace("SUBJECT", duck.subject("statement")))
def a20(t):
    rows = V.technique_claims(t.claims).select("aspect", "technique", "claim_id")
    return V.claim_refs(rows, t.claim_evidence)
