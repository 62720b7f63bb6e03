"""Queries over the search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import postings_index as PI
from evidentia.operators import search as S
from evidentia.operators import vector_index as VI
from evidentia.plans import duck
from evidentia.plans.registry import query


def projection(t):
    evidence = t.evidence.withColumn("paper_id", F.floor(F.col("paper_version_id") / 10).cast("long"))
    papers = t.papers.withColumn("paper_id", F.col("paper_id"))
    return S.build_projection(evidence, t.claims, papers)


PROJECTION = """proj AS MATERIALIZED (
  SELECT evidence_id AS document_id, 'EVIDENCE' AS document_type, paper_version_id // 10 AS paper_id, paper_version_id, section_id, evidence_type,
    NULL AS claim_type, NULL AS category, NULL AS support_state, page_start, text AS content, text AS index_text, sha256(text) AS content_sha256 FROM evidence
  UNION ALL SELECT claim_id, 'CLAIM', paper_id, paper_version_id, NULL, NULL, claim_type, category, support_state, NULL, statement,
    concat(category, ': ', statement), sha256(concat(category, ': ', statement, chr(31), support_state)) FROM claims
  UNION ALL SELECT cast(paper_id AS varchar), 'PAPER', paper_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, canonical_title, canonical_title, sha256(canonical_title) FROM papers)"""


@query("q1_build_projection", f"""WITH {PROJECTION} SELECT document_id, document_type, cast(paper_id AS varchar) AS paper_id, cast(paper_version_id AS varchar) AS paper_version_id,
  section_id, evidence_type, claim_type, category, support_state, page_start, content, index_text, content_sha256 FROM proj""")
def q1(t):
    return projection(t)


@query("a1_document_counts", f"WITH {PROJECTION} SELECT document_type, count(*) AS documents FROM proj GROUP BY 1")
def a1(t):
    return S.document_counts(projection(t))


@query("q2_refresh_projection", """
SELECT CASE WHEN lang = 'de' OR source = 'src3' THEN 'written' ELSE 'reused' END AS outcome, count(*) AS n FROM documents GROUP BY 1""")
def q2(t):
    new = t.documents.select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("content_sha256"))
    old = t.documents.where("source <> 'src3'").select(
        F.col("doc_id").alias("document_id"),
        F.when(F.col("lang") == "de", "stale").otherwise(F.sha2("text", 256)).alias("content_sha256"),
    )
    return S.refresh_projection(old, new).groupBy("outcome").agg(F.count("*").alias("n"))


def documents(t):
    return t.documents.select(
        F.col("doc_id").alias("document_id"), F.col("text").alias("index_text"), F.col("text").alias("content")
    )


POSTS = """words AS MATERIALIZED (SELECT doc_id AS document_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: lower(w)) AS ws FROM documents),
posts AS MATERIALIZED (SELECT document_id, len(ws) AS doc_len, w AS token, count(*) AS tf FROM (SELECT document_id, ws, unnest(ws) AS w FROM words) q GROUP BY 1, 2, 3)"""


@query("q3_postings", f"WITH {POSTS} SELECT token, document_id, doc_len, tf FROM posts")
def q3(t):
    return S.postings(documents(t))


FTS = POSTS + """,
terms AS MATERIALIZED (SELECT query_id, len(ts) AS n_terms, unnest(ts) AS token FROM (SELECT item_id AS query_id, list_distinct(list_transform(
  regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: lower(w))) AS ts FROM benchmark) q),
corpus AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM (SELECT DISTINCT document_id, doc_len FROM posts) q),
freq AS (SELECT token, count(*) AS df FROM posts GROUP BY 1),
scored AS (SELECT query_id, document_id, n_terms, count(*) AS found, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
  FROM posts p JOIN terms USING (token) JOIN freq USING (token) CROSS JOIN corpus GROUP BY 1, 2, 3),
fts AS MATERIALIZED (SELECT query_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM scored WHERE found = n_terms)"""


def queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("q4_fts", f"WITH {FTS} SELECT query_id, document_id, score, rank FROM fts")
def q4(t):
    return S.fts(documents(t), queries(t))


def short_queries(t):
    """The first two words of every benchmark text, which many documents have."""
    two = F.array_join(F.slice(S.words(F.col("text")), 1, 2), " ")
    return t.benchmark.select(F.col("item_id").alias("query_id"), two.alias("query"))


SHORT = FTS.replace("FROM benchmark", "FROM (SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: lower(w))[1:2], ' ') AS text FROM benchmark) s")


@query("q4_index_top", f"WITH {SHORT} SELECT query_id, document_id, score, rank FROM fts WHERE rank <= 20")
def q4_top(t):
    return PI.top(PI.build(documents(t), shard_size=64), short_queries(t), 20)


@query("q4_index_matches", f"WITH {FTS} SELECT query_id, document_id, score, rank FROM fts")
def q4_matches(t):
    return PI.matches(PI.build(documents(t)), queries(t))


@query("q3_index_words", f"WITH {POSTS} SELECT token, count(*) AS df FROM posts GROUP BY 1")
def q3_words(t):
    return PI.build(documents(t)).words.select("token", "df")


SEMANTIC = """vec AS MATERIALIZED (SELECT vec_id AS document_id, list_transform(embedding, lambda x: cast(x AS double)) AS v FROM embeddings),
sims AS (SELECT b.item_id AS query_id, d.document_id, round(list_cosine_similarity(d.v, q.v), 6) AS similarity
  FROM benchmark b JOIN vec q ON q.document_id = b.item_id CROSS JOIN vec d),
sem AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id) AS rank FROM sims) q WHERE rank <= 60)"""


def vector_queries(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return queries(t).join(vectors, "query_id", "left")


@query("q5_semantic", f"WITH {SEMANTIC} SELECT query_id, document_id, similarity, rank FROM sem")
def q5(t):
    docs = t.embeddings.select(F.col("vec_id").alias("document_id"), "embedding")
    return S.semantic(docs, vector_queries(t), 20)


def asked_vectors(t):
    """Every hundredth vector is a query, against all vectors."""
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def indexed(t):
    docs = t.embeddings.select(F.col("vec_id").alias("document_id"), "embedding")
    return VI.build(docs, VI.fit(docs))


# The exact results of the index's queries; an index must find nine tenths of them.
@query("q5_index_recall", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings)
SELECT q.vec_id AS query_id, least(60, (SELECT count(*) FROM v)) AS wanted, true AS enough FROM v q WHERE q.vec_id % 100 = 0""")
def q5_recall(t):
    exact = S.semantic(t.embeddings.select(F.col("vec_id").alias("document_id"), "embedding"), asked_vectors(t), 20)
    counted = VI.recall(VI.search(indexed(t), asked_vectors(t), 20), exact)
    # Nine tenths over all queries; a single query may have a few less.
    overall = counted.agg((F.sum("hits") >= 0.9 * F.sum("wanted")).alias("enough"))
    return counted.select("query_id", "wanted").withColumn("enough", overall.scalar())


@query("q5_index_rows", "SELECT vec_id AS document_id FROM embeddings")
def q5_rows(t):
    """Every vector is in the index once."""
    return indexed(t).codes.select(F.explode("ids").alias("document_id"))


# Similarities of what the index finds are exact; the first is the best by rounded similarity, then by document.
@query("q5_semantic_index", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS document_id, round(list_cosine_similarity(d.e, q.e), 6) AS similarity FROM v q CROSS JOIN v d WHERE q.vec_id % 100 = 0)
SELECT query_id, arg_min(document_id, (-similarity, document_id)) AS document_id, max(similarity) AS similarity, 1 AS rank FROM s GROUP BY 1""")
def q5_index(t):
    return VI.search(indexed(t), asked_vectors(t), 20).where("rank = 1")


@query("f10_cosine", """
SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: cast(x AS double)), list_transform(b.embedding, lambda x: cast(x AS double))), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.label""")
def f10(t):
    from evidentia.functions import text as X

    other = t.embeddings.select(F.col("vec_id").alias("label"), F.col("embedding").alias("other"))
    joined = t.embeddings.withColumn("label", F.col("label").cast("long")).join(other, "label")
    return joined.select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def scope_with_vectors(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("document_id"), "embedding")
    return documents(t).join(vectors, "document_id", "left")


@query("q7_hybrid_search", f"""WITH {FTS}, {SEMANTIC},
parts AS (SELECT query_id, document_id, 1.0 / (60 + rank) AS part, 1 AS f, 0 AS s FROM fts UNION ALL SELECT query_id, document_id, 1.0 / (60 + rank), 0, 1 FROM sem
  UNION ALL SELECT item_id, doc_id, 0.0, 0, 0 FROM benchmark CROSS JOIN documents),
total AS (SELECT query_id, document_id, round(sum(part::double), 8) AS score, max(f) AS f, max(s) AS s FROM parts GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS position FROM total)
SELECT query_id, position, document_id, score, list_filter(['filters', CASE WHEN f = 1 THEN 'fts' END, CASE WHEN s = 1 THEN 'semantic' END], lambda x: x IS NOT NULL) AS channels,
  substr(text, 1, 240) AS excerpt, (SELECT count(*) FROM documents) AS scope_size FROM top JOIN documents ON doc_id = document_id WHERE position <= 20""")
def q7(t):
    return S.hybrid_search(scope_with_vectors(t), vector_queries(t), 20).drop("warning")


@query("e21_hash_embed", """
WITH tok AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_%-]{2,}'))) AS w FROM documents),
c AS (SELECT doc_id, cast(concat('0x', substr(sha256(w), 1, 8)) AS bigint) % 64 AS b, sum(CASE WHEN cast(concat('0x', substr(sha256(w), 9, 1)) AS bigint) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM tok GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM c GROUP BY 1)
SELECT d.doc_id AS document_id, list(CASE WHEN coalesce(norm, 0) > 0 THEN round(coalesce(v, 0) / norm, 6) WHEN b.b = 0 THEN 1.0 ELSE 0.0 END ORDER BY b.b) AS embedding
FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS b) b LEFT JOIN c ON c.doc_id = d.doc_id AND c.b = b.b LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1""")
def e21(t):
    return S.hash_embed(documents(t)).withColumn(
        "embedding", F.transform("embedding", lambda v: F.round(v, 6) + F.lit(0.0))
    )


@query("e22_check_vectors", """
SELECT coalesce(doc_id, vec_id) AS document_id, CASE WHEN doc_id IS NULL THEN 'no_document' WHEN vec_id IS NULL THEN 'no_vector' ELSE 'wrong_dimension' END AS problem
FROM (SELECT doc_id + 100 AS doc_id FROM documents) d FULL JOIN embeddings e ON d.doc_id = e.vec_id WHERE doc_id IS NULL OR vec_id IS NULL OR len(embedding) <> 64""")
def e22(t):
    docs = t.documents.select((F.col("doc_id") + 100).alias("document_id"))  # so both sides have rows alone
    return S.check_vectors(docs, t.embeddings.select(F.col("vec_id").alias("document_id"), "embedding"), 64)


FILTERS = S.Filters(
    document_types=["EVIDENCE", "CLAIM"],
    collection_ids=["1", "2", "3", "5", "8"],
    tag_namespaces=["method"],
    tag_names=["brand#4", "brand#5"],
    entity_types=["METHOD"],
)


def text_dims(t, papers=1000):
    """Dimension tables with text keys, as the projection has; relations are dealt to ``papers`` papers."""

    def text(df):
        return df.select(*[F.col(c).cast("string").alias(c) if c in ("paper_id", "collection_id") else c for c in df.columns])

    relations = t.relations.withColumn("paper_id", F.col("paper_id") % papers)
    return {
        "members": text(t.collection_papers),
        "paper_tags": text(t.paper_tags),
        "tags": t.tags,
        "relations": text(relations),
        "entities": t.entities,
    }


SCOPED = PROJECTION + """, scoped AS MATERIALIZED (SELECT * FROM proj WHERE document_type IN ('EVIDENCE', 'CLAIM')
  AND paper_id IN (SELECT paper_id FROM collection_papers WHERE collection_id IN (1, 2, 3, 5, 8))
  AND paper_id IN (SELECT p.paper_id FROM paper_tags p JOIN tags g ON p.tag_id = g.tag_id WHERE namespace = 'method' AND normalized_name IN ('brand#4', 'brand#5'))
  AND paper_id IN (SELECT r.paper_id % 1000 FROM relations r JOIN entities e ON e.entity_id = r.target_entity_id OR e.entity_id = r.source_entity_id WHERE entity_type = 'METHOD'))"""


@query("p2_search_scope", f"WITH {SCOPED} SELECT document_id FROM scoped")
def p2(t):
    return S.search_scope(projection(t), FILTERS, **text_dims(t)).select("document_id")


@query("p3_entity_scope", """
SELECT DISTINCT r.paper_id FROM relations r JOIN entities e ON e.entity_id IN (r.source_entity_id, r.target_entity_id) WHERE entity_type = 'METHOD'""")
def p3(t):
    return S.entity_scope(t.relations, t.entities, S.Filters(entity_types=["METHOD"]))


@query("p3_no_entity_no_papers", "SELECT paper_id FROM relations WHERE false")
def p3_none(t):
    return S.entity_scope(t.relations, t.entities, S.Filters(entity_ids=["nobody"]))


@query("q6_graph_channel", f"WITH {PROJECTION} SELECT document_id, 1 AS distance FROM proj WHERE paper_id IN (SELECT paper_id % 1000 FROM relations WHERE target_entity_id = 'method_Brand#4')")
def q6(t):
    dims = text_dims(t)
    return S.graph_channel(projection(t), dims["relations"], dims["entities"], S.Filters(entity_ids=["method_Brand#4"]))


def claim_queries(t):
    """Part names asked of the claims."""
    return t.part.select(
        F.col("p_brand").alias("query_id"), F.concat(F.lit("part "), F.col("p_partkey")).alias("query"), "p_partkey"
    ).groupBy("query_id").agg(F.min_by("query", "p_partkey").alias("query"))


def preset_sql(where: str, gain: str = "0.0::double") -> str:
    """Full-text search of the projected documents that ``where`` picks; ``gain`` is what the graph channel adds to each."""
    return f"""WITH {PROJECTION}, picked AS MATERIALIZED (SELECT document_id, index_text FROM proj WHERE {where}),
asked AS MATERIALIZED (SELECT p_brand AS query_id, 2 AS n_terms, unnest(['part', cast(min(p_partkey) AS varchar)]) AS token FROM part GROUP BY 1),
w AS MATERIALIZED (SELECT document_id, list_transform(regexp_extract_all(index_text, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)) AS ws FROM picked),
posts AS MATERIALIZED (SELECT document_id, len(ws) AS doc_len, w AS token, count(*) AS tf FROM (SELECT document_id, ws, unnest(ws) AS w FROM w) q
  WHERE w IN (SELECT token FROM asked) GROUP BY 1, 2, 3),
corpus AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avg_len FROM w WHERE len(ws) > 0), freq AS (SELECT token, count(*) AS df FROM posts GROUP BY 1),
scored AS (SELECT query_id, document_id, n_terms, count(*) AS found, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
  FROM posts JOIN asked USING (token) JOIN freq USING (token) CROSS JOIN corpus GROUP BY 1, 2, 3),
fts AS MATERIALIZED (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM scored WHERE found = n_terms),
fill AS (SELECT p_brand AS query_id, document_id FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT document_id FROM picked ORDER BY document_id LIMIT 50) c),
total AS (SELECT query_id, document_id, round(max(s) + {gain}, 8) AS score FROM (SELECT query_id, document_id, 1.0::double / (60 + rank) AS s FROM fts UNION ALL SELECT query_id, document_id, 0.0 FROM fill) q GROUP BY 1, 2)
SELECT query_id, document_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS position FROM total) q WHERE position <= 10"""


def near_sql(kind: str, papers: str = "1000") -> str:
    return (
        f"cast(paper_id AS varchar) IN (SELECT cast(r.paper_id % {papers} AS varchar) FROM relations r JOIN entities e"
        f" ON e.entity_id = r.source_entity_id OR e.entity_id = r.target_entity_id WHERE entity_type = '{kind}')"
    )


def preset(t, kind: str, filters: S.Filters | None = None, dims=None):
    return S.search_documents(projection(t), claim_queries(t), kind, 10, filters, **(dims or text_dims(t))).select(
        "query_id", "document_id", "score", "position"
    )


@query("q8_search_claims", preset_sql("document_type = 'CLAIM'"))
def q8(t):
    return preset(t, "claims")


@query("q8_search_evidence", preset_sql("document_type = 'EVIDENCE'"))
def q8_evidence(t):
    return preset(t, "evidence")


@query("q8_search_papers", preset_sql("document_type = 'PAPER'"))
def q8_papers(t):
    return preset(t, "papers")


# The graph channel finds every scoped document at distance 1.
@query("q8_search_methods", preset_sql(near_sql("METHOD"), "1.0::double / 62"))
def q8_methods(t):
    return preset(t, "methods")


def every_paper(t):
    """Dimension tables whose relations reach all papers, however many there are."""
    return text_dims(t, t.supplier.agg(F.max("s_suppkey") + 1).scalar())


@query("q8_search_entities", preset_sql(near_sql("AUTHOR", "(SELECT max(s_suppkey) + 1 FROM supplier)"), "1.0::double / 62"))
def q8_entities(t):
    return preset(t, "entities", S.Filters(entity_types=["AUTHOR"]), every_paper(t))


@query("q8_search_techniques", preset_sql(near_sql("METHOD"), "1.0::double / 62"))
def q8_techniques(t):
    """The given methods, stored as techniques."""
    dims = text_dims(t)
    kind = F.when(F.col("entity_type") == "METHOD", "TECHNIQUE").otherwise(F.col("entity_type"))
    dims["entities"] = dims["entities"].withColumn("entity_type", kind)
    found = S.search_documents(projection(t), claim_queries(t), "techniques", 10, **dims)
    return found.select("query_id", "document_id", "score", "position")
