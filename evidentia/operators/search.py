"""Search projection, full-text and vector channels, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import keyed
from evidentia.session import cut_lineage, stored

RRF_K = 60
MAX_LIMIT = 200
#: Query vectors that travel to every task at once; more are searched block by block.
QUERY_BLOCK = 1000
WORD = r"[\p{L}\p{N}]+"

# ---- projection ------------------------------------------------------------------

SCOPE_COLUMNS = (
    "document_id string, document_type string, paper_id string, paper_version_id string,"
    " section_id string, evidence_type string, claim_type string, category string,"
    " support_state string, page_start int, content string, index_text string,"
    " content_sha256 string"
)


def build_projection(evidence: DataFrame, claims: DataFrame, papers: DataFrame) -> DataFrame:
    """One search document per text-bearing evidence row, claim and paper.

    ``evidence`` carries paper_id. Claims are indexed with their category but show the
    statement; their hash includes the support state.
    """
    names = [c.strip().split(" ")[0] for c in SCOPE_COLUMNS.split(",")]

    def shaped(df: DataFrame, **columns) -> DataFrame:
        return df.select(
            *[
                columns.get(n, F.lit(None)).cast("int" if n == "page_start" else "string").alias(n)
                for n in names
            ]
        )

    joined = F.concat(F.col("category"), F.lit(": "), F.col("statement"))
    title = F.concat_ws(
        " ", *[F.col(c) for c in ("canonical_title", "doi", "paper_type") if c in papers.columns]
    )
    rows = shaped(
        evidence.where(F.length(F.trim("text")) > 0),
        document_id=F.col("evidence_id"),
        document_type=F.lit("EVIDENCE"),
        paper_id=F.col("paper_id"),
        paper_version_id=F.col("paper_version_id"),
        section_id=F.col("section_id"),
        evidence_type=F.col("evidence_type"),
        page_start=F.col("page_start"),
        content=F.col("text"),
        index_text=F.col("text"),
        content_sha256=F.sha2("text", 256),
    )
    rows = rows.unionByName(
        shaped(
            claims,
            document_id=F.col("claim_id"),
            document_type=F.lit("CLAIM"),
            paper_id=F.col("paper_id"),
            paper_version_id=F.col("paper_version_id"),
            claim_type=F.col("claim_type"),
            category=F.col("category"),
            support_state=F.col("support_state"),
            content=F.col("statement"),
            index_text=joined,
            content_sha256=F.sha2(F.concat_ws("\x1f", joined, F.col("support_state")), 256),
        )
    )
    return rows.unionByName(
        shaped(
            papers.where(title != ""),
            document_id=F.col("paper_id"),
            document_type=F.lit("PAPER"),
            paper_id=F.col("paper_id"),
            content=title,
            index_text=title,
            content_sha256=F.sha2(title, 256),
        )
    )


def refresh_projection(old: DataFrame, new: DataFrame) -> DataFrame:
    """New documents marked ``written`` (new, changed text or other model) or ``reused``.

    ``old`` and ``new``: document_id, content_sha256 and optionally embedding_model_id.
    """
    before = old.select("document_id", F.col("content_sha256").alias("old_hash"), *(
        [F.col("embedding_model_id").alias("old_model")] if "embedding_model_id" in old.columns else []
    ))
    joined = new.join(before, "document_id", "left")
    same = F.col("content_sha256").eqNullSafe(F.col("old_hash"))
    if "embedding_model_id" in old.columns and "embedding_model_id" in new.columns:
        same = same & F.col("embedding_model_id").eqNullSafe(F.col("old_model"))
    return joined.withColumn("outcome", F.when(same, "reused").otherwise("written")).drop(
        "old_hash", "old_model"
    )


def document_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("document_type").agg(F.count("*").alias("documents"))


# ---- scope -----------------------------------------------------------------------


@dataclass
class Filters:
    """Exact search filters; None means no restriction, empty lists match nothing."""

    document_types: list | None = None
    paper_ids: list | None = None
    paper_version_ids: list | None = None
    evidence_types: list | None = None
    claim_types: list | None = None
    categories: list | None = None
    support_states: list | None = None
    page_min: int | None = None
    page_max: int | None = None
    section_classes: list | None = None
    section_ids: list | None = None
    collection_ids: list | None = None
    tag_namespaces: list | None = None
    tag_names: list | None = None
    entity_ids: list | None = None
    entity_types: list | None = None

    def wants_entities(self) -> bool:
        return self.entity_ids is not None or self.entity_types is not None


def matching_entities(entities: DataFrame, filters: Filters) -> DataFrame:
    out = entities
    if filters.entity_ids is not None:
        out = out.where(F.col("entity_id").isin(*filters.entity_ids))
    if filters.entity_types is not None:
        out = out.where(F.col("entity_type").isin(*filters.entity_types))
    return out.select("entity_id")


def entity_scope(relations: DataFrame, entities: DataFrame, filters: Filters) -> DataFrame:
    """Papers with a relation at a matching entity; no such entity, no papers."""
    wanted = matching_entities(entities, filters)
    placed = relations.where(F.col("paper_id").isNotNull())
    ends = placed.select("paper_id", F.col("source_entity_id").alias("entity_id")).unionByName(
        placed.select("paper_id", F.col("target_entity_id").alias("entity_id"))
    )
    return ends.join(wanted, "entity_id", "left_semi").select("paper_id").distinct()


def require_collections(collections: DataFrame, wanted: list) -> None:
    """Raise if a wanted collection does not exist."""
    known = {r[0] for r in collections.where(F.col("collection_id").isin(*wanted)).select("collection_id").collect()}
    if missing := [c for c in wanted if c not in known]:
        raise ValueError(f"unknown collection {missing[0]!r}")


def search_scope(
    docs: DataFrame,
    filters: Filters,
    sections: DataFrame | None = None,
    members: DataFrame | None = None,
    paper_tags: DataFrame | None = None,
    tags: DataFrame | None = None,
    relations: DataFrame | None = None,
    entities: DataFrame | None = None,
    collections: DataFrame | None = None,
) -> DataFrame:
    """The documents every channel is limited to: all given filters at once.

    With ``collections`` given, an unknown collection is an error.
    """
    out = docs
    for column, wanted in (
        ("document_type", filters.document_types),
        ("paper_id", filters.paper_ids),
        ("paper_version_id", filters.paper_version_ids),
        ("evidence_type", filters.evidence_types),
        ("claim_type", filters.claim_types),
        ("category", filters.categories),
        ("support_state", filters.support_states),
    ):
        if wanted is not None:
            out = out.where(F.col(column).isin(*wanted) if wanted else F.lit(False))
    if filters.page_min is not None:
        out = out.where(F.col("page_start") >= filters.page_min)
    if filters.page_max is not None:
        out = out.where(F.col("page_start") <= filters.page_max)
    if filters.section_classes is not None or filters.section_ids is not None:
        dim = sections
        if filters.section_classes is not None:
            dim = dim.where(F.col("normalized_class").isin(*filters.section_classes))
        if filters.section_ids is not None:
            dim = dim.where(F.col("section_id").isin(*filters.section_ids))
        out = out.join(dim.select("section_id"), "section_id", "left_semi")
    if filters.collection_ids is not None:
        if collections is not None:
            require_collections(collections, filters.collection_ids)
        dim = members.where(F.col("collection_id").isin(*filters.collection_ids))
        out = out.join(dim.select("paper_id"), "paper_id", "left_semi")
    if filters.tag_namespaces is not None or filters.tag_names is not None:
        dim = tags
        if filters.tag_namespaces is not None:
            dim = dim.where(F.col("namespace").isin(*filters.tag_namespaces))
        if filters.tag_names is not None:
            dim = dim.where(F.col("normalized_name").isin(*filters.tag_names))
        tagged = paper_tags.join(dim.select("tag_id"), "tag_id", "left_semi")
        out = out.join(tagged.select("paper_id"), "paper_id", "left_semi")
    if filters.wants_entities():
        out = out.join(entity_scope(relations, entities, filters), "paper_id", "left_semi")
    return out


# ---- full text -------------------------------------------------------------------


def words(text):
    return F.transform(X.all_matches(text, WORD), F.lower)


def postings(docs: DataFrame, text: str = "index_text") -> DataFrame:
    """(token, document_id, tf, doc_len) of every document."""
    tokens = docs.select("document_id", words(F.col(text)).alias("tokens")).withColumn(
        "doc_len", F.size("tokens")
    )
    return (
        tokens.select("document_id", "doc_len", F.explode("tokens").alias("token"))
        .groupBy("token", "document_id", "doc_len")
        .agg(F.count("*").alias("tf"))
    )


#: Asked words that go to the documents as one list; more are joined.
FEW_WORDS = 10_000


def _few(words_: DataFrame) -> list[str] | None:
    """The words, or None if they are too many for one list."""
    rows = [r[0] for r in words_.limit(FEW_WORDS + 1).collect()]
    return rows if len(rows) <= FEW_WORDS else None


def _asked_words(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """document_id, doc_len, tfs: the asked words of every document with their counts."""
    few = _few(asked)
    if few is not None:
        found = F.filter("tokens", lambda w: w.isin(few) if few else F.lit(False))
        held = tokens.select("document_id", "doc_len", found.alias("found"))
        one = F.array_distinct("found")
        count = F.transform(one, lambda w: (F.size("found") - F.size(F.array_remove("found", w))).cast("long"))
        return held.select("document_id", "doc_len", F.map_from_arrays(one, count).alias("tfs"))
    each = tokens.select("document_id", F.explode("tokens").alias("token")).join(asked, "token", "left_semi")
    counted = each.groupBy("document_id", "token").agg(F.count("*").alias("tf"))
    maps = counted.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "tf"))).alias("tfs"))
    none = F.create_map().cast("map<string,bigint>")
    return tokens.select("document_id", "doc_len").join(maps, "document_id", "left").withColumn("tfs", F.coalesce("tfs", none))


def fts(
    docs: DataFrame, queries: DataFrame, text: str = "index_text", k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """Documents that hold all words of a query, scored by BM25 and ranked per query.

    ``docs``: document_id and ``text``, one row per document; ``queries``: query_id, query. A
    document keeps the asked words it has, with their counts, and meets a query by the query's
    rarest word alone; the others are looked up in the document's own words. So a word that all
    documents have moves nothing. Document lengths are sizes of the word lists. Scores are
    rounded so that equal documents tie, and ties are ordered by document. Ranks are exact for
    any number of matches.
    """
    terms = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("terms")).where(F.size("terms") > 0)
    asked = terms.select(F.explode("terms").alias("token")).distinct()
    tokens = docs.select("document_id", words(F.col(text)).alias("tokens")).withColumn("doc_len", F.size("tokens"))
    held = stored(_asked_words(tokens.where("doc_len > 0"), asked))
    figures = held.agg(F.struct(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))).scalar()
    frequency = held.select(F.explode(F.map_keys("tfs")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    asked_of = (
        terms.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("token"))
        .join(frequency, "token")
        .groupBy("query_id", "n_terms")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("parts"))
        .where(F.size("parts") == F.col("n_terms"))  # a word that no document has finds nothing
        .select("query_id", "parts", F.col("parts")[0]["token"].alias("token"))
    )
    asked_of = cut_lineage(asked_of)
    few = _few(asked_of.select("token").distinct())
    led = F.map_keys("tfs")
    if few is not None:
        led = F.filter(led, lambda w: w.isin(few) if few else F.lit(False))
    met = held.select("document_id", "doc_len", "tfs", F.explode(led).alias("token")).join(asked_of, "token")
    tf = lambda p: F.element_at("tfs", p["token"])
    idf = lambda p: F.log(1 + (F.col("corpus.n_docs") - p["df"] + 0.5) / (p["df"] + 0.5))
    weight = lambda p: tf(p) * (k1 + 1) / (
        tf(p) + k1 * (1 - b + b * F.col("doc_len") / F.col("corpus.avg_len"))
    )
    scored = (
        met.where(F.forall("parts", lambda p: F.map_contains_key(F.col("tfs"), p["token"])))
        .withColumn("corpus", figures)
        .withColumn("score", F.round(F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + idf(p) * weight(p)), 6))
        .select("query_id", "document_id", "score", (-F.col("score")).alias("_order"))
    )
    ranked = keyed.number_in_key(
        scored, ["query_id"], ["_order", "document_id"], None, "rank"
    )
    return ranked.select("query_id", "document_id", "score", "rank")


# ---- vectors ---------------------------------------------------------------------


def query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and unit vectors of all queries, about ``block`` at a time."""
    known = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    blocks = max(1, -(-known.count() // block))
    place = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    for i in range(blocks):
        rows = known.where(place == i).collect()
        if rows:
            matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield [r["query_id"] for r in rows], matrix / np.where(norms > 0, norms, 1)


def best_of_block(ids: list, matrix: np.ndarray, k: int):
    """Scores each Arrow batch by one matrix product, cut to the best k per query."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.array(batch["embedding"].tolist(), dtype=np.float64)
            norms = np.linalg.norm(vectors, axis=1)
            keep = norms > 0
            documents = batch["document_id"].to_numpy()[keep]
            if not len(documents):
                continue
            sims = np.round((vectors[keep] / norms[keep, None]) @ matrix.T, 6)
            parts = []
            for column, query_id in enumerate(ids):
                near = np.arange(len(documents))
                if len(documents) > k:  # all that tie with the k-th stay until documents order them
                    least = -np.partition(-sims[:, column], k - 1)[k - 1]
                    near = np.flatnonzero(sims[:, column] >= least)
                order = near[np.lexsort((documents[near], -sims[near, column]))[:k]]
                parts.append(
                    pd.DataFrame(
                        {
                            "query_id": [query_id] * len(order),
                            "document_id": documents[order],
                            "similarity": sims[order, column],
                        }
                    )
                )
            yield pd.concat(parts)

    return score


def semantic(docs: DataFrame, queries: DataFrame, limit: int = 20, block: int = QUERY_BLOCK) -> DataFrame:
    """Best max(3 * limit, 20) documents per query by cosine, exact.

    ``docs``: document_id, embedding; ``queries``: query_id, vector. Queries go to the tasks
    in blocks, each over all documents; only the best k of a batch are shuffled.
    """
    k = max(3 * limit, 20)
    id_type = queries.schema["query_id"].dataType.simpleString()
    doc_type = docs.schema["document_id"].dataType.simpleString()
    schema = f"query_id {id_type}, document_id {doc_type}, similarity double"
    source = docs.where(F.col("embedding").isNotNull()).select("document_id", "embedding")
    best = None
    for ids, matrix in query_blocks(queries, block):
        part = source.mapInPandas(best_of_block(ids, matrix, k), schema)
        best = part if best is None else best.unionAll(part)
    if best is None:
        best = docs.sparkSession.createDataFrame([], schema)
    items = best.select(
        "query_id", F.struct((-F.col("similarity")).alias("o"), "document_id").alias("item")
    )
    top = keyed.top_k_items(items, ["query_id"], "item", k)
    return top.select("query_id", F.posexplode("items").alias("p", "item")).select(
        "query_id",
        "item.document_id",
        (-F.col("item.o")).alias("similarity"),
        (F.col("p") + 1).cast("long").alias("rank"),
    )


def hash_embed(docs: DataFrame, dims: int = 64, text: str = "content") -> DataFrame:
    """Deterministic signed token-hash vectors of unit length; empty text gives e0."""
    digest = F.sha2("token", 256)
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dims
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    cells = (
        docs.select(
            "document_id",
            F.explode(F.transform(X.all_matches(F.col(text), X.EMBED_TOKEN), F.lower)).alias("token"),
        )
        .groupBy("document_id", bucket.alias("bucket"))
        .agg(F.sum(sign).alias("v"))
        .groupBy("document_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("bucket", "v"))).alias("cells"))
    )
    raw = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")),
        lambda i: F.coalesce(F.element_at(F.col("cells"), i), F.lit(0)).cast("double"),
    )
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, v: a + v * v))
    e0 = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(i == 0, 1.0).otherwise(0.0)
    )
    return (
        docs.select("document_id")
        .join(cells, "document_id", "left")
        .withColumn("raw", F.when(F.col("cells").isNotNull(), raw))
        .withColumn("norm", norm)
        .select(
            "document_id",
            F.when(F.col("norm") > 0, F.transform("raw", lambda v: v / F.col("norm")))
            .otherwise(e0)
            .alias("embedding"),
        )
    )


def check_vectors(docs: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """Documents and vectors that do not pair up one to one with ``dims`` numbers."""
    per = vectors.groupBy("document_id").agg(
        F.count("*").alias("vectors"),
        F.min(F.size("embedding")).alias("low"),
        F.max(F.size("embedding")).alias("high"),
    )
    known = docs.select("document_id").distinct().withColumn("known", F.lit(True))
    problem = (
        F.when(F.col("known").isNull(), "no_document")
        .when(F.col("vectors").isNull(), "no_vector")
        .when(F.col("vectors") > 1, "several_vectors")
        .when((F.col("low") != dims) | (F.col("high") != dims), "wrong_dimension")
    )
    return (
        known.join(per, "document_id", "full_outer")
        .select("document_id", problem.alias("problem"))
        .where("problem IS NOT NULL")
    )


# ---- graph channel and fusion ------------------------------------------------------


def graph_channel(
    docs: DataFrame, relations: DataFrame, entities: DataFrame, filters: Filters
) -> DataFrame:
    """Scoped documents whose paper shares a relation with a matching entity."""
    near = entity_scope(relations, entities, filters)
    return docs.join(near, "paper_id", "left_semi").select("document_id").withColumn(
        "distance", F.lit(1)
    )


def as_array(few: DataFrame):
    """The ids of a limited frame (at most 2 * MAX_LIMIT rows) as one array."""
    return few.agg(F.collect_list("document_id")).scalar()


def hybrid_search(
    scope: DataFrame,
    queries: DataFrame,
    limit: int = 20,
    *,
    graph: DataFrame | None = None,
    text: str = "index_text",
) -> DataFrame:
    """Reciprocal rank fusion of the channels, best ``limit`` documents per query.

    ``queries``: query_id, query and optionally vector (without one the semantic
    channel is skipped and ``warning`` says so). Every scoped document is a candidate;
    those no channel found have score 0 and follow in document order, so only the
    first 2 * limit of them can ever be shown.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    vectors = "vector" in queries.columns and "embedding" in scope.columns
    ids = queries.select("query_id").distinct()
    text_hits = fts(scope, queries, text)
    parts = text_hits.select(
        "query_id", "document_id", F.lit("fts").alias("channel"), (1.0 / (RRF_K + F.col("rank"))).alias("part")
    )
    if vectors:
        near = semantic(scope, queries, limit)
        parts = parts.unionByName(
            near.select(
                "query_id", "document_id", F.lit("semantic").alias("channel"),
                (1.0 / (RRF_K + F.col("rank"))).alias("part"),
            )
        )
    first = scope.select("document_id").orderBy("document_id").limit(2 * limit)
    fill = ids.select(
        "query_id", F.explode(as_array(first)).alias("document_id"), F.lit("filters").alias("channel"),
        F.lit(0.0).alias("part"),
    )
    parts = parts.unionByName(fill)
    scored = parts.groupBy("query_id", "document_id").agg(
        F.sum("part").alias("score"),
        F.max(F.when(F.col("channel") == "fts", 1).otherwise(0)).alias("in_fts"),
        F.max(F.when(F.col("channel") == "semantic", 1).otherwise(0)).alias("in_semantic"),
    )
    if graph is not None:
        # Every document of the graph channel gains the same amount for every query.
        gain = graph.groupBy("document_id").agg(F.min("distance").alias("distance"))
        seeded = gain.orderBy("distance", "document_id").limit(2 * limit).select("document_id")
        more = ids.select(
            "query_id", F.explode(as_array(seeded)).alias("document_id"), F.lit(0.0).alias("score"),
            F.lit(0).alias("in_fts"), F.lit(0).alias("in_semantic"),
        )
        scored = (
            scored.unionByName(more)
            .groupBy("query_id", "document_id")
            .agg(*[F.max(c).alias(c) for c in ("score", "in_fts", "in_semantic")])
            .join(gain, "document_id", "left")
            .withColumn(
                "score",
                F.col("score")
                + F.coalesce(1.0 / (RRF_K + 1 + F.col("distance")), F.lit(0.0)),
            )
        )
    else:
        scored = scored.withColumn("distance", F.lit(None).cast("int"))
    items = scored.select(
        "query_id",
        F.struct(
            (-F.round("score", 8)).alias("o"), "document_id", "in_fts", "in_semantic", "distance"
        ).alias("item"),
    )
    top = keyed.top_k_items(items, ["query_id"], "item", limit)
    hits = top.select("query_id", F.posexplode("items").alias("p", "item"))
    shown = scope.select("document_id", F.substring("content", 1, 240).alias("excerpt"))
    channels = F.array_compact(
        F.array(
            F.lit("filters"),
            F.when(F.col("item.in_fts") == 1, F.lit("fts")),
            F.when(F.col("item.in_semantic") == 1, F.lit("semantic")),
            F.when(F.col("item.distance").isNotNull(), F.lit("graph")),
        )
    )
    size = scope.agg(F.count("*").alias("scope_size"))
    warning = None if vectors else "semantic channel skipped: no query vectors"
    return (
        hits.select(
            "query_id",
            (F.col("p") + 1).cast("long").alias("position"),
            "item.document_id",
            (-F.col("item.o")).alias("score"),
            channels.alias("channels"),
        )
        .join(shown, "document_id")
        .withColumn("scope_size", size.scalar())
        .withColumn("warning", F.lit(warning).cast("string"))
    )


def search_documents(
    docs: DataFrame, queries: DataFrame, kind: str, limit: int = 20, filters: Filters | None = None, **dims
) -> DataFrame:
    """Preset searches: papers, claims, evidence, entities, techniques, methods."""
    filters = filters or Filters()
    presets = {
        "papers": {"document_types": ["PAPER"]},
        "claims": {"document_types": ["CLAIM"]},
        "evidence": {"document_types": ["EVIDENCE"]},
        "entities": {},
        "techniques": {"entity_types": ["TECHNIQUE"]},
        "methods": {"entity_types": ["METHOD"]},
    }
    if kind not in presets:
        raise ValueError(f"unknown search kind {kind!r}")
    for name, value in presets[kind].items():
        filters = replace(filters, **{name: value})
    scope = search_scope(docs, filters, **dims)
    graph = (
        graph_channel(scope, dims["relations"], dims["entities"], filters)
        if filters.wants_entities()
        else None
    )
    return hybrid_search(scope, queries, limit, graph=graph)
