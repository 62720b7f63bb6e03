"""Entities and typed relations: resolution, linking and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.session import cut_lineage


def entity_key(kind, normalized):
    return F.concat(F.lit("ent_"), F.substring(F.sha2(F.concat_ws("|", kind, normalized), 256), 1, 32))


def resolve_entities(
    mentions: DataFrame, entities: DataFrame | None = None, aliases: DataFrame | None = None
) -> DataFrame:
    """Entity of each (entity_type, name) mention: by name, then by alias, else new.

    ``entities``: entity_id, entity_type, normalized_name; ``aliases``: entity_id,
    entity_type, alias (long form). Names that normalize to nothing are rejected.
    """
    named = mentions.withColumn("normalized_name", X.normalize_entity(F.col("name")))
    keys = ["entity_type", "normalized_name"]
    out = named
    if entities is not None:
        known = entities.groupBy(*keys).agg(F.min("entity_id").alias("name_entity"))
        out = out.join(known, keys, "left")
    else:
        out = out.withColumn("name_entity", F.lit(None).cast("string"))
    if aliases is not None:
        other = (
            aliases.select(
                "entity_id", "entity_type", X.normalize_entity(F.col("alias")).alias("normalized_name")
            )
            .groupBy(*keys)
            .agg(F.min("entity_id").alias("alias_entity"))
        )
        out = out.join(other, keys, "left")
    else:
        out = out.withColumn("alias_entity", F.lit(None).cast("string"))
    found = F.coalesce("name_entity", "alias_entity")
    empty = F.col("normalized_name") == ""
    return out.withColumn(
        "entity_id",
        F.when(~empty, F.coalesce(found, entity_key(F.col("entity_type"), F.col("normalized_name")))),
    ).withColumn("created", ~empty & found.isNull()).withColumn(
        "matched_alias", F.col("name_entity").isNull() & F.col("alias_entity").isNotNull()
    ).drop("name_entity", "alias_entity")


def merge_aliases(resolved: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(entity_id, alias) rows: stored aliases plus those the mentions brought."""
    fresh = resolved.where("entity_id IS NOT NULL").select(
        "entity_id", F.explode("aliases").alias("alias")
    )
    return (fresh if stored is None else stored.select("entity_id", "alias").unionByName(fresh)).distinct()


RELATION_KEY = ["source_entity_id", "relation_type", "target_entity_id", "paper_id"]


def relation_problems(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with ``refused``: empty type, self relation or unknown endpoint."""
    known = entities.select("entity_id").distinct()
    a = known.select(F.col("entity_id").alias("source_entity_id"), F.lit(True).alias("s_known"))
    b = known.select(F.col("entity_id").alias("target_entity_id"), F.lit(True).alias("t_known"))
    return (
        edges.join(a, "source_entity_id", "left")
        .join(b, "target_entity_id", "left")
        .withColumn(
            "refused",
            F.when(F.trim("relation_type") == "", "empty_type")
            .when(F.col("source_entity_id") == F.col("target_entity_id"), "self_relation")
            .when(F.col("s_known").isNull() | F.col("t_known").isNull(), "unknown_entity"),
        )
        .drop("s_known", "t_known")
    )


def add_relations(edges: DataFrame) -> DataFrame:
    """One relation per key with the greatest confidence; a null paper is a value."""
    return (
        edges.groupBy(*RELATION_KEY)
        .agg(F.max("confidence").alias("confidence"), F.count("*").alias("mentions"))
        .withColumn(
            "relation_id",
            F.concat(F.lit("rel_"), F.substring(F.sha2(F.to_json(F.struct(*RELATION_KEY)), 256), 1, 32)),
        )
    )


def relation_evidence(edges: DataFrame) -> DataFrame:
    """Distinct evidence behind each relation, in long form."""
    return edges.where(F.col("evidence_id").isNotNull()).select(*RELATION_KEY, "evidence_id").distinct()


def claim_edges(claims: DataFrame) -> DataFrame:
    """Paper-to-subject edge of every claim whose category maps to an entity type."""
    kind = X.entity_type_for(F.col("category"))
    subject = X.claim_subject(F.col("statement"))
    confidence = (
        F.col("analysis_confidence")
        if "analysis_confidence" in claims.columns
        else F.lit(None).cast("double")
    )
    return (
        claims.select(
            "claim_id",
            "paper_id",
            kind.alias("entity_type"),
            subject.alias("name"),
            X.relation_for(F.col("category")).alias("relation_type"),
            confidence.alias("confidence"),
        )
        .where("entity_type IS NOT NULL AND name IS NOT NULL")
        .withColumn("normalized_name", X.normalize_entity(F.col("name")))
        .where("normalized_name <> ''")
        .withColumn("target_entity_id", entity_key(F.col("entity_type"), F.col("normalized_name")))
        .withColumn(
            "source_entity_id",
            entity_key(F.lit("PAPER"), X.normalize_entity(F.col("paper_id").cast("string"))),
        )
    )


def link_claims(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Relations of all claims with their claim and evidence counts."""
    edges = claim_edges(claims)
    cited = links.select("claim_id", "evidence_id").distinct().groupBy("claim_id").agg(
        F.count("*").alias("n")
    )
    return (
        edges.join(cited, "claim_id", "left")
        .groupBy("source_entity_id", "relation_type", "target_entity_id", "paper_id",
                 "entity_type", "normalized_name")
        .agg(
            F.count("*").alias("claims"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("evidence_links"),
            F.max("confidence").alias("confidence"),
        )
    )


def both_ends(relations: DataFrame) -> DataFrame:
    """Each relation twice, seen from either endpoint: node, other, direction."""
    out = relations.withColumn("node", F.col("source_entity_id")).withColumn(
        "other", F.col("target_entity_id")
    ).withColumn("direction", F.lit("OUT"))
    back = relations.withColumn("node", F.col("target_entity_id")).withColumn(
        "other", F.col("source_entity_id")
    ).withColumn("direction", F.lit("IN"))
    return out.unionByName(back)


def neighbors(
    relations: DataFrame, seeds: DataFrame, depth: int = 1, types: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first expansion from ``seeds`` (entity_id): (nodes, expanded edges).

    Nodes carry their distance; every node nearer than ``depth`` is expanded once and
    lists its relations. Only new nodes enter the next round; each round's are stored, so
    the plan of a hop does not hold those of the hops before it.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    scoped = relations if types is None else relations.where(F.col("relation_type").isin(*types))
    steps = scoped.select(
        F.explode(
            F.array(
                F.struct(F.col("source_entity_id").alias("node"), F.col("target_entity_id").alias("other")),
                F.struct(F.col("target_entity_id").alias("node"), F.col("source_entity_id").alias("other")),
            )
        ).alias("step")
    ).select("step.*")
    fresh = visited = cut_lineage(seeds.select("entity_id").distinct().withColumn("distance", F.lit(0)))
    for hop in range(1, depth + 1):
        frontier = fresh.select(F.col("entity_id").alias("node"))
        reached = steps.join(frontier, "node", "left_semi").select(F.col("other").alias("entity_id")).distinct()
        fresh = cut_lineage(
            reached.join(visited.select("entity_id"), "entity_id", "left_anti").withColumn("distance", F.lit(hop))
        )
        visited = visited.unionByName(fresh)
    ends = both_ends(scoped)
    expanded = visited.where(F.col("distance") < depth).select(F.col("entity_id").alias("node"))
    edges = ends.join(expanded, "node", "left_semi")
    return visited, edges


def entity_cards(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of every entity with direction and the other end's name.

    A relation meets its two entities once each and is seen from both ends afterwards.
    """
    named = entities.groupBy("entity_id").agg(F.collect_list(F.struct("canonical_name")).alias("names"))
    sources = named.select(F.col("entity_id").alias("source_entity_id"), F.col("names").alias("source_names"))
    targets = named.select(F.col("entity_id").alias("target_entity_id"), F.col("names").alias("target_names"))
    met = relations.select("relation_id", "relation_type", "paper_id", "source_entity_id", "target_entity_id")
    met = met.join(targets, "target_entity_id", "left").join(sources, "source_entity_id", "left")

    def seen(node: str, other: str, direction: str):
        names = F.coalesce(f"{other}_names", F.array(F.struct(F.lit(None).cast("string").alias("canonical_name"))))
        end = lambda n: F.struct(
            F.col(f"{node}_entity_id").alias("entity_id"), F.lit(direction).alias("direction"),
            F.col(f"{other}_entity_id").alias("other_id"), n["canonical_name"].alias("other_name"),
        )
        return F.when(F.col(f"{node}_names").isNotNull(), F.transform(names, end)).otherwise(F.array())

    ends = F.inline(F.concat(seen("source", "target", "OUT"), seen("target", "source", "IN")))
    return met.select("relation_id", "relation_type", "paper_id", ends).select(
        "entity_id", "relation_id", "relation_type", "direction", "other_id", "other_name", "paper_id"
    )


def capped_graph(
    nodes: DataFrame, relations: DataFrame, max_nodes: int = 40, max_edges: int = 80
) -> tuple[DataFrame, DataFrame]:
    """The part of a neighbourhood a picture can show: nearest nodes, then edges."""
    shown = nodes.orderBy("distance", "entity_id").limit(max_nodes)
    ids = shown.select("entity_id")
    inside = relations.join(
        ids.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi"
    ).join(
        ids.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi"
    )
    return shown, inside.orderBy("relation_id").limit(max_edges)
