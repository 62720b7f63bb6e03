"""Tags and collections: resolution, links, curation and memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia import tables
from evidentia.functions import text as X


def resolve_tags(names: DataFrame, tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tag of each (namespace, name): an alias first, then a canonical name, else new.

    ``aliases`` has tag_id and normalized_alias. Rejected rows carry a reason and no tag.
    """
    cleaned = names.withColumn("namespace", F.lower(F.trim("namespace"))).withColumn(
        "normalized_name", X.normalize_tag(F.col("name"))
    )
    own = tags.select("tag_id", "namespace", "normalized_name")
    by_alias = (
        aliases.select("tag_id", F.col("normalized_alias").alias("normalized_name"))
        .join(own.select("tag_id", "namespace"), "tag_id")
        .groupBy("namespace", "normalized_name")
        .agg(F.min("tag_id").alias("alias_tag"))
    )
    by_name = own.groupBy("namespace", "normalized_name").agg(F.min("tag_id").alias("name_tag"))
    keys = ["namespace", "normalized_name"]
    joined = cleaned.join(by_alias, keys, "left").join(by_name, keys, "left")
    reason = F.when(~F.col("namespace").isin(*tables.TAG_NAMESPACES), "unknown_namespace").when(
        F.col("normalized_name") == "", "empty_name"
    )
    minted = F.concat_ws("/", "namespace", "normalized_name")
    found = F.coalesce("alias_tag", "name_tag")
    return joined.select(
        "namespace",
        "name",
        "normalized_name",
        F.when(reason.isNull(), F.coalesce(found, minted)).alias("tag_id"),
        (reason.isNull() & found.isNull()).alias("created"),
        F.col("alias_tag").isNotNull().alias("matched_alias"),
        reason.alias("rejected"),
    )


def alias_conflicts(requested: DataFrame, aliases: DataFrame) -> DataFrame:
    """Requested (tag_id, alias) rows whose alias already belongs to another tag."""
    wanted = requested.select(
        "tag_id", "alias", X.normalize_tag(F.col("alias")).alias("normalized_alias")
    )
    owner = aliases.select("normalized_alias", F.col("tag_id").alias("owner_tag_id"))
    return wanted.join(owner, "normalized_alias").where(F.col("tag_id") != F.col("owner_tag_id"))


def attach_tags(links: DataFrame) -> DataFrame:
    """One link per (paper, tag); it is a candidate only if every offer was."""
    return links.groupBy("paper_id", "tag_id").agg(F.bool_and("is_candidate").alias("is_candidate"))


def promote(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links with the candidate flag cleared for the chosen (paper_id, tag_id) rows."""
    picked = chosen.select("paper_id", "tag_id").distinct().withColumn("picked", F.lit(True))
    return links.join(picked, ["paper_id", "tag_id"], "left").select(
        "paper_id",
        "tag_id",
        (F.col("is_candidate") & F.col("picked").isNull()).alias("is_candidate"),
    )


def action_preview(paper_tags: DataFrame, tag_ids: DataFrame) -> DataFrame:
    """Papers a curation action would touch."""
    return paper_tags.join(tag_ids.select("tag_id"), "tag_id", "left_semi").select("paper_id").distinct()


def confirm_tags(paper_tags: DataFrame, tag_ids: DataFrame) -> DataFrame:
    marked = tag_ids.select("tag_id").distinct().withColumn("picked", F.lit(True))
    return paper_tags.join(marked, "tag_id", "left").select(
        "paper_id", "tag_id", (F.col("is_candidate") & F.col("picked").isNull()).alias("is_candidate")
    )


def rename_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Tags with new names from (tag_id, new_name); blank names change nothing."""
    wanted = names.select("tag_id", "new_name", X.normalize_tag(F.col("new_name")).alias("new_norm")).where(
        "new_norm <> ''"
    )
    return tags.join(wanted, "tag_id", "left").select(
        "tag_id",
        "namespace",
        F.coalesce("new_name", "canonical_name").alias("canonical_name"),
        F.coalesce("new_norm", "normalized_name").alias("normalized_name"),
    )


def merge_conflicts(moves: DataFrame, tags: DataFrame) -> DataFrame:
    """Moves (tag_id, target_id) that cross namespaces or name an unknown tag."""
    a = tags.select("tag_id", F.col("namespace").alias("from_ns"))
    b = tags.select(F.col("tag_id").alias("target_id"), F.col("namespace").alias("to_ns"))
    joined = moves.join(a, "tag_id", "left").join(b, "target_id", "left")
    return joined.withColumn(
        "conflict",
        F.when(F.col("from_ns").isNull() | F.col("to_ns").isNull(), "unknown_tag").when(
            F.col("from_ns") != F.col("to_ns"), "namespace_conflict"
        ),
    ).where("conflict IS NOT NULL").select("tag_id", "target_id", "conflict")


def merge_paper_tags(paper_tags: DataFrame, moves: DataFrame) -> DataFrame:
    """Paper links after merging: owners deduplicated, moved links confirmed."""
    real = moves.where("tag_id <> target_id").dropDuplicates(["tag_id"])
    joined = paper_tags.join(real, "tag_id", "left")
    return (
        joined.select(
            "paper_id",
            F.coalesce("target_id", "tag_id").alias("tag_id"),
            F.when(F.col("target_id").isNotNull(), False).otherwise(F.col("is_candidate")).alias("is_candidate"),
        )
        .groupBy("paper_id", "tag_id")
        .agg(F.bool_and("is_candidate").alias("is_candidate"))
    )


def merge_aliases(aliases: DataFrame, tags: DataFrame, moves: DataFrame) -> DataFrame:
    """Aliases after merging: re-pointed, plus the merged tags' own names."""
    real = moves.where("tag_id <> target_id").dropDuplicates(["tag_id"])
    moved = aliases.select("tag_id", "normalized_alias").join(real, "tag_id", "left").select(
        F.coalesce("target_id", "tag_id").alias("tag_id"), "normalized_alias"
    )
    names = tags.join(real, "tag_id").select(
        F.col("target_id").alias("tag_id"), F.col("normalized_name").alias("normalized_alias")
    )
    return moved.unionByName(names).distinct()


def candidate_tags_from_claims(claims: DataFrame) -> DataFrame:
    """(paper, namespace, name) candidates from ``namespace.name`` claim categories."""
    ns = X.category_namespace(F.col("category"))
    rest = F.expr("substr(category, instr(category, '.') + 1)")
    return (
        claims.where(F.instr("category", ".") > 0)
        .select("paper_id", ns.alias("namespace"), rest.alias("name"))
        .where(F.col("namespace").isin(*tables.TAG_NAMESPACES) & (F.col("name") != ""))
        .distinct()
    )


def upsert_memberships(
    existing: DataFrame,
    batch: DataFrame,
    collections: DataFrame,
    papers: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(memberships, refused rows) after adding a batch of collection papers.

    Pinning is only ever set; an override or a note replaces the old one when given.
    The batch's later rows (by ``added_at``) win among themselves.
    """
    known = batch.join(collections.select("collection_id"), "collection_id", "left_semi").join(
        papers.select("paper_id"), "paper_id", "left_semi"
    )
    keys = ["collection_id", "paper_id"]
    refused = batch.join(known.select(*keys).distinct(), keys, "left_anti").select(*keys).distinct()

    def last(column: str):
        given = F.col(column).isNotNull()
        return F.max_by(F.when(given, F.col(column)), F.when(given, F.col("added_at")))

    merged = known.groupBy(*keys).agg(
        F.bool_or("pinned").alias("new_pinned"),
        last("priority_override_tier").alias("new_tier"),
        last("note").alias("new_note"),
    )
    out = existing.join(merged, keys, "full_outer").select(
        *keys,
        (F.coalesce("pinned", F.lit(False)) | F.coalesce("new_pinned", F.lit(False))).alias("pinned"),
        F.coalesce("new_tier", "priority_override_tier").alias("priority_override_tier"),
        F.coalesce("new_note", "note").alias("note"),
    )
    return out, refused


def remove_memberships(existing: DataFrame, removed: DataFrame) -> DataFrame:
    keys = ["collection_id", "paper_id"]
    return existing.join(removed.select(*keys), keys, "left_anti")


def triage(papers: DataFrame, memberships: DataFrame) -> DataFrame:
    """Depth decision per paper (paper_id, requested_tier) from its memberships.

    An override wins, the most recently added one where several exist; a pinned
    paper is read at least in full.
    """
    facts = memberships.groupBy("paper_id").agg(
        F.bool_or("pinned").alias("pinned"),
        F.max_by(
            "priority_override_tier",
            F.when(F.col("priority_override_tier").isNotNull(), F.struct("added_at", "collection_id")),
        ).alias("override"),
    )
    joined = papers.join(facts, "paper_id", "left").withColumn(
        "pinned", F.coalesce("pinned", F.lit(False))
    )
    # Tier names sort by depth.
    lifts = F.col("pinned") & (F.col("override").isNull() | (F.col("override") < "T2_FULL"))
    recommended = F.when(lifts, F.greatest("requested_tier", F.lit("T2_FULL"))).otherwise(
        F.col("requested_tier")
    )
    effective = F.coalesce("override", recommended)
    manual = F.col("override").isNotNull()
    codes = F.array_compact(
        F.array(
            F.when(manual, F.lit("COLLECTION_PRIORITY_OVERRIDE")),
            F.when(F.col("pinned"), F.lit("USER_PINNED")),
            F.when(~manual & (F.col("requested_tier") != effective), F.lit("PINNED_UPGRADE")),
        )
    )
    return joined.select(
        "paper_id",
        "requested_tier",
        recommended.alias("recommended_tier"),
        effective.alias("effective_tier"),
        manual.alias("manual_override"),
        F.when(F.size(codes) == 0, F.array(F.lit("REQUESTED_TIER"))).otherwise(codes).alias("reason_codes"),
        F.when(F.col("pinned"), 1.0).otherwise(0.0).alias("user_relevance"),
    )
