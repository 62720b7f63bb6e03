"""The claim ledger: appending validated claims, revisions and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X


def candidate_problems(candidates: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Why a candidate is refused (null = acceptable), one row per candidate."""
    cited = (
        links.join(
            evidence.select("evidence_id", F.col("paper_version_id").alias("home")),
            "evidence_id",
            "left",
        )
        .join(candidates.select("candidate_id", "paper_version_id"), "candidate_id")
        .groupBy("candidate_id")
        .agg(
            F.count("*").alias("links"),
            F.bool_or(F.col("role") == "SUPPORT").alias("supported"),
            F.bool_or(F.col("home").isNull()).alias("unknown"),
            F.bool_or(F.col("home") != F.col("paper_version_id")).alias("foreign"),
        )
    )
    joined = candidates.join(cited, "candidate_id", "left")
    problem = (
        F.when(F.col("claim_type") == "EXTERNAL", "external_refused")
        .when((F.col("claim_type") == "FACT") & ~F.coalesce("supported", F.lit(False)),
              "fact_without_support")
        .when(F.col("links").isNull(), "no_evidence")
        .when(F.col("unknown"), "unknown_evidence")
        .when(F.coalesce("foreign", F.lit(False)), "evidence_of_other_version")
    )
    return joined.withColumn("problem", problem).drop("links", "supported", "unknown", "foreign")


def ledger_append(candidates: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims to append: one per (run, normalized statement), all UNVERIFIED.

    A run with any refused candidate is refused whole. The earliest candidate of a
    statement is kept; ``copies`` counts what it stands for.
    """
    judged = candidate_problems(candidates, links, evidence)
    bad_runs = judged.where(F.col("problem").isNotNull()).select("run_id").distinct()
    good = judged.join(bad_runs, "run_id", "left_anti").withColumn(
        "normalized_statement", X.normalize_statement(F.col("statement"))
    )
    first = F.struct("ordinal", "candidate_id", "claim_type", "category", "statement")
    return (
        good.groupBy("run_id", "paper_version_id", "normalized_statement")
        .agg(F.min(first).alias("first"), F.count("*").alias("copies"))
        .select(
            F.col("first.candidate_id").alias("candidate_id"),
            F.concat(
                F.lit("clm_"), F.sha2(F.concat_ws("|", "run_id", "normalized_statement"), 256)
            ).alias("claim_id"),
            "run_id",
            "paper_version_id",
            "first.claim_type",
            "first.category",
            "first.statement",
            "normalized_statement",
            F.lit("UNVERIFIED").alias("support_state"),
            "copies",
        )
    )


def ledger_links(appended: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct evidence links of the appended claims."""
    return (
        appended.select("candidate_id", "claim_id")
        .join(links, "candidate_id")
        .select("claim_id", "evidence_id", "role")
        .distinct()
    )


EXTERNAL_KEYS = ("title", "authors", "venue", "year", "doi")


def external_claims(records: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One EXTERNAL claim per present key of a metadata record.

    ``records``: provider, identifier, paper_version_id, content_hash and the five
    keys as JSON text. Records already stored (same version, provider, identifier
    and hash) give nothing.
    """
    keys = ["paper_version_id", "provider", "identifier", "content_hash"]
    fresh = records.dropDuplicates(keys)
    if existing is not None:
        fresh = fresh.join(existing.select(*keys), keys, "left_anti")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in EXTERNAL_KEYS])
    return (
        fresh.withColumn("pair", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())))
        .withColumn("statement", F.concat("pair.key", F.lit(": "), "pair.value"))
        .select(
            *keys,
            F.concat(
                F.lit("clm_"), F.sha2(F.concat_ws("|", *keys, F.col("pair.key")), 256)
            ).alias("claim_id"),
            F.concat(F.lit("external.metadata."), "pair.key").alias("category"),
            "statement",
            X.normalize_statement(F.col("statement")).alias("normalized_statement"),
        )
    )


def materialize_findings(
    findings: DataFrame, sources: DataFrame, claims: DataFrame, links: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turn findings into claims that cite their sources' evidence as CONTEXT.

    ``findings``: finding_id, paper_id, paper_version_id, category, statement;
    ``sources``: finding_id, claim_id. Returns (claims, links, refused).
    """
    checked = sources.distinct().join(
        claims.select("claim_id").withColumn("known", F.lit(True)), "claim_id", "left"
    )
    cites = (
        checked.join(links.select("claim_id", "evidence_id"), "claim_id")
        .select("finding_id", "evidence_id")
        .distinct()
    )
    state = checked.groupBy("finding_id").agg(F.bool_or(F.col("known").isNull()).alias("unknown"))
    backed = cites.groupBy("finding_id").agg(F.count("*").alias("evidence_count"))
    judged = (
        findings.join(state, "finding_id", "left")
        .join(backed, "finding_id", "left")
        .withColumn(
            "refused",
            F.when(F.col("unknown").isNull(), "no_source_claims")
            .when(F.col("unknown"), "unknown_source_claim")
            .when(F.col("evidence_count").isNull(), "no_evidence"),
        )
    )
    accepted = judged.where(F.col("refused").isNull()).withColumn(
        "claim_id", F.concat(F.lit("clm_"), F.sha2(F.col("finding_id").cast("string"), 256))
    )
    new_claims = accepted.select(
        "claim_id",
        "finding_id",
        "paper_id",
        "paper_version_id",
        "category",
        "statement",
        F.lit("UNVERIFIED").alias("support_state"),
        "evidence_count",
    )
    new_links = (
        accepted.select("finding_id", "claim_id")
        .join(cites, "finding_id")
        .select("claim_id", "evidence_id", F.lit("CONTEXT").alias("role"))
    )
    refused = judged.where(F.col("refused").isNotNull()).select("finding_id", "refused")
    return new_claims, new_links, refused


def claim_revision(claims: DataFrame) -> DataFrame:
    """Token that changes whenever the reviewed content of a claim changes."""
    superseded = (
        F.coalesce("superseded_by_claim_id", F.lit(""))
        if "superseded_by_claim_id" in claims.columns
        else F.lit("")
    )
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    return claims.select(
        "claim_id",
        X.short_hash(
            F.col("claim_id"), F.col("support_state"), F.col("statement"), stamp, superseded
        ).alias("revision"),
    )


def selection_hash(ids: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Order-free fingerprint of a selection of identifiers per key.

    Each identifier is hashed on its own and the hashes are summed, so a selection
    of any size is fingerprinted with a plain map-side aggregate.
    """
    one = F.conv(F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 12), 16, 10)
    return (
        ids.select(*keys, column)
        .distinct()
        .groupBy(*keys)
        .agg(
            F.count("*").alias("selected"),
            F.sum(one.cast("decimal(38,0)")).alias("total"),
        )
        .select(
            *keys,
            "selected",
            X.short_hash(F.col("selected").cast("string"), F.col("total").cast("string")).alias(
                "selection_hash"
            ),
        )
    )


#: Levels of a tree of 256 branches; leaves of about as many members: enough for 10**12 members.
MERKLE_LEVELS = 4
MERKLE_LEAF = 256


def merkle_hash(ids: DataFrame, keys: list[str], column: str, leaf: int = MERKLE_LEAF) -> DataFrame:
    """A tree hash of the set of identifiers per key: keys, selected, depth, selection_hash.

    Members are ordered by their own sha-256, whose leading bytes name the block they are in:
    a block is a few hundred members at any size of the set, and its hash covers them in order.
    Blocks with the same bytes but the last make the block above, up to the root. The
    result depends on the members alone, not on how rows are partitioned or repeated, and no
    group holds more than a few hundred hashes. The depth follows the number of members.
    Null identifiers are no members.
    """
    members = ids.where(F.col(column).isNotNull()).select(*keys, F.sha2(F.col(column).cast("string"), 256).alias("h")).distinct()
    # A set's size meets its members by their first byte too, so one key is many groups.
    # Null keys have no set.
    members = members.dropna(subset=keys).withColumn("__first", F.substring("h", 1, 2))
    parts = members.groupBy(*keys, "__first").agg(F.count("*").alias("__n"))
    sizes = parts.withColumn("selected", F.sum("__n").over(Window.partitionBy(*keys))).drop("__n")
    depth = sum((F.col("selected") > leaf * 256**k).cast("int") for k in range(MERKLE_LEVELS))
    nodes = (
        members.join(sizes.withColumn("depth", depth), [*keys, "__first"])
        .groupBy(*keys, "selected", "depth", F.substring("h", F.lit(1), 2 * F.col("depth")).alias("block"))
        .agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    )
    for level in range(MERKLE_LEVELS, 0, -1):
        # Nodes that are higher already pass as groups of one: one plan, not two of each level.
        deep = F.length("block") == 2 * level
        item = F.when(deep, F.concat("block", "h")).otherwise(F.col("h"))
        above = F.when(deep, F.substring("block", 1, 2 * level - 2)).otherwise(F.col("block"))
        lifted = nodes.groupBy(*keys, "selected", "depth", above.alias("above")).agg(F.collect_list(item).alias("items"))
        joined = F.when(F.col("depth") >= level, F.sha2(F.array_join(F.sort_array("items"), ""), 256)).otherwise(F.col("items")[0])
        nodes = lifted.select(*keys, "selected", "depth", F.col("above").alias("block"), joined.alias("h"))
    return nodes.select(*keys, "selected", "depth", F.substring("h", 1, 16).alias("selection_hash"))


def scope_revision(tables: dict[str, DataFrame]) -> DataFrame:
    """Fingerprint of counts and latest timestamps over several tables."""
    parts = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n"), F.max("created_at").alias("latest")).select(
            F.lit(name).alias("name"), "n", "latest"
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts.agg(
        F.array_sort(
            F.collect_list(
                F.concat_ws("|", "name", "n", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))
            )
        ).alias("parts")
    ).select(F.substring(F.sha2(F.array_join("parts", "|"), 256), 1, 16).alias("revision"))
