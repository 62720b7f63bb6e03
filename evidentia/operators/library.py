"""Library reads: scopes, pages, summaries, comparisons and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import tables
from evidentia.operators import keyed

MAX_PAGE = 100
DEFAULT_PAGE = 50

# Category prefixes behind each reading module and comparison row.
MODULES = (
    ("overview", ("research.", "contribution.", "result.main", "limitation.")),
    ("method", ("method.",)),
    ("experiments", ("experiment.", "result.comparative", "reliability.")),
    ("audit", ("critique.", "reliability.", "result.superiority")),
)
DIMENSIONS = (
    ("problem", ("research.", "contribution.")),
    ("method", ("method.",)),
    ("hypothesis", ("hypothesis.",)),
    ("dataset", ("experiment.",)),
    ("cost", ("experiment.",)),
    ("evidence", ("result.", "reliability.")),
    ("limitation", ("limitation.", "critique.")),
)
PROFILE_AGENTS = {
    "methods": "agents.method",
    "experiments": "agents.experiment",
    "techniques": "agents.technique",
    "people": "agents.people",
}


def starts_with_any(column: Column, prefixes) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | column.startswith(prefix)
    return out


def contains_text(column: Column, term: str) -> Column:
    """Case-insensitive literal substring."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def library_scope(
    papers: DataFrame,
    query: str = "",
    *,
    documents: DataFrame | None = None,
    collections: tuple[DataFrame, list] | None = None,
    tags: tuple[DataFrame, list] | None = None,
    tiers: tuple[DataFrame, list] | None = None,
    years: tuple[DataFrame, list] | None = None,
    audit_states: tuple[DataFrame, list] | None = None,
    entities: tuple[DataFrame, list] | None = None,
    read_states: tuple[DataFrame, list] | None = None,
) -> DataFrame:
    """Papers matching every given filter; each filter is (its table, wanted values)."""
    out = papers
    term = query.strip()
    if term:
        title = contains_text(F.col("canonical_title"), term) | contains_text(
            F.col("normalized_title"), term
        )
        if documents is None:
            out = out.where(title)
        else:
            indexed = (
                documents.where((F.col("document_type") == "PAPER") & contains_text(F.col("content"), term))
                .select("paper_id")
                .distinct()
                .withColumn("indexed", F.lit(True))
            )
            out = out.join(indexed, "paper_id", "left").where(title | F.col("indexed")).drop("indexed")

    def keep(df: DataFrame, rows: DataFrame) -> DataFrame:
        return df.join(rows.select("paper_id"), "paper_id", "left_semi")

    if collections:
        out = keep(out, collections[0].where(F.col("collection_id").isin(*collections[1])))
    if tags:
        out = keep(out, tags[0].where(F.col("tag_id").isin(*tags[1])))
    if tiers:
        out = keep(out, tiers[0].where(F.col("effective_tier").isin(*tiers[1])))
    if years:
        out = keep(out, years[0].where(F.year("publication_date").isin(*years[1])))
    if audit_states:
        out = keep(out, audit_states[0].where(F.col("support_state").isin(*audit_states[1])))
    if entities:
        relations, ids = entities
        near = F.col("source_entity_id").isin(*ids) | F.col("target_entity_id").isin(*ids)
        out = keep(out, relations.where(near & F.col("paper_id").isNotNull()))
    if read_states:
        personal, states = read_states
        marked = personal.where(F.col("read_state").isin(*states)).select("paper_id")
        if "UNREAD" in states:
            untouched = papers.select("paper_id").join(personal.select("paper_id"), "paper_id", "left_anti")
            marked = marked.unionByName(untouched)
        out = keep(out, marked)
    return out


def library_page(
    scope: DataFrame, sort: str = "RECENT", offset: int = 0, limit: int = DEFAULT_PAGE
) -> DataFrame:
    """One page of papers plus one extra row, whose presence means there is more."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} papers")
    order = (
        [F.col("normalized_title"), F.col("paper_id")]
        if sort == "TITLE"
        else [F.col("created_at").desc(), F.col("paper_id")]
    )
    return scope.orderBy(*order).offset(offset).limit(limit + 1)


def claim_candidates(
    claims: DataFrame, scope: DataFrame, query: str = "", states: list[str] | None = None, limit: int = 50
) -> DataFrame:
    out = claims.join(scope.select("paper_id"), "paper_id", "left_semi")
    if query.strip():
        out = out.where(contains_text(F.col("statement"), query.strip()))
    if states:
        out = out.where(F.col("support_state").isin(*states))
    return out.orderBy(F.col("created_at").desc(), "claim_id").limit(limit)


def entity_search(
    entities: DataFrame, query: str = "", types: list[str] | None = None, limit: int = 50
) -> DataFrame:
    out = entities.where(F.col("entity_type").isin(*types)) if types else entities
    if query.strip():
        out = out.where(contains_text(F.col("normalized_name"), query.strip()))
    return out.orderBy("canonical_name", "entity_id").limit(limit)


def module_claims(claims: DataFrame) -> DataFrame:
    """(module, claim) rows; a claim may feed several modules."""
    feeds = F.array_compact(
        F.array(
            *[
                F.when(starts_with_any(F.col("category"), prefixes), F.lit(name))
                for name, prefixes in MODULES
            ]
        )
    )
    return claims.withColumn("module", F.explode(feeds))


def module_split(claims: DataFrame, versions: DataFrame) -> DataFrame:
    """Claims per version and module; modules without claims are UNAVAILABLE."""
    counts = module_claims(claims).groupBy("paper_version_id", "module").agg(F.count("*").alias("claims"))
    names = F.array(*[F.lit(name) for name, _ in MODULES])
    grid = versions.select("paper_version_id").distinct().withColumn("module", F.explode(names))
    return grid.join(counts, ["paper_version_id", "module"], "left").select(
        "paper_version_id",
        "module",
        F.coalesce("claims", F.lit(0)).alias("claims"),
        F.when(F.col("claims").isNull(), "UNAVAILABLE").otherwise("AVAILABLE").alias("state"),
    )


def _by_tier(values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for tier, value in values.items():
        out = F.when(F.col("tier") == tier, F.lit(value)).otherwise(out)
    return out


def agent_plan(papers: DataFrame, agents: DataFrame) -> DataFrame:
    """Every agent (agent_type) of each paper (paper_id, tier): allowed or the reason it is not.

    Nothing runs at the index tier, the scan agents at the scan tier, all at the tiers above. An
    unknown tier allows nothing. The agents are a fixed few, so a paper becomes a few rows.
    """
    kinds = agents.select("agent_type").distinct().agg(F.array_sort(F.collect_list("agent_type"))).scalar()
    full = F.col("tier").isin("T2_FULL", "T3_DEEP")
    scan = (F.col("tier") == "T1_SCAN") & F.col("agent_type").isin(*tables.SCAN_AGENTS)
    needs = F.when(F.col("agent_type").isin(*tables.SCAN_AGENTS), "T1_SCAN").otherwise("T2_FULL")
    reason = F.concat(F.lit("agent "), "agent_type", F.lit(" requires "), needs, F.lit("; this paper's tier is "), "tier")
    return (
        papers.select("paper_id", "tier")
        .withColumn("agent_type", F.explode(kinds))
        .withColumn("allowed", F.coalesce(full | scan, F.lit(False)))
        .withColumn("reason", F.when(~F.col("allowed"), reason))
    )


def tier_budgets(papers: DataFrame, claims: DataFrame, evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """What each paper's tier grants and what its newest use is: claims, context units, verifiers.

    ``papers``: paper_id, tier; ``versions``: paper_version_id, paper_id. A paper's claims and
    units are those of its version with the most of them, since limits hold per analysis.
    ``over`` names the limits that are passed.
    """
    owned = versions.select("paper_version_id", "paper_id").distinct()

    def most(rows: DataFrame, name: str) -> DataFrame:
        per = rows.groupBy("paper_version_id").agg(F.count("*").alias("n"))
        return per.join(owned, "paper_version_id").groupBy("paper_id").agg(F.max("n").alias(name))

    used = (
        papers.select("paper_id", "tier")
        .join(most(claims.select("paper_version_id"), "claims"), "paper_id", "left")
        .join(most(evidence.select("paper_version_id"), "units"), "paper_id", "left")
        .fillna(0, ["claims", "units"])
        .withColumn("max_claims", _by_tier(tables.TIER_MAX_CLAIMS))
        .withColumn("context_units", _by_tier(tables.TIER_CONTEXT_UNITS))
        .withColumn("verifiers", _by_tier(tables.TIER_VERIFIER_COUNT))
    )
    over = F.array_compact(
        F.array(
            F.when(F.col("claims") > F.col("max_claims"), "claims"),
            F.when(F.col("units") > F.col("context_units"), "context_units"),
        )
    )
    return used.withColumn("over", over)


def stage_plan(papers: DataFrame) -> DataFrame:
    """Every pipeline stage of each paper (paper_id, tier): allowed or the reason it is not."""
    minimum = {
        stage: next(t for t in tables.TIERS if stage in tables.TIER_STAGES[t]) for stage in tables.STAGES
    }
    steps = F.array(
        *[
            F.struct(
                F.lit(i).alias("stage_no"), F.lit(stage).alias("stage"), F.lit(minimum[stage]).alias("requires")
            )
            for i, stage in enumerate(tables.STAGES)
        ]
    )
    allowed = F.lit(False)
    for tier, stages in tables.TIER_STAGES.items():
        allowed = allowed | ((F.col("tier") == tier) & F.col("stage").isin(*stages))
    return (
        papers.select("paper_id", "tier")
        .withColumn("step", F.explode(steps))
        .select("paper_id", "tier", "step.*")
        .withColumn("allowed", allowed)
        .withColumn(
            "reason",
            F.when(
                ~F.col("allowed"),
                F.concat(
                    F.lit("stage "), "stage", F.lit(" requires "), "requires",
                    F.lit("; this paper's tier is "), "tier",
                ),
            ),
        )
    )


def profile_claims(claims: DataFrame, runs: DataFrame, kind: str) -> DataFrame:
    wanted = runs.where(F.col("agent_type") == PROFILE_AGENTS[kind]).select("run_id")
    return claims.join(wanted, "run_id", "left_semi")


def techniques_for_papers(techniques: DataFrame, bridge: DataFrame) -> DataFrame:
    """Techniques of each paper through the bridge table."""
    return bridge.join(techniques, "technique_id")


def notes(rows: DataFrame, owner: str, paper=None, version=None) -> DataFrame:
    out = rows.where(F.col("owner_id") == owner)
    if paper is not None:
        out = out.where(F.col("paper_id") == paper)
    if version is not None:
        out = out.where(F.col("paper_version_id") == version)
    return out.orderBy(F.col("updated_at").desc(), "note_id")


def audit_counts(claims: DataFrame) -> DataFrame:
    """Claims per (version, state), and per version in rows with a null state."""
    return claims.rollup("paper_version_id", "support_state").agg(F.count("*").alias("claims")).where(
        F.col("paper_version_id").isNotNull()
    )


def evidence_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("claim_id").agg(F.count("*").alias("evidence_count"))


def takeaways(claims: DataFrame) -> DataFrame:
    """Newest main result per paper."""
    main = claims.where(F.col("category") == "result.main")
    return keyed.latest_by(main, ["paper_id"], ["created_at", "claim_id"])


def paper_context(
    claims: DataFrame, evidence: DataFrame, paper_tags: DataFrame, versions: DataFrame
) -> DataFrame:
    """Per version: claim, category and evidence figures; lists only small vocabularies."""

    def counted(df: DataFrame, column: str, name: str) -> DataFrame:
        return (
            df.groupBy("paper_version_id", column)
            .agg(F.count("*").alias("n"))
            .groupBy("paper_version_id")
            .agg(F.array_sort(F.collect_list(F.concat_ws("=", column, "n"))).alias(name))
        )

    tags = paper_tags.groupBy("paper_id").agg(
        F.count("*").alias("tags"), F.count_if("is_candidate").alias("candidate_tags")
    )
    categories = (
        claims.select("paper_version_id", "category")
        .distinct()
        .groupBy("paper_version_id")
        .agg(F.array_sort(F.collect_list("category")).alias("categories"))
    )
    out = versions.select("paper_version_id", "paper_id")
    for side in (
        claims.groupBy("paper_version_id").agg(F.count("*").alias("claims")),
        counted(claims, "support_state", "claims_by_state"),
        categories,
        evidence.groupBy("paper_version_id").agg(F.count("*").alias("evidence")),
        counted(evidence, "quality_state", "evidence_by_quality"),
        counted(evidence, "source_method", "evidence_by_method"),
    ):
        out = out.join(side, "paper_version_id", "left")
    return out.join(tags, "paper_id", "left").fillna(
        0, ["claims", "evidence", "tags", "candidate_tags"]
    )


def paper_analysis(claims: DataFrame) -> DataFrame:
    """Claims of each version numbered inside their category, oldest first."""
    return keyed.number_in_key(
        claims.select(
            "paper_version_id", "category", "claim_id", "statement", "claim_type", "support_state",
            "run_id", "created_at",
        ),
        ["paper_version_id", "category"],
        ["created_at", "claim_id"],
        None,
        "position",
    )


def collection_stats(members: DataFrame) -> DataFrame:
    return members.groupBy("collection_id").agg(
        F.count("*").alias("papers"),
        F.count_if("pinned").alias("pinned"),
        F.count_if(F.col("priority_override_tier").isNotNull()).alias("overrides"),
    )


def collection_workspace(members: DataFrame, versions: DataFrame, claims: DataFrame) -> DataFrame:
    """Sample facts of each collection; versions carry publication_date."""
    scoped = members.select("collection_id", "paper_id").join(versions, "paper_id")
    per_version = claims.groupBy("paper_version_id").agg(
        F.count("*").alias("claims"),
        F.bool_or(F.col("support_state") != "UNVERIFIED").alias("analyzed"),
    )
    papers = members.groupBy("collection_id").agg(F.count("*").alias("selected_papers"))
    facts = (
        scoped.join(per_version, "paper_version_id", "left")
        .groupBy("collection_id")
        .agg(
            F.count("*").alias("versions"),
            F.coalesce(F.sum("claims"), F.lit(0)).alias("claims"),
            F.count_if("analyzed").alias("analyzed_versions"),
            F.min(F.year("publication_date")).alias("first_year"),
            F.max(F.year("publication_date")).alias("last_year"),
        )
    )
    return papers.join(facts, "collection_id", "left").fillna(0, ["versions", "claims", "analyzed_versions"])


def collection_insights(
    members: DataFrame, versions: DataFrame, claims: DataFrame, limit: int = 6
) -> DataFrame:
    """At most six claims per collection: DISPUTED first, then PARTIALLY_SUPPORTED."""
    band = F.when(F.col("support_state") == "DISPUTED", 0).when(
        F.col("support_state") == "PARTIALLY_SUPPORTED", 1
    )
    scoped = members.select("collection_id", "paper_id").join(
        versions.select("paper_id", "paper_version_id"), "paper_id"
    )
    rows = (
        claims.withColumn("band", band)
        .where(F.col("band").isNotNull())
        .select("paper_version_id", F.struct("band", "created_at", "claim_id", "statement").alias("item"))
        .join(scoped, "paper_version_id")
    )
    top = keyed.top_k_items(rows, ["collection_id"], "item", limit)
    return top.select("collection_id", F.posexplode("items").alias("position", "item")).select(
        "collection_id", "position", "item.claim_id", "item.statement"
    )


def compare_papers(claims: DataFrame, latest_versions: DataFrame) -> DataFrame:
    """Claim figures of each compared paper and whether each category is shared by all.

    ``latest_versions``: paper_id, paper_version_id of the papers to compare.
    """
    mine = claims.drop("paper_id").join(latest_versions, "paper_version_id")
    per = mine.groupBy("paper_id", "category").agg(
        F.count("*").alias("claims"),
        F.count_if(F.col("support_state") == "SUPPORTED").alias("supported"),
    )
    spread = per.groupBy("category").agg(F.count("*").alias("papers"))
    total = latest_versions.agg(F.count("*")).scalar()
    return (
        per.join(spread, "category")
        .withColumn("shared", F.col("papers") == total)
        .drop("papers")
    )


def compare_versions(claims: DataFrame, chosen: DataFrame) -> DataFrame:
    """Comparison grids: first claim per version and dimension, and comparability.

    ``chosen``: comparison_id, paper_version_id. A comparison of fewer than 2 or more than 4
    versions is refused: one row per version, without a dimension. ``claims`` may
    carry ``protocol_key``. A dimension is comparable when all versions of its
    comparison share one non-null key; missing cells say so and hold no value.
    """
    names = F.array(*[F.lit(name) for name, _ in DIMENSIONS])
    sized = chosen.join(chosen.groupBy("comparison_id").agg(F.count("*").alias("n")), "comparison_id")
    grid = (
        sized.where("n BETWEEN 2 AND 4")
        .select("comparison_id", "paper_version_id")
        .withColumn("dimension", F.explode(names))
    )
    feeds = F.array_compact(
        F.array(
            *[
                F.when(starts_with_any(F.col("category"), prefixes), F.lit(name))
                for name, prefixes in DIMENSIONS
            ]
        )
    )
    matched = claims.join(chosen.select("paper_version_id"), "paper_version_id", "left_semi").select(
        "paper_version_id", "created_at", "claim_id", "statement", "protocol_key",
        F.explode(feeds).alias("dimension"),
    )
    first = keyed.earliest_by(matched, ["paper_version_id", "dimension"], ["created_at", "claim_id"])
    cells = grid.join(first, ["paper_version_id", "dimension"], "left")
    agreed = cells.groupBy("comparison_id", "dimension").agg(
        (F.countDistinct(F.coalesce("protocol_key", F.lit(""))) == 1).alias("same_key")
    )
    comparable = F.col("same_key") & F.col("protocol_key").isNotNull()
    nothing = F.lit(None).cast("string")
    refused = sized.where("n NOT BETWEEN 2 AND 4").select(
        "comparison_id", "paper_version_id", nothing.alias("dimension"),
        F.lit(None).cast(claims.schema["claim_id"].dataType).alias("claim_id"), nothing.alias("value"),
        F.lit(False).alias("comparable"), F.lit("refused: a comparison has 2 to 4 versions").alias("reason"),
    )
    compared = cells.join(agreed, ["comparison_id", "dimension"]).select(
        "comparison_id",
        "paper_version_id",
        "dimension",
        "claim_id",
        F.col("statement").alias("value"),
        F.coalesce(comparable, F.lit(False)).alias("comparable"),
        F.when(F.col("claim_id").isNull(), "NOT_EXTRACTED")
        .when(~F.col("same_key"), "different protocols")
        .when(F.col("protocol_key").isNull(), "no protocol key")
        .alias("reason"),
    )
    return compared.unionByName(refused)


def paper_summary(papers: DataFrame, versions: DataFrame, triage: DataFrame | None = None) -> DataFrame:
    """Identity, latest version and latest triage of each paper."""
    latest = keyed.latest_by(versions, ["paper_id"], ["created_at", "paper_version_id"])
    out = papers.join(latest.drop("created_at"), "paper_id", "left")
    if triage is not None:
        newest = keyed.latest_by(triage, ["paper_id"], ["created_at", "triage_id"])
        out = out.join(newest.select("paper_id", "effective_tier"), "paper_id", "left")
    return out


def paper_list(
    page: DataFrame,
    versions: DataFrame,
    paper_tags: DataFrame,
    triage: DataFrame,
    claims: DataFrame,
    links: DataFrame,
    personal: DataFrame,
) -> DataFrame:
    """A page of papers with everything its rows show; one join per side table."""
    ids = page.select("paper_id")

    def mine(df: DataFrame) -> DataFrame:
        return df.join(ids, "paper_id", "left_semi")

    latest = keyed.latest_by(mine(versions), ["paper_id"], ["created_at", "paper_version_id"])
    tags = mine(paper_tags).groupBy("paper_id").agg(F.count("*").alias("tags"))
    tiers = keyed.latest_by(mine(triage), ["paper_id"], ["created_at", "triage_id"]).select(
        "paper_id", F.col("effective_tier").alias("tier")
    )
    best = takeaways(mine(claims)).select("paper_id", "claim_id", F.col("statement").alias("takeaway"))
    cited = (
        links.join(best.select("claim_id"), "claim_id", "left_semi")
        .groupBy("claim_id")
        .agg(F.count("*").alias("takeaway_evidence"))
    )
    audits = mine(claims).groupBy("paper_version_id").agg(
        F.count("*").alias("claims"),
        F.count_if(F.col("support_state") == "DISPUTED").alias("disputed"),
    )
    return (
        page.join(latest.select("paper_id", "paper_version_id", "publication_date"), "paper_id")
        .join(tags, "paper_id", "left")
        .join(tiers, "paper_id", "left")
        .join(best, "paper_id", "left")
        .join(cited, "claim_id", "left")
        .join(personal.select("paper_id", "read_state"), "paper_id", "left")
        .join(audits, "paper_version_id", "left")
        .select(
            "paper_id",
            "paper_version_id",
            F.year("publication_date").alias("year"),
            F.when(F.col("publication_date").isNull(), "NOT_REPORTED").alias("year_missing"),
            F.coalesce("tags", F.lit(0)).alias("tags"),
            "tier",
            "takeaway",
            F.coalesce("takeaway_evidence", F.lit(0)).alias("takeaway_evidence"),
            F.coalesce("read_state", F.lit("UNREAD")).alias("read_state"),
            F.coalesce("claims", F.lit(0)).alias("claims"),
            F.coalesce("disputed", F.lit(0)).alias("disputed"),
        )
    )


def workspaces(versions: DataFrame, claims: DataFrame) -> DataFrame:
    """Per version: analysis revision (hash prefix and claim count) and distinct runs."""
    figures = claims.groupBy("paper_version_id").agg(F.count("*").alias("claims"))
    runs = (
        claims.select("paper_version_id", "run_id")
        .distinct()
        .groupBy("paper_version_id")
        .agg(F.count("*").alias("runs"))
    )
    return (
        versions.join(figures, "paper_version_id", "left")
        .join(runs, "paper_version_id", "left")
        .fillna(0, ["claims", "runs"])
        .withColumn(
            "analysis_revision",
            F.concat_ws("-", F.substring("content_sha256", 1, 12), "claims", "runs"),
        )
        .select("paper_id", "paper_version_id", "claims", "runs", "analysis_revision")
    )


def workspace_version(versions: DataFrame, paper, version) -> DataFrame:
    """The requested version with ``accepted``; a version of another paper is refused."""
    return versions.where(F.col("paper_version_id") == version).select(
        "paper_version_id", (F.col("paper_id") == paper).alias("accepted")
    )


def synthesis_lines(claims: DataFrame, versions: DataFrame) -> DataFrame:
    """Verified claims of each version as numbered text lines.

    A version without any gets one INSUFFICIENT_EVIDENCE row and no line.
    """
    line = F.concat(
        F.lit("["), "claim_id", F.lit("] ("), "claim_type", F.lit("/"), "category", F.lit(") "), "statement"
    )
    good = claims.where(F.col("support_state").isin("SUPPORTED", "PARTIALLY_SUPPORTED")).select(
        "paper_version_id", "created_at", "claim_id", line.alias("line")
    )
    lines = keyed.number_in_key(
        good, ["paper_version_id"], ["created_at", "claim_id"], None, "line_no"
    ).select("paper_version_id", "line_no", "line")
    return (
        versions.select("paper_version_id")
        .distinct()
        .join(lines, "paper_version_id", "left")
        .withColumn(
            "status", F.when(F.col("line").isNull(), "INSUFFICIENT_EVIDENCE").otherwise("READY")
        )
    )
