"""Claim audits, version audits and the human review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import tables
from evidentia.operators import keyed, ledger


def claim_trail(
    claims: DataFrame, links: DataFrame, evidence: DataFrame, runs: DataFrame
) -> DataFrame:
    """Provenance in long form: one row per claim and cited evidence."""
    return (
        claims.select("claim_id", "paper_id", "paper_version_id", "run_id", "support_state")
        .join(runs.select("run_id", "agent_type"), "run_id", "left")
        .join(links, "claim_id", "left")
        .join(
            evidence.select("evidence_id", "page_start", "section_id", "source_method").withColumn(
                "found", F.lit(True)
            ),
            "evidence_id",
            "left",
        )
        .withColumn(
            "missing", F.col("evidence_id").isNotNull() & F.coalesce(~F.col("found"), F.lit(True))
        )
        .drop("found")
    )


def claim_audit(
    claims: DataFrame,
    links: DataFrame,
    evidence: DataFrame,
    runs: DataFrame,
    verifications: DataFrame,
    provenances: DataFrame | None = None,
) -> DataFrame:
    """Completeness of each claim's provenance, with its warnings.

    Every side table is reduced to one row per claim before it is joined.
    """
    cited = (
        links.join(evidence.select("evidence_id", F.lit(True).alias("found")), "evidence_id", "left")
        .groupBy("claim_id")
        .agg(
            F.count("*").alias("evidence_links"),
            F.count_if(F.col("found").isNull()).alias("missing_evidence"),
        )
    )
    checked = verifications.groupBy("claim_id").agg(F.count("*").alias("verification_count"))
    out = (
        claims.join(runs.select("run_id", F.lit(True).alias("run_found")), "run_id", "left")
        .join(cited, "claim_id", "left")
        .join(checked, "claim_id", "left")
    )
    if provenances is not None:
        sources = provenances.groupBy("claim_id").agg(F.count("*").alias("external_sources"))
        out = out.join(sources, "claim_id", "left")
    else:
        out = out.withColumn("external_sources", F.lit(0).cast("long"))
    out = out.fillna(
        0, ["evidence_links", "missing_evidence", "verification_count", "external_sources"]
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("run_found").isNull(), F.lit("run_missing")),
            F.when(F.col("missing_evidence") > 0, F.lit("evidence_missing")),
            F.when(
                (F.col("evidence_links") == 0) & (F.col("external_sources") == 0),
                F.lit("no_evidence"),
            ),
            F.when(F.col("verification_count") == 0, F.lit("not_verified")),
        )
    )
    return out.select(
        "claim_id",
        "paper_version_id",
        "support_state",
        "evidence_links",
        "missing_evidence",
        "external_sources",
        "verification_count",
        warnings.alias("warnings"),
        (F.size(warnings) == 0).alias("complete"),
    )


def latest_verdicts(verifications: DataFrame) -> DataFrame:
    """Newest verdict per claim and verifier."""
    return keyed.latest_by(
        verifications, ["claim_id", "verifier_type"], ["created_at", "verification_id"]
    )


AUDIT_SECTIONS = (
    "verified_claims",
    "unsupported_claims",
    "ocr_sensitive_claims",
    "numeric_conflicts",
    "agent_disagreements",
    "single_model_claims",
    "external_inferences",
    "high_risk_claims",
)


def audit_sections(
    claims: DataFrame,
    links: DataFrame,
    evidence: DataFrame,
    verifications: DataFrame,
    model_calls: DataFrame,
) -> DataFrame:
    """One boolean per audit section and claim; a claim may be in several."""

    def adverse(*kinds: str) -> Column:
        wanted = F.col("verifier_type").isin(*[f"verification.{k}" for k in kinds])
        return F.bool_or(wanted & F.col("verdict").isin("FAIL", "WARN"))

    verdicts = latest_verdicts(verifications).groupBy("claim_id").agg(
        adverse("ocr_sensitivity").alias("v_ocr"),
        adverse("numeric").alias("v_numeric"),
        adverse("independent_consensus", "contradiction").alias("v_disagree"),
        F.bool_or(F.col("verdict") == "FAIL").alias("v_fail"),
    )
    shaky = F.col("source_method").isin("OCR", "MIXED_NATIVE_OCR") & (
        (F.col("quality_state") == "DEGRADED") | (F.col("ocr_confidence") < 0.8)
    )
    weak = (
        links.join(
            evidence.where(F.coalesce(shaky, F.lit(False))).select("evidence_id"),
            "evidence_id",
            "left_semi",
        )
        .select("claim_id")
        .distinct()
        .withColumn("e_ocr", F.lit(True))
    )
    single = (
        model_calls.select("run_id", "provider_id", "model_id")
        .distinct()
        .groupBy("run_id")
        .agg((F.count("*") == 1).alias("one_model"))
    )
    joined = (
        claims.join(verdicts, "claim_id", "left")
        .join(weak, "claim_id", "left")
        .join(single, "run_id", "left")
    )

    def yes(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    ocr = yes("v_ocr") | yes("e_ocr")
    state = F.col("support_state")
    return joined.select(
        "claim_id",
        "paper_version_id",
        "support_state",
        (state == "SUPPORTED").alias("verified_claims"),
        state.isin("UNSUPPORTED", "INSUFFICIENT_EVIDENCE").alias("unsupported_claims"),
        ocr.alias("ocr_sensitive_claims"),
        yes("v_numeric").alias("numeric_conflicts"),
        yes("v_disagree").alias("agent_disagreements"),
        yes("one_model").alias("single_model_claims"),
        (F.col("claim_type") == "EXTERNAL").alias("external_inferences"),
        (
            state.isin("DISPUTED", "UNSUPPORTED", "INSUFFICIENT_EVIDENCE") | ocr | yes("v_fail")
        ).alias("high_risk_claims"),
    )


def version_audit(sections: DataFrame) -> DataFrame:
    """Counts per version over :func:`audit_sections`."""
    return sections.groupBy("paper_version_id").agg(
        F.count("*").alias("claim_count"),
        *[F.count_if(name).alias(name) for name in AUDIT_SECTIONS],
        F.count_if(F.col("support_state") == "DISPUTED").alias("disputed_claims"),
    )


def review_items(
    claims: DataFrame,
    verifications: DataFrame,
    decisions: DataFrame,
    links: DataFrame,
    papers: DataFrame,
    include_all: bool = False,
    include_seen: bool = False,
    groups: list[str] | None = None,
) -> DataFrame:
    """Claims a person should look at, each with its group, impact and context."""
    states = list(tables.RISKY_STATES) + (["SUPPORTED", "UNVERIFIED"] if include_all else [])
    group_of = F.coalesce(
        F.element_at(
            F.create_map(*[F.lit(v) for pair in tables.REVIEW_GROUPS.items() for v in pair]),
            F.col("worst"),
        ),
        F.lit("SUPPORT_STATE"),
    )
    newest_first = F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), "verification_id")
    problem = F.col("verdict") != "PASS"
    checks = verifications.groupBy("claim_id").agg(
        F.min_by(F.when(problem, F.col("verifier_type")), F.when(problem, newest_first)).alias("worst"),
        F.count_if(problem).alias("problems"),
    )
    decided = keyed.latest_by(decisions, ["claim_id"], ["created_at", "decision_id"]).select(
        "claim_id", "decision"
    )
    counts = links.groupBy("claim_id").agg(
        F.count("*").alias("evidence_count"),
        F.count_if(F.col("role") == "COUNTER_EVIDENCE").alias("counter_evidence_count"),
    )
    revisions = ledger.claim_revision(claims)
    items = (
        claims.where(F.col("support_state").isin(*states))
        .join(checks, "claim_id", "left")
        .join(decided, "claim_id", "left")
        .join(counts, "claim_id", "left")
        .join(papers.select("paper_id", F.col("canonical_title").alias("paper_title")), "paper_id", "left")
        .join(revisions, "claim_id")
        .withColumn(
            "review_group",
            F.when(F.col("problems").isNull(), "NOT_VERIFIED")
            .when(F.col("problems") > 0, group_of)
            .otherwise("SUPPORT_STATE"),
        )
        .withColumn(
            "impact",
            F.when(F.col("support_state").isin("DISPUTED", "UNSUPPORTED"), "HIGH").otherwise("NORMAL"),
        )
    )
    if not include_seen:
        items = items.where(F.coalesce("decision", F.lit("")) != "SEEN")
    if groups:
        items = items.where(F.col("review_group").isin(*groups))
    return items.select(
        "claim_id",
        "paper_id",
        "paper_version_id",
        "paper_title",
        "review_group",
        "impact",
        F.coalesce("problems", F.lit(0)).alias("problems"),
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        F.coalesce("counter_evidence_count", F.lit(0)).alias("counter_evidence_count"),
        F.col("decision").alias("personal_decision"),
        F.col("revision").alias("claim_revision"),
    )


def review_page(items: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of the queue, HIGH impact first, then by claim; ``total`` counts the whole queue."""
    total = items.agg(F.count("*").alias("total")).scalar()
    page = items.orderBy(F.col("impact") != "HIGH", "claim_id").offset(offset).limit(limit)
    return page.withColumn("total", total)


def counter_claims(verdicts: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence cited by the claims that contradict or criticise each claim."""
    rival = F.coalesce(
        F.col("details")["conflicting_claim_id"], F.col("details")["critique_claim_id"]
    )
    pairs = verdicts.select("claim_id", rival.alias("rival_id")).where("rival_id IS NOT NULL").distinct()
    cited = links.select(F.col("claim_id").alias("rival_id"), "evidence_id")
    return pairs.join(cited, "rival_id")
