"""Evidence rows: persisting extracted units, corrections, reads and locators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import keyed

#: What makes two units the same evidence of a version; nulls compare equal.
IDENTITY = [
    "paper_version_id",
    "unit_type",
    "page_number",
    "content_sha256",
    "source_method",
    "bbox",
    "ocr_confidence",
    "quality_state",
    "asset_id",
]


#: Places that the units of one asset are dealt to.
SPREAD = 8


def judge_units(units: DataFrame, assets: DataFrame) -> DataFrame:
    """Add quality, asset and the reason a unit cannot become evidence (or null)."""
    # Units without an asset meet nobody wherever they are; those of one asset are dealt to SPREAD places.
    place = F.xxhash64("paper_version_id", "content_sha256")
    dealt = units.withColumn("__place", F.when(F.col("asset_sha256").isNull(), place).otherwise(F.pmod(place, F.lit(SPREAD))))
    known = assets.select(
        F.col("sha256").alias("asset_sha256"), "asset_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SPREAD)])).alias("__place")
    )
    joined = dealt.join(known, ["asset_sha256", "__place"], "left").drop("__place")
    reason = (
        F.when((F.col("source_method") == "OCR") & F.col("ocr_confidence").isNull(),
               "ocr_confidence_missing")
        .when(F.col("asset_sha256").isNotNull() & F.col("asset_id").isNull(), "unknown_asset")
        .when(F.col("text").isNull() & F.col("asset_id").isNull(), "no_text_no_asset")
    )
    weak = F.col("ocr_confidence").isNull() | (F.col("ocr_confidence") < 0.6)
    quality = F.when((F.col("source_method") != "PDF_NATIVE") & weak, "DEGRADED").otherwise("GOOD")
    return joined.withColumn("excluded", reason).withColumn("quality_state", quality)


def evidence_key() -> Column:
    """Identifier derived from the identity, so reruns mint the same one."""
    return F.concat(F.lit("evd_"), F.sha2(F.to_json(F.struct(*IDENTITY)), 256))


def persist_evidence(
    units: DataFrame, assets: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """New evidence rows of a batch; repeats and rows already stored are left out.

    ``existing`` needs ``evidence_id`` only: identifiers are a function of identity.
    """
    judged = judge_units(units, assets).where(F.col("excluded").isNull())
    fresh = (
        judged.withColumn("evidence_id", evidence_key())
        .groupBy("evidence_id", *IDENTITY)
        .agg(
            F.min("ordinal").alias("ordinal"),
            F.min_by("text", "ordinal").alias("text"),
            F.count("*").alias("copies"),
        )
    )
    if existing is not None:
        fresh = fresh.join(existing.select("evidence_id"), "evidence_id", "left_anti")
    return fresh


def persist_report(
    units: DataFrame, assets: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Per version: units seen, created, reused and excluded by reason."""
    judged = judge_units(units, assets)
    seen = judged.groupBy("paper_version_id").agg(
        F.count("*").alias("units"),
        F.count_if(F.col("excluded").isNull()).alias("usable"),
        F.count_if(F.col("excluded") == "ocr_confidence_missing").alias("ocr_confidence_missing"),
        F.count_if(F.col("excluded") == "unknown_asset").alias("unknown_asset"),
        F.count_if(F.col("excluded") == "no_text_no_asset").alias("no_text_no_asset"),
    )
    created = (
        persist_evidence(units, assets, existing)
        .groupBy("paper_version_id")
        .agg(F.count("*").alias("created"))
    )
    return (
        seen.join(created, "paper_version_id", "left")
        .withColumn("created", F.coalesce("created", F.lit(0)))
        .withColumn("reused", F.col("usable") - F.col("created"))
        .drop("usable")
    )


CORRECTABLE = ["text", "bbox", "quality_state", "source_method", "ocr_confidence"]


def apply_corrections(evidence: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row per correction with ``refused`` (reason or null) and the new evidence.

    Fields a correction leaves null are copied; only a new text is hashed again.
    """
    have = [c for c in CORRECTABLE if c in corrections.columns]
    renamed = corrections.select(
        F.col("evidence_id"), *[F.col(c).alias(f"new_{c}") for c in have]
    )
    joined = renamed.join(evidence.withColumn("known", F.lit(True)), "evidence_id", "left")
    changed = F.lit(False)
    for name in have:
        changed = changed | F.col(f"new_{name}").isNotNull()
    out = joined.withColumn("changed", changed)
    if "text" in have:
        out = out.withColumn(
            "content_sha256",
            F.when(F.col("new_text").isNotNull(), F.sha2("new_text", 256)).otherwise(
                F.col("content_sha256")
            ),
        )
    for name in have:
        out = out.withColumn(name, F.coalesce(f"new_{name}", name)).drop(f"new_{name}")
    has_asset = F.col("asset_id").isNotNull() if "asset_id" in evidence.columns else F.lit(False)
    refused = (
        F.when(F.col("known").isNull(), "EVIDENCE_001")
        .when(~F.col("changed"), "no_change")
        .when((F.col("source_method") == "OCR") & F.col("ocr_confidence").isNull(),
              "ocr_confidence_missing")
        .when(F.col("text").isNull() & ~has_asset, "no_text_no_asset")
    )
    new_id = F.concat(
        F.lit("evd_"), F.sha2(F.concat_ws("|", "evidence_id", F.to_json(F.struct(*have))), 256)
    )
    return (
        out.withColumn("refused", refused)
        .withColumn("supersedes_evidence_id", F.col("evidence_id"))
        .withColumn("evidence_id", new_id)
        .drop("known", "changed")
    )


def active(evidence: DataFrame) -> DataFrame:
    """Evidence that no row of the same version supersedes."""
    replaced = evidence.where(F.col("supersedes_evidence_id").isNotNull()).select(
        "paper_version_id", F.col("supersedes_evidence_id").alias("evidence_id")
    )
    return evidence.join(replaced, ["paper_version_id", "evidence_id"], "left_anti")


def list_evidence(
    evidence: DataFrame,
    version=None,
    pages=None,
    section=None,
    types=None,
    qualities=None,
    include_superseded: bool = True,
) -> DataFrame:
    """Filtered evidence; sort by (page_start, evidence_id) when a page is shown."""
    out = evidence if version is None else evidence.where(F.col("paper_version_id") == version)
    if not include_superseded:
        out = active(out)
    if pages:
        out = out.where(F.col("page_start").isin(*pages))
    if section is not None:
        out = out.where(F.col("section_id") == section)
    if types:
        out = out.where(F.col("evidence_type").isin(*types))
    if qualities:
        out = out.where(F.col("quality_state").isin(*qualities))
    return out


def evidence_on_page(evidence: DataFrame, page: int, preview: int = 2000) -> DataFrame:
    """Evidence whose page range covers ``page``, text cut for display."""
    return evidence.where(F.lit(page).between(F.col("page_start"), F.col("page_end"))).withColumn(
        "text", F.substring("text", 1, preview)
    )


def evidence_on_pages(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Evidence for each (paper_version_id, page) of a table of pages.

    Ranges are short, so each row is repeated once per page it covers and the
    join stays an equi join.
    """
    covered = evidence.withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    return pages.join(covered, ["paper_version_id", "page"])


def typed_evidence(evidence: DataFrame, kind: str, limit: int = 20) -> DataFrame:
    """First active rows of one type per version, in page order (lists for display)."""
    rows = list_evidence(evidence, types=[kind], include_superseded=False).select(
        "paper_version_id", F.struct("page_start", "evidence_id", "text").alias("item")
    )
    top = keyed.top_k_items(rows, ["paper_version_id"], "item", limit)
    return top.select("paper_version_id", F.explode("items").alias("item")).select(
        "paper_version_id", "item.*"
    )


def version_summary(evidence: DataFrame) -> DataFrame:
    """Per version: total, superseded, active, and counts by type and quality."""
    types = (
        evidence.groupBy("paper_version_id", "evidence_type")
        .agg(F.count("*").alias("n"))
        .groupBy("paper_version_id")
        .agg(F.array_sort(F.collect_list(F.struct("evidence_type", "n"))).alias("by_type"))
    )
    qualities = (
        evidence.groupBy("paper_version_id", "quality_state")
        .agg(F.count("*").alias("n"))
        .groupBy("paper_version_id")
        .agg(F.array_sort(F.collect_list(F.struct("quality_state", "n"))).alias("by_quality"))
    )
    totals = evidence.groupBy("paper_version_id").agg(F.count("*").alias("evidence_total"))
    # Distinct first, so the count needs no set of identifiers in memory.
    superseded = (
        evidence.where(F.col("supersedes_evidence_id").isNotNull())
        .select("paper_version_id", "supersedes_evidence_id")
        .distinct()
        .groupBy("paper_version_id")
        .agg(F.count("*").alias("n_superseded"))
    )
    return (
        totals.join(superseded, "paper_version_id", "left")
        .withColumn("evidence_superseded", F.coalesce("n_superseded", F.lit(0)))
        .withColumn("evidence_active", F.col("evidence_total") - F.col("evidence_superseded"))
        .drop("n_superseded")
        .join(types, "paper_version_id")
        .join(qualities, "paper_version_id")
    )


def locators(evidence: DataFrame, geometry: DataFrame) -> DataFrame:
    """Where each evidence row sits on its displayed page, as page fractions.

    ``geometry``: paper_version_id, page_number, width, height (as displayed) and
    rotation (0, 90, 180, 270). Native boxes are in unrotated page space.
    """
    page = geometry.withColumnRenamed("page_number", "page_start")
    joined = evidence.join(page, ["paper_version_id", "page_start"], "left")
    native = F.col("source_method") == "PDF_NATIVE"
    x0, y0, x1, y1 = (F.col(f"bbox.{c}") for c in ("x0", "y0", "x1", "y1"))
    w, h = F.col("width"), F.col("height")

    def turned(plain: Column, quarter: Column, half: Column, three: Column) -> Column:
        turn = F.col("rotation")
        return (
            F.when(~native | (turn == 0), plain)
            .when(turn == 90, quarter)
            .when(turn == 180, half)
            .when(turn == 270, three)
        )

    left = F.greatest(turned(x0, w - y1, w - x1, y0), F.lit(0.0))
    top = F.greatest(turned(y0, x0, h - y1, h - x1), F.lit(0.0))
    right = F.least(turned(x1, w - y0, w - x0, y1), w)
    bottom = F.least(turned(y1, x1, h - y0, h - x0), h)
    unclear = ~F.col("source_method").isin("PDF_NATIVE", "OCR") & (F.col("rotation") != 0)
    usable = (
        F.col("bbox").isNotNull()
        & w.isNotNull()
        & (w > 0)
        & (h > 0)
        & (x1 > x0)
        & (y1 > y0)
        & ~unclear
    )
    out = joined.withColumn(
        "rect",
        F.when(
            F.coalesce(usable, F.lit(False)),
            F.struct(
                (left / w).alias("x0"), (top / h).alias("y0"),
                (right / w).alias("x1"), (bottom / h).alias("y1"),
            ),
        ),
    )
    inside = (F.col("rect.x1") > F.col("rect.x0")) & (F.col("rect.y1") > F.col("rect.y0"))
    found = F.coalesce(inside, F.lit(False))
    return out.select(
        "evidence_id",
        "paper_version_id",
        F.col("page_start").alias("page_number"),
        F.when(found, F.col("rect")).alias("rect_norm"),
        F.when(found, "REGION").otherwise("PAGE").alias("precision"),
        F.when(F.col("bbox").isNull(), "no bounding box")
        .when(~found, "bounding box or page geometry unusable")
        .alias("reason"),
    )


def evidence_context(
    evidence: DataFrame,
    sections: DataFrame,
    focus: list[str],
    max_units: int = 60,
    max_chars: int = 24000,
    preview: int = 900,
) -> DataFrame:
    """Context lines per version: focused sections, then the title and abstract.

    The first ``max_units`` candidates per version are found by a two-step top-k,
    so a version with very many units is never sorted in one task. Returns one row
    per version with the kept blocks joined and whether anything was left out.
    """
    classes = sections.select("paper_version_id", "section_id", "normalized_class")
    spine = ["TITLE", "ABSTRACT"]
    ranked = (
        evidence.where(F.length(F.trim("text")) > 0)
        .join(classes, ["paper_version_id", "section_id"], "left")
        .withColumn(
            "band",
            F.when(F.col("normalized_class").isin(*focus), 0).when(
                F.col("normalized_class").isin(*spine), 1
            ),
        )
        .where(F.col("band").isNotNull())
        .select(
            "paper_version_id",
            F.struct(
                "band",
                "page_start",
                "evidence_id",
                F.concat(
                    F.lit("["), "evidence_id", F.lit("] "), F.substring("text", 1, preview)
                ).alias("block"),
            ).alias("item"),
        )
    )
    totals = ranked.groupBy("paper_version_id").agg(F.count("*").alias("candidates"))
    top = keyed.top_k_items(ranked, ["paper_version_id"], "item", max_units)
    items = F.col("items")
    running = F.transform(
        items,
        lambda it, i: F.struct(
            it["block"].alias("block"),
            F.aggregate(
                F.slice(items, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x["block"])
            ).alias("chars"),
            i.alias("i"),
        ),
    )
    kept = F.filter(running, lambda r: (r["i"] == 0) | (r["chars"] <= max_chars))
    return (
        top.withColumn("kept", kept)
        .join(totals, "paper_version_id")
        .select(
            "paper_version_id",
            F.size("kept").alias("units"),
            F.array_join(F.transform("kept", lambda r: r["block"]), "\n\n").alias("context"),
            (F.size("kept") < F.col("candidates")).alias("truncated"),
        )
    )
