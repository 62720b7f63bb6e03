"""Section trees from heading units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import cut_lineage

# Heading number prefix and the ordered heading rules.
NUMBER_PREFIX = r"^((?:\d+|[A-Z]|[IVX]+)(?:\s*[.\-]\s*(?:\d+|[A-Z]|[IVX]+))*)\s*[.\-:]?\s+\S"
HEADING_RULES = (
    ("ABSTRACT", r"abstract\b"),
    ("INTRODUCTION", r"introduction\b"),
    (
        "RELATED_WORK",
        r"(related\s+work|related\s+literature|prior\s+work|literature\s+review|background\s+and\s+related)",
    ),
    ("LIMITATION", r"(limitation|limitations|threats?\s+to\s+validity)\b"),
    ("ACKNOWLEDGEMENT", r"(acknowledge?ments?|acknowledg?ements?|funding)\b"),
    ("REFERENCES", r"(references|bibliography|works?\s+cited)\b"),
    ("APPENDIX", r"appendix\b"),
    ("SUPPLEMENTARY", r"(supplementary|supplemental)\b"),
    (
        "CONCLUSION",
        r"(conclusion|conclusions|concluding\s+remarks?|summary\s+and\s+future|future\s+work)\b",
    ),
    ("DISCUSSION", r"discussion\b"),
    ("RESULT", r"(results?|findings)\b"),
    (
        "EXPERIMENT",
        r"(experiments?|experimental|evaluation|evaluations?|benchmark(s|ing)?|empirical(\s+results?)?|setup)\b",
    ),
    (
        "THEORY",
        r"(theory|theoretical(\s+analysis|\s+foundations)?|formulation|proofs?|preliminaries\s+and\s+theory)\b",
    ),
    (
        "METHOD",
        r"(method(s|ology)?|approach|proposed(\s+method|\s+approach|\s+model)?|model(\s+architecture)?"
        r"|system(\s+design|\s+architecture)?|design|implementation|technique(s)?|framework|our\s+approach)\b",
    ),
    ("BACKGROUND", r"(background|preliminaries|primer|overview\s+of|basics\s+of)\b"),
)
FRONT_MATTER = "(front matter)"


def squeezed(heading: Column) -> Column:
    return F.trim(F.regexp_replace(heading, r"\s+", " "))


def number_prefix(heading: Column) -> Column:
    return F.regexp_extract(squeezed(heading), NUMBER_PREFIX, 1)


def normalize_heading(heading: Column) -> Column:
    """Section class of a heading; number prefixes do not count."""
    text = squeezed(heading)
    prefix = number_prefix(heading)
    bare = F.when(
        prefix != "", F.trim(F.regexp_replace(F.substr(text, F.length(prefix) + 1), r"^[.\-: ]+", ""))
    ).otherwise(text)
    out = F.lit("OTHER")
    for name, pattern in reversed(HEADING_RULES):
        out = F.when(bare.rlike(f"(?i)^{pattern}"), name).otherwise(out)
    return out


def heading_level(heading: Column) -> Column:
    """Depth told by the number prefix: its parts less one."""
    prefix = number_prefix(heading)
    parts = F.filter(F.split(prefix, r"\s*[.\-]\s*"), lambda p: p != "")
    return F.when(prefix == "", 0).otherwise(F.greatest(F.lit(0), F.size(parts) - 1))


def assign_sections(units: DataFrame) -> DataFrame:
    """Units (paper_version_id, page, ordinal, unit_type, text) with their section ordinal.

    A unit belongs to the last heading at or before it. Units before the first heading
    form section 0, and then headings count from 1.
    """
    upto = (
        Window.partitionBy("paper_version_id")
        .orderBy("page", "ordinal")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    whole = Window.partitionBy("paper_version_id")
    heading = F.col("unit_type") == "HEADING"
    counted = units.withColumn("heads", F.sum(heading.cast("int")).over(upto)).withColumn(
        "has_front", F.min("heads").over(whole) == 0
    )
    return counted.withColumn(
        "section", F.when(F.col("has_front"), F.col("heads")).otherwise(F.col("heads") - 1)
    ).drop("heads", "has_front")


def build_sections(assigned: DataFrame) -> DataFrame:
    """One row per section: heading, class, level, pages and parent ordinal."""
    heading = F.col("unit_type") == "HEADING"
    rows = assigned.groupBy("paper_version_id", F.col("section").alias("ordinal")).agg(
        F.max(F.when(heading, squeezed(F.coalesce("text", F.lit(""))))).alias("heading"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.count("*").alias("units"),
    )
    total = Window.partitionBy("paper_version_id")
    rows = (
        rows.withColumn("sections", F.count("*").over(total))
        .withColumn(
            "original_heading",
            F.coalesce("heading", F.when(F.col("sections") == 1, F.lit("")).otherwise(FRONT_MATTER)),
        )
        .withColumn(
            "normalized_class",
            F.when(F.col("heading").isNull(), "OTHER").otherwise(normalize_heading(F.col("heading"))),
        )
        .withColumn(
            "level", F.when(F.col("heading").isNull(), 0).otherwise(heading_level(F.col("heading")))
        )
        .drop("heading", "sections")
    )
    parents = section_parents(rows)
    return rows.join(parents, ["paper_version_id", "ordinal"], "left")


def section_parents(sections: DataFrame) -> DataFrame:
    """Nearest earlier section of a smaller level, for sections below the top.

    Each section looks once per smaller level, so the work is the sum of levels.
    """
    key = ["paper_version_id", "looked"]
    marks = sections.select(
        "paper_version_id", "ordinal", F.col("level").alias("looked"), F.lit(True).alias("is_mark")
    )
    probes = sections.where("level > 0").select(
        "paper_version_id",
        "ordinal",
        F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("looked"),
        F.lit(False).alias("is_mark"),
    )
    earlier = (
        Window.partitionBy(*key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = marks.unionByName(probes).withColumn(
        "found", F.last(F.when(F.col("is_mark"), F.col("ordinal")), ignorenulls=True).over(earlier)
    )
    return (
        seen.where("NOT is_mark AND found IS NOT NULL")
        .groupBy("paper_version_id", "ordinal")
        .agg(F.max("found").alias("parent_ordinal"))
    )


def section_depths(sections: DataFrame) -> DataFrame:
    """Number of ancestors of each section (section_id, parent_section_id).

    Follows parents one round at a time until nobody moves; a parent already on the
    path ends it, so cycles stop.
    """
    parents = sections.select(F.col("section_id").alias("cursor"), F.col("parent_section_id").alias("next"))
    walking = sections.select(
        "section_id",
        F.col("parent_section_id").alias("cursor"),
        F.lit(0).alias("depth"),
        F.array("section_id").alias("path"),
    )
    done = None
    while True:
        step = walking.join(parents.withColumn("exists", F.lit(True)), "cursor", "left")
        moves = F.col("exists").isNotNull() & ~F.array_contains("path", F.col("cursor"))
        step = cut_lineage(step.withColumn("moves", F.coalesce(moves, F.lit(False))))
        ended = step.where("NOT moves").select("section_id", "depth")
        done = ended if done is None else done.unionByName(ended)
        walking = step.where("moves").select(
            "section_id",
            F.col("next").alias("cursor"),
            (F.col("depth") + 1).alias("depth"),
            F.concat("path", F.array("cursor")).alias("path"),
        )
        if walking.isEmpty():
            return done


def section_tree(sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sections with their depth and evidence count; children order by ordinal."""
    counts = evidence.where("section_id IS NOT NULL").groupBy("section_id").agg(
        F.count("*").alias("evidence_count")
    )
    return (
        sections.join(section_depths(sections), "section_id")
        .join(counts, "section_id", "left")
        .withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
    )
