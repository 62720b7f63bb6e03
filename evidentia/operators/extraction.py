"""Page quality, line typing, unit building and report checks.

Windows here are per document; an imported document is bounded (2,000 pages,
100 MiB), unlike the keys of the corpus views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia import tables
from evidentia.functions import text as X

# Thresholds and patterns that decide page and line classes.
MAX_REPLACEMENT = 0.2
MIN_VISIBLE = 0.5
MAX_REPEAT = 0.5
IMAGE_HEAVY = 0.6
MIXED_IMAGES = 0.15
SCANNED_CHARS = 32
MIN_DENSITY = 0.0003
BOX_TOLERANCE = 2.0
OCR_TOLERANCE = 4.0
CAPTION = r"(?i)^(figure|fig\.|table|tab\.|listing|algorithm|chart|scheme|plate)\s*[\dIVXivx]+"
REFERENCES = r"(?i)^(references|bibliography|works?\s+cited)$"
REFERENCE_ENTRY = r"(?i)^(\[?\d{1,3}\]?\.?\s+\S|doi[:.]|https?://|arxiv[:.])"
MATH = (
    "[\\x{2200}-\\x{22FF}\\x{2A00}-\\x{2AFF}\\x{0391}-\\x{03C9}\\x{2190}-\\x{21FF}\\x{2070}-\\x{209F}]"
)


def text_quality(pages: DataFrame) -> DataFrame:
    """Quality figures of each page's text layer.

    ``pages``: native_text, width_pt, height_pt, line_boxes, image_area_ratio.
    """
    text = F.coalesce("native_text", F.lit(""))
    chars = F.length(text)
    visible = F.length(F.regexp_replace(text, r"(?U)[\s\p{C}]", ""))
    broken = F.length(text) - F.length(F.replace(text, F.lit("�")))
    runs = F.transform(X.all_matches(text, r"(?U)(\S)\1*"), F.length)
    area = F.greatest(F.lit(1.0), F.col("width_pt") * F.col("height_pt"))
    sane = F.forall(
        F.coalesce("line_boxes", F.array().cast(f"array<{tables.BOX}>")),
        lambda b: (b["x1"] >= b["x0"])
        & (b["y1"] >= b["y0"])
        & (b["x0"] >= -BOX_TOLERANCE)
        & (b["y0"] >= -BOX_TOLERANCE)
        & (b["x1"] <= F.col("width_pt") + BOX_TOLERANCE)
        & (b["y1"] <= F.col("height_pt") + BOX_TOLERANCE),
    )

    def share(part: Column) -> Column:
        return F.when(chars > 0, part / chars).otherwise(0.0)

    return (
        pages.withColumn("char_count", chars)
        .withColumn("visible_ratio", share(visible))
        .withColumn("replacement_ratio", share(broken))
        .withColumn("repeat_ratio", share(F.coalesce(F.array_max(runs), F.lit(0))))
        .withColumn("text_density", chars / area)
        .withColumn("boxes_sane", sane)
    )


def classify_pages(quality: DataFrame) -> DataFrame:
    """Page mode, whether it needs OCR, and the reasons (``n_images`` per page given)."""
    flood = F.col("replacement_ratio") > MAX_REPLACEMENT
    hidden = F.col("visible_ratio") < MIN_VISIBLE
    stuck = F.col("repeat_ratio") > MAX_REPEAT
    broken = (F.col("char_count") > 0) & (flood | hidden | stuck | ~F.col("boxes_sane"))
    mode = (
        F.when(broken, "BROKEN_TEXT_LAYER")
        .when(F.col("char_count") <= SCANNED_CHARS, "SCANNED")
        .when(F.col("image_area_ratio") >= IMAGE_HEAVY, "IMAGE_HEAVY")
        .when(F.col("image_area_ratio") >= MIXED_IMAGES, "MIXED")
        .otherwise("NATIVE_TEXT")
    )
    is_mode = F.col("mode")
    reasons = F.array_compact(
        F.array(
            F.when((is_mode == "BROKEN_TEXT_LAYER") & flood, F.lit("replacement_char_ratio")),
            F.when((is_mode == "BROKEN_TEXT_LAYER") & hidden, F.lit("visible_char_ratio")),
            F.when((is_mode == "BROKEN_TEXT_LAYER") & stuck, F.lit("repeated_glyph_ratio")),
            F.when((is_mode == "BROKEN_TEXT_LAYER") & ~F.col("boxes_sane"), F.lit("bbox_sane")),
            F.when(
                is_mode == "SCANNED",
                F.when(F.col("n_images") > 0, "few characters, images present").otherwise("blank page"),
            ),
            F.when(is_mode.isin("IMAGE_HEAVY", "MIXED"), F.lit("image_area_ratio")),
            F.when(is_mode == "NATIVE_TEXT", F.lit("native text layer")),
            F.when((is_mode == "NATIVE_TEXT") & (F.col("text_density") < MIN_DENSITY), F.lit("sparse text")),
        )
    )
    return (
        quality.withColumn("mode", mode)
        .withColumn("needs_ocr", F.col("mode").isin("SCANNED", "BROKEN_TEXT_LAYER", "MIXED"))
        .withColumn("reasons", reasons)
    )


def body_font_size(spans: DataFrame, pages: int = 30) -> DataFrame:
    """Median span size per version over the first pages, weighted by characters."""
    chars = F.length(F.trim("text"))
    return (
        spans.where((F.col("page") <= pages) & (F.col("size") > 0) & (chars > 0))
        .groupBy("paper_version_id")
        .agg(F.percentile("size", 0.5, chars).alias("body_size"))
    )


def classify_lines(lines: DataFrame, body: DataFrame) -> DataFrame:
    """Add ``kind``: EQUATION, CAPTION, HEADING or BODY.

    ``lines``: text, size, bold, math_font; ``body`` from :func:`body_font_size`.
    """
    text = F.trim("text")
    dense = F.regexp_replace("text", r"(?U)\s", "")
    ratio = F.when(F.length(dense) > 0, F.regexp_count(dense, F.lit(MATH)) / F.length(dense)).otherwise(0.0)
    big = F.col("size") >= F.col("body_size") * 1.2
    strong = F.col("bold") & (F.col("size") >= F.col("body_size") * 1.02) & (F.length(text) <= 120)
    heading = (F.length(text).between(1, 160)) & ~text.rlike("[,;:]$") & (big | strong)
    return lines.join(body, "paper_version_id", "left").withColumn(
        "kind",
        F.when((ratio >= 0.25) | (F.col("math_font") & (ratio >= 0.1)), "EQUATION")
        .when(text.rlike(CAPTION) & (F.length(text) < 1200), "CAPTION")
        .when(F.coalesce(heading, F.lit(False)), "HEADING")
        .otherwise("BODY"),
    )


def segment_units(lines: DataFrame) -> DataFrame:
    """Group classified lines (page, block, line, text, kind, bbox) into units.

    Heading lines of a block merge; a caption takes up to three body lines; body runs
    merge, except under a references heading, where each entry is a unit.
    """
    block = Window.partitionBy("paper_version_id", "page", "block").orderBy("line")
    document = Window.partitionBy("paper_version_id").orderBy("page", "block", "line")
    upto = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (
        lines.withColumn("pos", F.row_number().over(block))
        .withColumn("before", F.lag("kind").over(block))
        .withColumn(
            "anchor",
            F.last(F.when(F.col("kind") != "BODY", F.struct("pos", "kind")), ignorenulls=True).over(upto),
        )
        .withColumn("offset", F.col("pos") - F.coalesce("anchor.pos", F.lit(0)))
        .withColumn(
            "in_caption",
            F.coalesce((F.col("anchor.kind") == "CAPTION") & (F.col("offset") <= 3), F.lit(False)),
        )
    )
    first_body = F.when(F.coalesce(F.col("anchor.kind") == "CAPTION", F.lit(False)), 4).otherwise(1)
    starts = (
        F.when(F.col("kind") == "HEADING", F.coalesce(F.col("before") != "HEADING", F.lit(True)))
        .when(F.col("kind").isin("EQUATION", "CAPTION"), True)
        .otherwise(F.col("offset") == first_body)
    )
    runs = document.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("starts", starts).withColumn(
        "run", F.sum(F.col("starts").cast("int")).over(runs)
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("page", "block", "line", F.trim("text").alias("t")))),
        lambda r: r["t"],
    )
    heads = (
        numbered.where(F.col("kind") == "HEADING")
        .groupBy("paper_version_id", "run")
        .agg(F.array_join(ordered, "\n").alias("heading"))
        .withColumn(
            "opens", F.regexp_replace(F.trim("heading"), "[:.]+$", "").rlike(REFERENCES)
        )
    )
    placed = (
        numbered.join(heads, ["paper_version_id", "run"], "left")
        .withColumn(
            "in_references", F.coalesce(F.last("opens", ignorenulls=True).over(runs), F.lit(False))
        )
        .withColumn("loose", (F.col("kind") == "BODY") & ~F.col("in_caption"))
        .withColumn(
            "entry",
            F.col("starts")
            | (F.col("loose") & F.col("in_references") & F.trim("text").rlike(REFERENCE_ENTRY)),
        )
        .withColumn("unit", F.sum(F.col("entry").cast("int")).over(runs))
    )
    kind = F.min_by(
        F.when(F.col("kind") != "BODY", F.col("kind"))
        .when(F.col("in_references"), "REFERENCE")
        .otherwise("PARAGRAPH"),
        F.struct("page", "block", "line"),
    )
    boxes = (
        [
            F.struct(
                F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"),
                F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"),
            ).alias("bbox")
        ]
        if "bbox" in lines.columns
        else []
    )
    return placed.groupBy("paper_version_id", "unit").agg(
        F.min("page").alias("page"),
        kind.alias("unit_type"),
        F.array_join(ordered, "\n").alias("text"),
        F.count("*").alias("lines"),
        *boxes,
    )


def centre_inside(point: str, box: str) -> Column:
    x = (F.col(f"{point}.x0") + F.col(f"{point}.x1")) / 2
    y = (F.col(f"{point}.y0") + F.col(f"{point}.y1")) / 2
    return x.between(F.col(f"{box}.x0"), F.col(f"{box}.x1")) & y.between(
        F.col(f"{box}.y0"), F.col(f"{box}.y1")
    )


PAGE = ["paper_version_id", "page"]


def drop_inside(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """Items whose box centre lies in none of the page's ``boxes`` (bbox); equi join on page."""
    walls = boxes.where("bbox IS NOT NULL").select(
        *[F.col(c).alias(f"_{c}") for c in PAGE], F.col("bbox").alias("_box")
    )
    same_page = (F.col("paper_version_id") == F.col("_paper_version_id")) & (F.col("page") == F.col("_page"))
    return items.join(walls, same_page & centre_inside("bbox", "_box"), "left_anti")


def drop_inside_tables(blocks: DataFrame, table_boxes: DataFrame) -> DataFrame:
    return drop_inside(blocks, table_boxes)


def figure_units(figures: DataFrame, pages: DataFrame, min_share: float = 0.02) -> DataFrame:
    """Figures of at least 2 % of the page, each placement once."""
    size = (F.col("bbox.x1") - F.col("bbox.x0")) * (F.col("bbox.y1") - F.col("bbox.y0"))
    area = F.greatest(F.lit(1.0), F.col("width_pt") * F.col("height_pt"))
    return (
        figures.join(pages.select(*PAGE, "width_pt", "height_pt"), PAGE)
        .where(size / area >= min_share)
        .drop("width_pt", "height_pt")
        .dropDuplicates([*PAGE, "bbox"])
    )


def ocr_units(lines: DataFrame, pages: DataFrame, dpi: int = 200) -> DataFrame:
    """OCR lines in page points; boxes off the page are dropped with a flag."""
    scale = 72.0 / dpi
    t = OCR_TOLERANCE
    joined = lines.join(pages.select(*PAGE, "width_pt", "height_pt"), PAGE, "left")
    x0, y0, x1, y1 = (F.col(f"bbox_px.{c}") * scale for c in ("x0", "y0", "x1", "y1"))
    w, h = F.col("width_pt"), F.col("height_pt")
    fits = (x0 >= -t) & (y0 >= -t) & (x1 <= w + t) & (y1 <= h + t) & (x1 >= x0) & (y1 >= y0)

    def clamp(v: Column, top: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, top))

    has = F.col("bbox_px").isNotNull()
    flags = F.array_compact(
        F.array(
            F.lit("source:ocr_fallback"),
            F.when(has & ~F.coalesce(fits, F.lit(False)), F.lit("bbox_out_of_page:dropped")),
            F.when(F.col("confidence").isNull(), F.lit("OCR_CONFIDENCE_UNAVAILABLE")),
        )
    )
    box = F.struct(
        clamp(x0, w).alias("x0"), clamp(y0, h).alias("y0"), clamp(x1, w).alias("x1"), clamp(y1, h).alias("y1")
    )
    return joined.select(
        *PAGE,
        "ordinal",
        "text",
        F.when(has & fits, box).alias("bbox"),
        F.col("confidence").alias("ocr_confidence"),
        flags.alias("flags"),
    )


def merge_units(native: DataFrame, ocr: DataFrame, modes: DataFrame) -> DataFrame:
    """Native and OCR units of each page put together by page mode, in reading order.

    ``native`` has unit_type; both have ordinal, text, bbox. Mixed pages keep only OCR
    lines whose centre is in no native text box.
    """
    types = list(tables.TEXT_UNIT_TYPES)
    n = native.select(*PAGE, "unit_type", "text", "bbox", "ordinal", F.lit("PDF_NATIVE").alias("source_method")).join(
        modes, PAGE
    )
    o = ocr.select(
        *PAGE, F.lit("PARAGRAPH").alias("unit_type"), "text", "bbox", "ordinal", F.lit("OCR").alias("source_method")
    ).join(modes, PAGE)
    kept_native = n.where(
        F.col("mode").isin("NATIVE_TEXT", "IMAGE_HEAVY", "MIXED")
        | ((F.col("mode") == "BROKEN_TEXT_LAYER") & (F.col("unit_type") == "FIGURE"))
    )
    plain_ocr = o.where(F.col("mode").isin("SCANNED", "BROKEN_TEXT_LAYER"))
    fresh = drop_inside(
        o.where(F.col("mode") == "MIXED"),
        n.where((F.col("mode") == "MIXED") & F.col("unit_type").isin(*types)),
    )
    merged = kept_native.unionByName(plain_ocr).unionByName(fresh)
    reading = Window.partitionBy(*PAGE).orderBy(
        F.col("bbox").isNull(),
        F.bround(F.col("bbox.y0") / 4),
        F.col("bbox.x0"),
        F.col("source_method") == "OCR",
        F.col("ordinal"),
    )
    return merged.withColumn("position", F.row_number().over(reading) - 1).drop("ordinal")


def page_methods(merged: DataFrame, modes: DataFrame) -> DataFrame:
    """Where each page's text came from."""
    text_units = F.col("unit_type").isin(*tables.TEXT_UNIT_TYPES)
    facts = merged.groupBy(*PAGE).agg(
        F.bool_or(F.col("source_method") == "OCR").alias("any_ocr"),
        F.bool_or((F.col("source_method") == "PDF_NATIVE") & text_units).alias("any_native_text"),
    )
    joined = modes.join(facts, PAGE, "left").fillna(False, ["any_ocr", "any_native_text"])
    method = (
        F.when(F.col("mode").isin("NATIVE_TEXT", "IMAGE_HEAVY"), "PDF_NATIVE")
        .when(F.col("mode") == "SCANNED", "OCR")
        .when(~F.col("any_ocr"), "PDF_NATIVE")
        .when((F.col("mode") == "MIXED") & F.col("any_native_text"), "MIXED_NATIVE_OCR")
        .otherwise("OCR")
    )
    return joined.select(*PAGE, "mode", method.alias("page_method"))


def report_rollup(units: DataFrame, pages: DataFrame, versions: DataFrame) -> DataFrame:
    """Counts, quality checks and overall state of each extracted version.

    ``versions``: paper_version_id, page_count; ``pages``: page, mode, width_pt,
    height_pt, ocr_failed, ocr_unavailable; ``units``: page, text, bbox, source_method,
    ocr_confidence.
    """
    t = OCR_TOLERANCE
    sized = units.join(pages.select(*PAGE, "width_pt", "height_pt"), PAGE, "left")
    box = F.col("bbox")
    sane = box.isNull() | (
        F.col("width_pt").isNotNull()
        & (box["x1"] >= box["x0"])
        & (box["y1"] >= box["y0"])
        & (box["x0"] >= -t)
        & (box["y0"] >= -t)
        & (box["x1"] <= F.col("width_pt") + t)
        & (box["y1"] <= F.col("height_pt") + t)
    )
    per_units = sized.groupBy("paper_version_id").agg(
        F.count("*").alias("units"),
        F.count_if(F.length(F.trim("text")) > 0).alias("text_units"),
        F.count_if((F.col("source_method") == "OCR") & F.col("ocr_confidence").isNull()).alias("ocr_warnings"),
        F.bool_and(F.coalesce(sane, F.lit(False))).alias("location_sane"),
        F.count_if(F.col("source_method") == "OCR").alias("ocr_units"),
        F.count_if(F.col("source_method") == "PDF_NATIVE").alias("native_units"),
    )
    per_pages = pages.groupBy("paper_version_id").agg(
        F.count("*").alias("pages"),
        F.bool_or(F.col("mode") == "BROKEN_TEXT_LAYER").alias("broken"),
        F.count_if("ocr_failed").alias("ocr_failures"),
        F.bool_or("ocr_unavailable").alias("unavailable"),
    )
    out = (
        versions.join(per_pages, "paper_version_id", "left")
        .join(per_units, "paper_version_id", "left")
        .fillna(0, ["pages", "units", "text_units", "ocr_warnings", "ocr_units", "native_units", "ocr_failures"])
        .fillna(True, ["location_sane"])
        .fillna(False, ["broken", "unavailable"])
    )
    empty = (F.col("page_count") > 0) & (F.col("text_units") == 0)
    poor = (F.col("page_count") == 0) | empty
    degraded = (
        (F.col("ocr_failures") > 0)
        | (F.col("ocr_warnings") > 0)
        | ~F.col("location_sane")
        | F.col("broken")
        | F.col("unavailable")
    )
    return (
        out.withColumn("zero_page", F.col("page_count") == 0)
        .withColumn("empty_text", empty)
        .withColumn("page_count_consistent", F.col("page_count") == F.col("pages"))
        .withColumn(
            "quality_state", F.when(poor, "POOR").when(degraded, "DEGRADED").otherwise("GOOD")
        )
        .drop("broken", "unavailable")
    )


def extraction_sanity(reports: DataFrame, pages: DataFrame, units: DataFrame) -> DataFrame:
    """PASS, WARN or FAIL per version with reasons; FAIL must not be persisted.

    ``reports``: paper_version_id, page_count, location_sane, empty_text, ocr_warnings;
    ``pages``: page; ``units``: page (as reported), holding_page, text, asset_sha256.
    """
    seen = (
        pages.groupBy("paper_version_id", "page")
        .agg(F.count("*").alias("n"))
        .groupBy("paper_version_id")
        .agg(
            F.sum("n").alias("pages"),
            F.count("*").alias("distinct_pages"),
            F.min("page").alias("first_page"),
            F.max("page").alias("last_page"),
        )
    )
    facts = units.groupBy("paper_version_id").agg(
        F.bool_or((F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) | F.col("asset_sha256").isNotNull()).alias(
            "usable"
        ),
        F.bool_or(F.col("page") != F.col("holding_page")).alias("misplaced"),
    )
    joined = (
        reports.join(seen, "paper_version_id", "left")
        .join(facts, "paper_version_id", "left")
        .fillna(0, ["pages", "distinct_pages", "first_page", "last_page"])
        .fillna(False, ["usable", "misplaced"])
    )
    count = F.col("page_count")
    # All pages 1..n present exactly once, without listing them.
    complete = (F.col("distinct_pages") == count) & (
        (count == 0) | ((F.col("first_page") == 1) & (F.col("last_page") == count))
    )
    reasons = F.array_compact(
        F.array(
            F.when((count <= 0) | (F.col("pages") != count), F.lit("page_count")),
            F.when(~complete, F.lit("page_numbers")),
            F.when(~F.col("usable"), F.lit("no_usable_evidence")),
            F.when(F.col("misplaced"), F.lit("unit_page")),
            F.when(~F.col("location_sane"), F.lit("location")),
        )
    )
    soft = F.col("empty_text") | (F.col("ocr_warnings") > 0)
    return joined.select(
        "paper_version_id",
        F.when(F.size(reasons) > 0, "FAIL").when(soft, "WARN").otherwise("PASS").alias("outcome"),
        F.when(F.size(reasons) > 0, reasons)
        .when(soft, F.array(F.lit("sparse_text_or_ocr")))
        .otherwise(F.array().cast("array<string>"))
        .alias("reasons"),
    )
