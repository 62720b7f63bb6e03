"""Queries over extraction, structure and response checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import extraction as E
from evidentia.operators import redaction as RD
from evidentia.operators import responses as R
from evidentia.operators import structure as S
from evidentia.plans import duck
from evidentia.plans.records import LINES
from evidentia.plans.registry import query
from evidentia.session import shared_folder
from evidentia.sources import readers

PAGES = """pg AS MATERIALIZED (SELECT doc_id, text AS native_text, length(text) AS n,
  CASE doc_id % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 0.2 ELSE 0.0 END AS image_area_ratio, doc_id % 2 AS n_images, doc_id % 31 > 0 AS boxes_sane FROM documents)"""


def pages(t):
    box = F.struct(
        F.lit(1.0).alias("x0"), F.lit(1.0).alias("y0"),
        F.when(F.col("doc_id") % 31 == 0, 700.0).otherwise(600.0).alias("x1"), F.lit(20.0).alias("y1"),
    )
    return t.documents.select(
        "doc_id",
        F.col("text").alias("native_text"),
        F.lit(612.0).alias("width_pt"),
        F.lit(792.0).alias("height_pt"),
        F.array(box).alias("line_boxes"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 0.7D WHEN 1 THEN 0.2D ELSE 0.0D END").alias("image_area_ratio"),
        (F.col("doc_id") % 2).alias("n_images"),
    )


QUALITY = PAGES + """, ch AS (SELECT doc_id, i, c, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (
  SELECT doc_id, unnest(range(n)) AS i, unnest(string_split(native_text, '')) AS c FROM pg) q),
isl AS (SELECT doc_id, c, sum(CASE WHEN c = p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM ch),
longest_run AS (SELECT doc_id, max(k) AS longest FROM (SELECT doc_id, g, count(*) AS k FROM isl WHERE NOT regexp_full_match(c, '[\\s\\x{00A0}]') GROUP BY 1, 2) q GROUP BY 1),
q AS MATERIALIZED (SELECT pg.doc_id, n AS char_count, round(length(regexp_replace(native_text, '[\\s\\p{C}\\x{00A0}]', '', 'g')) / n, 6) AS visible_ratio,
  round((n - length(replace(native_text, chr(65533), ''))) / n, 6) AS replacement_ratio, round(coalesce(longest, 0) / n, 6) AS repeat_ratio,
  round(n / (612.0 * 792.0), 8) AS text_density, boxes_sane, image_area_ratio FROM pg LEFT JOIN longest_run ON pg.doc_id = longest_run.doc_id)"""


@query("e1_text_quality", f"WITH {QUALITY} SELECT doc_id, char_count, visible_ratio, replacement_ratio, repeat_ratio, text_density, boxes_sane FROM q")
def e1(t):
    out = E.text_quality(pages(t))
    return out.select(
        "doc_id",
        F.col("char_count").cast("long").alias("char_count"),
        *[F.round(c, 6).alias(c) for c in ("visible_ratio", "replacement_ratio", "repeat_ratio")],
        F.round("text_density", 8).alias("text_density"),
        "boxes_sane",
    )


@query("e2_classify_pages", f"""WITH {QUALITY}, m AS (SELECT *, CASE WHEN char_count > 0 AND (replacement_ratio > 0.2 OR visible_ratio < 0.5 OR repeat_ratio > 0.5 OR NOT boxes_sane) THEN 'BROKEN_TEXT_LAYER'
  WHEN char_count <= 32 THEN 'SCANNED' WHEN image_area_ratio >= 0.6 THEN 'IMAGE_HEAVY' WHEN image_area_ratio >= 0.15 THEN 'MIXED' ELSE 'NATIVE_TEXT' END AS mode FROM q)
SELECT doc_id, mode, mode IN ('SCANNED', 'BROKEN_TEXT_LAYER', 'MIXED') AS needs_ocr FROM m""")
def e2(t):
    return E.classify_pages(E.text_quality(pages(t))).select("doc_id", "mode", "needs_ocr")


# Lines with a made-up look; every tenth line becomes a caption, a numbered heading, ...
LOOK = {
    "paper_version_id": "doc_id",
    "page": "cast(1 + floor(ordinal / 20) AS int)",
    "block": "cast(floor(ordinal / 7) AS int)",
    "line": "cast(ordinal AS int)",
    "text": "CASE WHEN ordinal % 13 = 4 THEN concat('Figure ', cast(ordinal AS string), ': ', line)"
    " WHEN ordinal % 23 = 9 THEN 'References' WHEN ordinal % 17 = 3 THEN concat(cast(ordinal AS string), '. ', line)"
    " WHEN ordinal % 19 = 6 THEN concat('2.', cast(ordinal AS string), ' Results') ELSE line END",
    "size": "CASE WHEN ordinal % 23 = 9 OR ordinal % 19 = 6 OR length(line) < 20 THEN 14.0 ELSE 10.0 END",
    "bold": "ordinal % 5 = 0",
    "math_font": "doc_id % 50 = 7",
}
LOOKS = LINES + ", looks AS MATERIALIZED (SELECT " + ", ".join(f"{v} AS {k}" for k, v in LOOK.items()) + " FROM lines)"
KINDS = LOOKS + f""",
body AS (SELECT paper_version_id, median(size) AS body_size FROM (SELECT paper_version_id, size, unnest(range(length(trim(text)))) FROM looks WHERE page <= 30) q GROUP BY 1),
feats AS (SELECT l.*, body_size, trim(text) AS s, regexp_replace(text, '\\s', '', 'g') AS d FROM looks l LEFT JOIN body b ON l.paper_version_id = b.paper_version_id),
kinds AS MATERIALIZED (SELECT *, CASE WHEN r >= 0.25 OR (math_font AND r >= 0.1) THEN 'EQUATION' WHEN regexp_matches(s, {duck.quote(E.CAPTION)}) AND length(s) < 1200 THEN 'CAPTION'
  WHEN length(s) BETWEEN 1 AND 160 AND NOT regexp_matches(s, '[,;:]$') AND (size >= body_size * 1.2 OR (bold AND size >= body_size * 1.02 AND length(s) <= 120)) THEN 'HEADING' ELSE 'BODY' END AS kind
  FROM (SELECT *, CASE WHEN length(d) > 0 THEN len(regexp_extract_all(d, '{E.MATH}')) / length(d) ELSE 0 END AS r FROM feats) q)"""


def looks(t):
    lines = readers.text_lines(t.documents)
    return lines.select(*[F.expr(v).alias(k) for k, v in LOOK.items()])


def kinds(t):
    rows = looks(t)
    return E.classify_lines(rows, E.body_font_size(rows))


@query("e3_body_font_size", f"WITH {KINDS} SELECT paper_version_id, cast(body_size AS double) AS body_size FROM body")
def e3(t):
    return E.body_font_size(looks(t))


@query("e4_classify_lines", f"WITH {KINDS} SELECT paper_version_id, line, kind FROM kinds")
def e4(t):
    return kinds(t).select("paper_version_id", "line", "kind")


UNITS = KINDS + f""",
m AS (SELECT *, row_number() OVER b AS pos, lag(kind) OVER b AS before, last_value(CASE WHEN kind <> 'BODY' THEN {{'p': line, 'k': kind}} END IGNORE NULLS) OVER b AS anchor FROM kinds
  WINDOW b AS (PARTITION BY paper_version_id, page, block ORDER BY line)),
m2 AS (SELECT *, count(*) FILTER (WHERE kind = 'BODY') OVER (PARTITION BY paper_version_id, page, block, anchor.p ORDER BY line) AS body_no FROM m),
m3 AS (SELECT *, coalesce(anchor.k = 'CAPTION', false) AND kind = 'BODY' AND body_no <= 3 AS in_caption FROM m2),
st AS (SELECT *, CASE WHEN kind = 'HEADING' THEN before IS NULL OR before <> 'HEADING' WHEN kind <> 'BODY' THEN true
  WHEN coalesce(anchor.k = 'CAPTION', false) THEN body_no = 4 ELSE body_no = 1 END AS starts FROM m3),
rn AS (SELECT *, sum(starts::int) OVER (PARTITION BY paper_version_id ORDER BY page, block, line) AS run FROM st),
heads AS (SELECT paper_version_id AS hv, run AS hr, regexp_matches(rtrim(trim(string_agg(trim(text), chr(10) ORDER BY line)), ':.'), {duck.quote(E.REFERENCES)}) AS opens FROM rn WHERE kind = 'HEADING' GROUP BY 1, 2),
pl AS (SELECT rn.*, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY paper_version_id ORDER BY page, block, line ROWS UNBOUNDED PRECEDING), false) AS in_refs
  FROM rn LEFT JOIN heads ON hv = paper_version_id AND hr = run),
en AS (SELECT *, starts OR (kind = 'BODY' AND NOT in_caption AND in_refs AND regexp_matches(trim(text), {duck.quote(E.REFERENCE_ENTRY)})) AS entry FROM pl),
un AS MATERIALIZED (SELECT *, sum(entry::int) OVER (PARTITION BY paper_version_id ORDER BY page, block, line) AS unit FROM en),
units AS MATERIALIZED (SELECT paper_version_id, unit, min(page) AS page, arg_min(CASE WHEN kind <> 'BODY' THEN kind WHEN in_refs THEN 'REFERENCE' ELSE 'PARAGRAPH' END, line) AS unit_type,
  string_agg(trim(text), chr(10) ORDER BY line) AS text, count(*) AS lines FROM un GROUP BY 1, 2)"""


@query("e5_segment_units", f"WITH {UNITS} SELECT paper_version_id, cast(unit AS bigint) AS unit, page, unit_type, text, lines FROM units")
def e5(t):
    return E.segment_units(kinds(t))


HEADS = """h AS (SELECT concat(cast(l_linenumber AS string), '.', cast(l_suppkey % 5 AS string), ' ', CASE l_partkey % 12 WHEN 0 THEN 'Introduction' WHEN 1 THEN 'Related Work'
  WHEN 2 THEN 'Experimental Setup' WHEN 3 THEN 'Results' WHEN 4 THEN 'Conclusions' WHEN 5 THEN 'Proposed method' WHEN 6 THEN 'Threats to validity' WHEN 7 THEN 'References'
  WHEN 8 THEN 'Theoretical analysis' WHEN 9 THEN 'Appendix' WHEN 10 THEN 'Acknowledgements' ELSE 'Overview' END) AS heading,
  CASE l_partkey % 12 WHEN 0 THEN 'INTRODUCTION' WHEN 1 THEN 'RELATED_WORK' WHEN 2 THEN 'EXPERIMENT' WHEN 3 THEN 'RESULT' WHEN 4 THEN 'CONCLUSION' WHEN 5 THEN 'METHOD'
  WHEN 6 THEN 'LIMITATION' WHEN 7 THEN 'REFERENCES' WHEN 8 THEN 'THEORY' WHEN 9 THEN 'APPENDIX' WHEN 10 THEN 'ACKNOWLEDGEMENT' ELSE 'OTHER' END AS section_class FROM lineitem)"""


@query("e11_normalize_heading", f"WITH {HEADS} SELECT heading, section_class, 1 AS level, count(*) AS n FROM h GROUP BY 1, 2")
def e11(t):
    word = ("CASE l_partkey % 12 WHEN 0 THEN 'Introduction' WHEN 1 THEN 'Related Work' WHEN 2 THEN 'Experimental Setup' WHEN 3 THEN 'Results'"
            " WHEN 4 THEN 'Conclusions' WHEN 5 THEN 'Proposed method' WHEN 6 THEN 'Threats to validity' WHEN 7 THEN 'References'"
            " WHEN 8 THEN 'Theoretical analysis' WHEN 9 THEN 'Appendix' WHEN 10 THEN 'Acknowledgements' ELSE 'Overview' END")
    rows = t.lineitem.select(F.expr(f"concat(l_linenumber, '.', l_suppkey % 5, ' ', {word})").alias("heading"))
    return rows.groupBy("heading").agg(F.count("*").alias("n")).select(
        "heading",
        S.normalize_heading(F.col("heading")).alias("section_class"),
        S.heading_level(F.col("heading")).alias("level"),
        "n",
    )


ASSIGNED = UNITS + """,
hd AS (SELECT *, sum((unit_type = 'HEADING')::int) OVER (PARTITION BY paper_version_id ORDER BY unit) AS heads FROM units),
asg AS MATERIALIZED (SELECT *, CASE WHEN min(heads) OVER (PARTITION BY paper_version_id) = 0 THEN heads ELSE heads - 1 END AS section FROM hd)"""


def document_units(t):
    return E.segment_units(kinds(t)).withColumn("ordinal", F.col("unit"))


@query("e13_assign_sections", f"WITH {ASSIGNED} SELECT paper_version_id, cast(unit AS bigint) AS unit, cast(section AS bigint) AS section FROM asg")
def e13(t):
    return S.assign_sections(document_units(t)).select("paper_version_id", "unit", "section")


@query("e13_build_sections", f"""WITH {ASSIGNED},
sec AS MATERIALIZED (SELECT paper_version_id, section AS ordinal, max(CASE WHEN unit_type = 'HEADING' THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END) AS heading, min(page) AS page_start,
  max(page) AS page_end, count(*) AS units FROM asg GROUP BY 1, 2),
lv AS MATERIALIZED (SELECT *, CASE WHEN pre = '' OR heading IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(pre, '\\s*[.\\-]\\s*'), lambda p: p <> '')) - 1 END AS level
  FROM (SELECT *, coalesce(regexp_extract(heading, {duck.quote(S.NUMBER_PREFIX)}, 1), '') AS pre FROM sec) q)
SELECT paper_version_id, cast(ordinal AS bigint) AS ordinal, coalesce(heading, CASE WHEN (SELECT count(*) FROM lv b WHERE b.paper_version_id = a.paper_version_id) = 1 THEN '' ELSE '(front matter)' END) AS original_heading,
  page_start, page_end, units, cast(level AS integer) AS level, CASE WHEN level > 0 THEN (SELECT cast(max(ordinal) AS bigint) FROM lv b WHERE b.paper_version_id = a.paper_version_id AND b.ordinal < a.ordinal AND b.level < a.level) END AS parent_ordinal
FROM lv a""")
def e13_sections(t):
    return S.build_sections(S.assign_sections(document_units(t))).drop("normalized_class")


@query("e14_section_tree", """
SELECT concat('c', c_custkey) AS section_id, 2 AS depth, coalesce(n, 0) AS evidence_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey
UNION ALL SELECT concat('n', n_nationkey), 1, 0 FROM nation UNION ALL SELECT concat('r', r_regionkey), 0, 0 FROM region""")
def e14(t):
    text = "string"
    sections = (
        t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("section_id"), F.lit(None).cast(text).alias("parent_section_id"))
        .unionByName(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("section_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_section_id")))
        .unionByName(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("section_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_section_id")))
    )
    evidence = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("section_id"))
    return S.section_tree(sections, evidence).select("section_id", "depth", "evidence_count")


# ---- merging native and OCR lines ----------------------------------------------------

BOXES = """b AS MATERIALIZED (SELECT doc_id AS paper_version_id, cast(1 + floor(ordinal / 20) AS int) AS page, cast(ordinal AS int) AS ordinal, line AS text,
  cast((ordinal % 7) * 10 AS double) AS x0, cast((ordinal % 20) * 36 AS double) AS y0, cast((ordinal % 7) * 10 + least(length(line), 400) AS double) AS x1, cast((ordinal % 20) * 36 + 10 AS double) AS y1,
  CASE WHEN ordinal % 6 = 1 THEN 'FIGURE' WHEN ordinal % 6 = 2 THEN 'HEADING' ELSE 'PARAGRAPH' END AS unit_type,
  CASE doc_id % 5 WHEN 0 THEN 'NATIVE_TEXT' WHEN 1 THEN 'SCANNED' WHEN 2 THEN 'MIXED' WHEN 3 THEN 'BROKEN_TEXT_LAYER' ELSE 'IMAGE_HEAVY' END AS mode FROM lines)"""


def boxes(t):
    lines = readers.text_lines(t.documents)
    return lines.select(
        F.col("doc_id").alias("paper_version_id"),
        F.expr("cast(1 + floor(ordinal / 20) AS int)").alias("page"),
        F.col("ordinal"),
        F.col("line").alias("text"),
        F.struct(
            ((F.col("ordinal") % 7) * 10).cast("double").alias("x0"),
            ((F.col("ordinal") % 20) * 36).cast("double").alias("y0"),
            ((F.col("ordinal") % 7) * 10 + F.least(F.length("line"), F.lit(400))).cast("double").alias("x1"),
            ((F.col("ordinal") % 20) * 36 + 10).cast("double").alias("y1"),
        ).alias("bbox"),
        F.expr("CASE WHEN ordinal % 6 = 1 THEN 'FIGURE' WHEN ordinal % 6 = 2 THEN 'HEADING' ELSE 'PARAGRAPH' END").alias("unit_type"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN 'NATIVE_TEXT' WHEN 1 THEN 'SCANNED' WHEN 2 THEN 'MIXED' WHEN 3 THEN 'BROKEN_TEXT_LAYER' ELSE 'IMAGE_HEAVY' END").alias("mode"),
    )


def page_sizes(rows):
    return rows.select("paper_version_id", "page", "mode").distinct().select(
        "*", F.lit(612.0).alias("width_pt"), F.lit(792.0).alias("height_pt")
    )


def raw_ocr(rows):
    """OCR sees every line, shifted by a point; some boxes run off the page."""
    scale = 200.0 / 72.0
    off = F.when(F.col("ordinal") % 11 == 3, 900.0).otherwise(0.0)
    return rows.select(
        "paper_version_id", "page", "ordinal", "text",
        F.struct(
            (F.col("bbox.x0") * scale).alias("x0"), ((F.col("bbox.y0") + 18) * scale).alias("y0"),
            ((F.col("bbox.x1") + off) * scale).alias("x1"), ((F.col("bbox.y1") + 18) * scale).alias("y1"),
        ).alias("bbox_px"),
        F.when(F.col("ordinal") % 4 > 0, 0.5).alias("confidence"),
    )


OCR = LINES + ", " + BOXES + """, ocr AS MATERIALIZED (SELECT paper_version_id, page, ordinal, text, mode, ordinal % 11 = 3 AS off, x0, y0 + 18 AS y0, least(x1, 612) AS x1, y1 + 18 AS y1,
  CASE WHEN ordinal % 4 > 0 THEN 0.5 END AS confidence FROM b)"""


@query("e7_ocr_units", f"""WITH {OCR} SELECT paper_version_id, ordinal, CASE WHEN NOT off THEN round(x0, 4) END AS x0, CASE WHEN NOT off THEN round(y1, 4) END AS y1,
  list_filter(['source:ocr_fallback', CASE WHEN off THEN 'bbox_out_of_page:dropped' END, CASE WHEN confidence IS NULL THEN 'OCR_CONFIDENCE_UNAVAILABLE' END], lambda x: x IS NOT NULL) AS flags FROM ocr""")
def e7(t):
    rows = boxes(t)
    return E.ocr_units(raw_ocr(rows), page_sizes(rows)).select(
        "paper_version_id", "ordinal", F.round("bbox.x0", 4).alias("x0"), F.round("bbox.y1", 4).alias("y1"), "flags"
    )


MERGED = OCR + """,
native AS (SELECT * FROM b),
fresh AS (SELECT o.* FROM ocr o WHERE mode = 'MIXED' AND (off OR NOT EXISTS (SELECT 1 FROM native n WHERE n.paper_version_id = o.paper_version_id AND n.page = o.page AND n.unit_type <> 'FIGURE'
  AND (o.x0 + o.x1) / 2 BETWEEN n.x0 AND n.x1 AND (o.y0 + o.y1) / 2 BETWEEN n.y0 AND n.y1))),
merged AS MATERIALIZED (SELECT paper_version_id, page, mode, unit_type, text, x0, y0, ordinal, 'PDF_NATIVE' AS source_method FROM native WHERE mode IN ('NATIVE_TEXT', 'IMAGE_HEAVY', 'MIXED') OR (mode = 'BROKEN_TEXT_LAYER' AND unit_type = 'FIGURE')
  UNION ALL SELECT paper_version_id, page, mode, 'PARAGRAPH', text, CASE WHEN NOT off THEN x0 END, CASE WHEN NOT off THEN y0 END, ordinal, 'OCR' FROM ocr WHERE mode IN ('SCANNED', 'BROKEN_TEXT_LAYER')
  UNION ALL SELECT paper_version_id, page, mode, 'PARAGRAPH', text, CASE WHEN NOT off THEN x0 END, CASE WHEN NOT off THEN y0 END, ordinal, 'OCR' FROM fresh)"""


def native_and_ocr(t):
    rows = boxes(t)
    sizes = page_sizes(rows)
    return rows, E.ocr_units(raw_ocr(rows), sizes), sizes.select("paper_version_id", "page", "mode")


@query("e8_merge_units", f"""WITH {MERGED} SELECT paper_version_id, page, source_method, unit_type, text,
  row_number() OVER (PARTITION BY paper_version_id, page ORDER BY y0 IS NULL, round_even(y0 / 4, 0), x0, source_method = 'OCR', ordinal) - 1 AS position FROM merged""")
def e8(t):
    return E.merge_units(*native_and_ocr(t)).select(
        "paper_version_id", "page", "source_method", "unit_type", "text", F.col("position").cast("long").alias("position")
    )


@query("e8_page_methods", f"""WITH {MERGED}, f AS (SELECT paper_version_id, page, bool_or(source_method = 'OCR') AS o, bool_or(source_method = 'PDF_NATIVE' AND unit_type <> 'FIGURE') AS n FROM merged GROUP BY 1, 2)
SELECT p.paper_version_id, p.page, mode, CASE WHEN mode IN ('NATIVE_TEXT', 'IMAGE_HEAVY') THEN 'PDF_NATIVE' WHEN mode = 'SCANNED' THEN 'OCR' WHEN NOT coalesce(o, false) THEN 'PDF_NATIVE'
  WHEN mode = 'MIXED' AND coalesce(n, false) THEN 'MIXED_NATIVE_OCR' ELSE 'OCR' END AS page_method FROM (SELECT DISTINCT paper_version_id, page, mode FROM b) p
LEFT JOIN f ON p.paper_version_id = f.paper_version_id AND p.page = f.page""")
def e8_methods(t):
    native, ocr, modes = native_and_ocr(t)
    return E.page_methods(E.merge_units(native, ocr, modes), modes)


@query("e6_drop_inside_tables", f"""WITH {OCR}, walls AS (SELECT * FROM b WHERE unit_type = 'HEADING')
SELECT paper_version_id, ordinal FROM b WHERE NOT EXISTS (SELECT 1 FROM walls w WHERE w.paper_version_id = b.paper_version_id AND w.page = b.page
  AND (b.x0 + b.x1) / 2 BETWEEN w.x0 AND w.x1 AND (b.y0 + b.y1) / 2 BETWEEN w.y0 AND w.y1 + 60)""")
def e6(t):
    rows = boxes(t)
    taller = F.struct("bbox.x0", "bbox.y0", "bbox.x1", (F.col("bbox.y1") + 60).alias("y1"))
    walls = rows.where("unit_type = 'HEADING'").withColumn("bbox", taller)
    return E.drop_inside_tables(rows, walls).select("paper_version_id", "ordinal")


@query("e6_figure_units", f"""WITH {OCR} SELECT DISTINCT paper_version_id, page, x0, y0 FROM b WHERE (x1 - x0) * (y1 - y0) / (612.0 * 792.0) >= 0.004""")
def e6_figures(t):
    rows = boxes(t)
    return E.figure_units(rows, page_sizes(rows), 0.004).select("paper_version_id", "page", "bbox.x0", "bbox.y0")


@query("e9_report_rollup", f"""WITH {OCR}, u AS (SELECT paper_version_id, count(*) AS units, count(*) FILTER (WHERE length(trim(text)) > 0) AS text_units,
  count(*) FILTER (WHERE ordinal % 2 = 1 AND ordinal % 4 = 3) AS ocr_warnings, bool_and(x1 <= 360) AS location_sane FROM b GROUP BY 1),
p AS (SELECT paper_version_id, count(DISTINCT page) AS pages, bool_or(mode = 'BROKEN_TEXT_LAYER') AS broken FROM b GROUP BY 1)
SELECT d.doc_id AS paper_version_id, coalesce(units, 0) AS units, coalesce(ocr_warnings, 0) AS ocr_warnings, coalesce(location_sane, true) AS location_sane, coalesce(pages, 0) = greatest(1, n_chars // 2000) AS page_count_consistent,
  CASE WHEN coalesce(text_units, 0) = 0 THEN 'POOR' WHEN coalesce(ocr_warnings, 0) > 0 OR NOT coalesce(location_sane, true) OR coalesce(broken, false) THEN 'DEGRADED' ELSE 'GOOD' END AS quality_state
FROM documents d LEFT JOIN u ON d.doc_id = u.paper_version_id LEFT JOIN p ON d.doc_id = p.paper_version_id""")
def e9(t):
    rows = boxes(t)
    units = rows.withColumn("source_method", F.when(F.col("ordinal") % 2 == 1, "OCR").otherwise("PDF_NATIVE")).withColumn(
        "ocr_confidence", F.when(F.col("ordinal") % 4 != 3, 0.9)
    )
    sizes = page_sizes(rows).withColumn("width_pt", F.lit(356.0)).withColumn("ocr_failed", F.lit(False)).withColumn(
        "ocr_unavailable", F.lit(False)
    )
    versions = t.documents.select(
        F.col("doc_id").alias("paper_version_id"), F.greatest(F.lit(1), F.expr("n_chars div 2000")).alias("page_count")
    )
    return E.report_rollup(units, sizes, versions).select(
        "paper_version_id", "units", "ocr_warnings", "location_sane", "page_count_consistent", "quality_state"
    )


@query("e10_extraction_sanity", f"""WITH {OCR}, p AS (SELECT DISTINCT paper_version_id, page FROM b WHERE page <> 3),
f AS (SELECT paper_version_id, count(*) AS pages, max(page) AS last_page, min(page) AS first_page FROM p GROUP BY 1),
n AS (SELECT paper_version_id, max(page) AS page_count FROM b GROUP BY 1)
SELECT n.paper_version_id, CASE WHEN coalesce(pages, 0) <> page_count OR coalesce(first_page, 0) <> 1 THEN 'FAIL' WHEN n.paper_version_id % 7 = 0 THEN 'WARN' ELSE 'PASS' END AS outcome FROM n LEFT JOIN f ON n.paper_version_id = f.paper_version_id""")
def e10(t):
    rows = boxes(t)
    reports = rows.groupBy("paper_version_id").agg(F.max("page").alias("page_count")).select(
        "*", F.lit(True).alias("location_sane"), F.lit(False).alias("empty_text"),
        F.when(F.col("paper_version_id") % 7 == 0, 1).otherwise(0).alias("ocr_warnings"),
    )
    numbers = rows.where("page <> 3").select("paper_version_id", "page").distinct()
    units = rows.withColumn("holding_page", F.col("page")).withColumn("asset_sha256", F.lit(None).cast("string"))
    return E.extraction_sanity(reports, numbers, units).select("paper_version_id", "outcome")


@query("s2_report_units", f"""WITH {OCR} SELECT cast(paper_version_id AS varchar) AS paper_version_id, page, ordinal, text FROM b
UNION ALL SELECT 'unreadable', NULL, count(DISTINCT paper_version_id), NULL FROM b""")
def s2(t):
    """Reports written to files, one JSON object per line beside a broken line for each, and read back."""
    unit = F.struct(
        "unit_type", F.col("page").alias("page_number"), F.col("ordinal").cast("int").alias("ordinal"), "bbox", "text"
    )
    per_page = boxes(t).groupBy("paper_version_id", "page", "mode").agg(F.collect_list(unit).alias("units"))
    reports = per_page.groupBy("paper_version_id").agg(
        F.collect_list(F.struct(F.col("page").alias("page_number"), "mode", "units")).alias("pages")
    )
    whole = F.to_json(
        F.struct(F.lit("run").alias("run_id"), F.col("paper_version_id").cast("string").alias("paper_version_id"), "pages")
    )
    lines = reports.select(F.explode(F.array(whole, F.concat(F.lit("{broken "), "paper_version_id"))).alias("value"))
    path = f"{shared_folder(t.spark)}/reports"
    lines.write.text(path)
    good, bad = readers.read_reports(t.spark, path, lines=True)
    units = readers.report_units(good).select("paper_version_id", "page", F.col("ordinal").cast("long").alias("ordinal"), "text")
    none = F.lit(None)
    failed = bad.agg(F.count("*").alias("n")).select(
        F.lit("unreadable").alias("paper_version_id"), none.cast("int").alias("page"), F.col("n").alias("ordinal"), none.cast("string").alias("text")
    )
    return units.unionByName(failed)


# ---- responses, redaction, metadata ----------------------------------------------------

RAW = """raw AS MATERIALIZED (SELECT concat(conv_id, '_', turn) AS response_id, conv_id, turn, text, CASE
  WHEN turn % 8 = 5 THEN concat('I''m sorry, but ', text) WHEN turn % 8 = 3 THEN text WHEN turn % 8 = 7 THEN concat('{"status": "NOPE", "n": ', conv_id, '}')
  WHEN conv_id % 2 = 0 THEN concat('```json', chr(10), '{"status": "SUCCESS", "n": ', conv_id, '}', chr(10), '```') ELSE concat('{"status": "SUCCESS", "n": ', conv_id, '}') END AS content FROM conversations WHERE role = 'assistant')"""


@query("e18_parse_payload", f"""WITH {RAW} SELECT response_id, CASE WHEN regexp_matches(content, {duck.quote(X.REFUSAL)}) THEN 'LLM_005'
  WHEN turn % 8 IN (3, 5) THEN 'LLM_003' WHEN turn % 8 = 7 THEN 'LLM_004' END AS code FROM raw""")
def e18(t):
    turn, conv = F.col("turn"), F.col("conv_id")
    good = F.concat(F.lit('{"status": "SUCCESS", "n": '), conv, F.lit("}"))
    content = (
        F.when(turn % 8 == 5, F.concat(F.lit("I'm sorry, but "), "text"))
        .when(turn % 8 == 3, F.col("text"))
        .when(turn % 8 == 7, F.concat(F.lit('{"status": "NOPE", "n": '), conv, F.lit("}")))
        .when(conv % 2 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .otherwise(good)
    )
    raw = t.conversations.where("role = 'assistant'").select(
        F.concat_ws("_", conv, turn).alias("response_id"), content.alias("content")
    )
    return R.parse_payload(raw).select("response_id", "code")


ANSWERS = f"""
ans AS MATERIALIZED (SELECT c.claim_id, c.paper_version_id, cast(c.created_at AS date) AS d, c.claim_type, c.statement, l.evidence_id, l.role FROM claims c JOIN claim_evidence l ON l.claim_id = c.claim_id WHERE l.role <> 'CONTEXT'),
resp AS MATERIALIZED (SELECT *, concat(paper_version_id, '_', d) AS response_id FROM ans),
stat AS MATERIALIZED (SELECT response_id, count(*) AS n, count(DISTINCT lower({duck.squeeze('statement')})) AS k, bool_or(e.evidence_id IS NULL) AS unknown FROM resp r LEFT JOIN evidence e ON e.evidence_id = r.evidence_id GROUP BY 1),
chk AS MATERIALIZED (SELECT r.*, n, k, unknown, {duck.numbers('statement')} AS nums, {duck.tokens('statement')} AS toks, lower(coalesce(e.text, '')) AS low FROM resp r JOIN stat ON stat.response_id = r.response_id LEFT JOIN evidence e ON e.evidence_id = r.evidence_id)"""


@query("e19_validate_candidates", f"""WITH {ANSWERS} SELECT response_id, claim_type, {duck.squeeze('statement')} AS statement, CASE WHEN n > 40 THEN 'REJECTED:too_many_claims' WHEN k < n THEN 'REJECTED:duplicate_statement' WHEN unknown THEN 'REJECTED:EVIDENCE_001'
  WHEN claim_type = 'FACT' AND role <> 'SUPPORT' THEN 'DROPPED:no_support' WHEN claim_type = 'FACT' AND NOT (len(list_filter(nums, lambda x: NOT contains(replace(low, ',', ''), x))) = 0
    AND (len(toks) = 0 OR len(list_filter(toks, lambda w: contains(low, w))) >= greatest(1, len(toks) // 3))) THEN 'DROPPED:unsupported' ELSE 'KEPT' END AS outcome FROM chk""")
def e19(t):
    parsed = R.parse_payload(answers(t))
    return R.validate_candidates(parsed, t.evidence).select("response_id", "claim_type", "statement", "outcome")


def answers(t):
    """One response per version and day. Its claims are sorted: a response is read more than once, and
    positions in it must be the same each time, in whatever order a shuffle brings its claims."""
    links = t.claim_evidence.where("role <> 'CONTEXT'")
    rows = t.claims.join(links, "claim_id").select(
        F.concat_ws("_", "paper_version_id", F.to_date("created_at")).alias("response_id"),
        "paper_version_id",
        F.struct(
            "claim_type", "category", "statement", F.array(F.struct("evidence_id", "role")).alias("evidence")
        ).alias("claim"),
    )
    # A response is one day's claims of one version, so it is small.
    claims = F.array_sort(F.collect_list("claim")).alias("claims")
    return rows.groupBy("response_id", "paper_version_id").agg(
        F.to_json(F.struct(F.lit("SUCCESS").alias("status"), claims)).alias("content")
    )


REDACTED = "text"
for _pattern, _replacement in X.SECRETS:
    REDACTED = f"regexp_replace({REDACTED}, {duck.quote(_pattern)}, {duck.quote(_replacement.replace('$1', chr(92) + '1'))}, 'g')"


@query("e20_redact", f"SELECT doc_id, {REDACTED} AS text FROM documents")
def e20(t):
    return t.documents.select("doc_id", X.redact(F.col("text")).alias("text"))


@query("e20_redact_map", f"""SELECT doc_id, '[REDACTED]' AS api_key, {REDACTED} AS note FROM documents""")
def e20_map(t):
    data = F.create_map(F.lit("api_key"), F.col("source"), F.lit("note"), F.col("text"))
    clean = X.redact_map(data)
    return t.documents.select("doc_id", clean["api_key"].alias("api_key"), clean["note"].alias("note"))


@query("e20_redact_json", f"""
SELECT doc_id, concat('{{"items":[{{"api_key":"[REDACTED]","line":', note, '}}],"meta":{{"deep":[[', to_json(doc_id), ',', note, ']],"headers":"[REDACTED]","lang":', to_json(lang), '}},"note":', note, '}}') AS redacted
FROM (SELECT doc_id, lang, cast(to_json({REDACTED}) AS varchar) AS note FROM documents) q""")
def e20_json(t):
    """Objects in arrays, arrays in arrays and a sensitive key over an object, built from every document."""
    text, one = F.to_json(F.array("text")), F.to_json(F.array("source"))
    deep = F.concat(F.lit("[["), F.col("doc_id").cast("string"), F.lit(","), F.regexp_replace(text, r"^\[|\]$", ""), F.lit("]]"))
    body = F.concat(
        F.lit('{"note": '), F.regexp_replace(text, r"^\[|\]$", ""), F.lit(', "meta": {"lang": "'), F.col("lang"), F.lit('", "headers": {"x": '), one,
        F.lit('}, "deep": '), deep, F.lit('}, "items": [{"line": '), F.regexp_replace(text, r"^\[|\]$", ""), F.lit(', "api_key": '), one, F.lit("}]}"),
    )
    return RD.redact_json(t.documents.select("doc_id", body.alias("body")), "doc_id", "body")


@query("e23_normalize_metadata", """
SELECT doc_id, concat('10.1/', doc_id) AS identifier, CASE WHEN lang = 'de' THEN '' ELSE concat('T ', n_chars) END AS title, [concat('A ', source)] AS authors, 2000 + doc_id % 20 AS year, lang = 'de' AS malformed FROM documents""")
def e23(t):
    raw = t.documents.select(
        "doc_id",
        F.to_json(
            F.struct(
                F.concat(F.lit("10.1/"), "doc_id").alias("DOI"),
                F.array(F.when(F.col("lang") == "de", "").otherwise(F.concat(F.lit("T "), "n_chars"))).alias("title"),
                F.array(F.struct(F.lit("A").alias("given"), F.col("source").alias("family"))).alias("author"),
                F.struct(F.array(F.array((F.lit(2000) + F.col("doc_id") % 20).cast("int"))).alias("date-parts")).alias("issued"),
            )
        ).alias("content"),
    )
    return R.normalize_metadata(raw, "crossref").select(
        "doc_id", "identifier", "title", "authors", F.col("year").cast("long").alias("year"), "malformed"
    )
