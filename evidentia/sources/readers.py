"""Readers: canonical tables, extraction reports, text lines, logs, object lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia import tables


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A canonical table with its declared schema (pruned and filtered at the scan)."""
    return spark.read.schema(tables.schema_of(name)).parquet(f"{folder}/{name}")


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Extraction reports: (reports, unreadable texts).

    A file holds one JSON object, indented or not, or with ``lines`` one object per line.
    """
    raw = spark.read.text(path, wholetext=not lines).select(
        F.col("value").alias("raw"), F.input_file_name().alias("file")
    )
    parsed = raw.withColumn(
        "report", F.from_json("raw", tables.REPORT, {"mode": "PERMISSIVE"})
    )
    ok = F.col("report.run_id").isNotNull() & F.col("report.pages").isNotNull()
    return (
        parsed.where(ok).select("report.*"),
        parsed.where(~F.coalesce(ok, F.lit(False))).select("file", "raw"),
    )


def report_units(reports: DataFrame) -> DataFrame:
    """One row per unit of the given reports."""
    page = reports.select("run_id", "paper_version_id", F.explode("pages").alias("page"))
    return page.select(
        "run_id",
        "paper_version_id",
        F.col("page.page_number").alias("page"),
        F.col("page.mode").alias("mode"),
        F.explode("page.units").alias("unit"),
    ).select("run_id", "paper_version_id", "page", "mode", "unit.*")


def text_lines(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """(key, ordinal, line) without lines that hold only blanks or U+FFFD."""
    clean = F.translate(F.col(content), "\x00", "�")
    lines = docs.select(key, F.posexplode(F.split(clean, "\n", -1)).alias("ordinal", "line"))
    return lines.where(~F.col("line").rlike(r"(?U)^[\s\x{FFFD}]*$"))


def read_events(
    spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None
) -> DataFrame:
    """Provider events as JSON lines; fields outside the schema are dropped."""
    schema = tables.schema_of("provider_events")
    if not stream:
        return spark.read.schema(schema).json(path)
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def object_inventory(spark: SparkSession, root: str, hashes: bool = False) -> DataFrame:
    """Stored files: path, size, modification time and top-level class.

    Content is read only when ``hashes`` asks for the recomputed sha256.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # The file source reports absolute URIs; keys are relative to the root.
    tail = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    key = F.substring_index(tail, root.rstrip("/") + "/", -1)
    columns = [
        key.alias("storage_key"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.substring_index(key, "/", 1).alias("storage_class"),
    ]
    if hashes:
        columns.append(F.sha2("content", 256).alias("actual_sha256"))
    return files.select(*columns)
