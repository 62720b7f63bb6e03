"""Writers: idempotent appends, rebuilds, bundles and metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_new(batch: DataFrame, target: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new, reused): distinct batch rows by ``keys`` not yet / already in the target."""
    distinct = batch.dropDuplicates(keys)
    known = target.select(*keys).distinct()
    matches = [distinct[k].eqNullSafe(known[k]) for k in keys]
    condition = matches[0]
    for extra in matches[1:]:
        condition = condition & extra
    return distinct.join(known, condition, "left_anti"), distinct.join(known, condition, "left_semi")


def upsert_new(batch: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows of ``batch`` whose keys the Parquet table at ``path`` lacks."""
    spark = batch.sparkSession
    target = existing_or_empty(spark, path, batch)
    fresh, _ = split_new(batch, target, keys)
    fresh.write.mode("append").parquet(path)


def existing_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The Parquet table at ``path``, or no rows when it does not exist yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def delete_version(projection: DataFrame, versions: DataFrame) -> DataFrame:
    """The projection without the rows of the given versions."""
    return projection.join(versions.select("paper_version_id"), "paper_version_id", "left_anti")


def replace_versions(rows: DataFrame, path: str) -> None:
    """Overwrite only the version partitions present in ``rows``."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("paper_version_id")
        .parquet(path)
    )


def bundle_rows(
    requested: DataFrame, versions: DataFrame, parts: dict[str, DataFrame]
) -> DataFrame:
    """Export rows: one JSON line per item of each requested version.

    A line names its version, the part it belongs to and the item. Long versions
    spread over many lines and tasks; nothing is gathered into one document.
    Unknown versions give a single SKIPPED line.
    """
    known = versions.select("paper_version_id").distinct()
    wanted = requested.select("paper_version_id").distinct()
    out = wanted.join(known, "paper_version_id", "left_anti").select(
        "paper_version_id",
        F.lit("SKIPPED").alias("part"),
        F.lit("").alias("sort_key"),
        F.lit(None).cast("string").alias("item"),
    )
    present = wanted.join(known, "paper_version_id", "left_semi")
    for part, (df) in parts.items():
        fields = [c for c in df.columns if c != "paper_version_id"]
        rows = present.join(df, "paper_version_id").select(
            "paper_version_id",
            F.lit(part).alias("part"),
            F.col(fields[0]).cast("string").alias("sort_key"),
            F.to_json(F.struct(*fields)).alias("item"),
        )
        out = out.unionByName(rows)
    return out


def bundle_status(bundle: DataFrame) -> DataFrame:
    """Overall status: COMPLETE, or PARTIAL when any version was skipped."""
    return bundle.agg(
        F.when(F.count_if(F.col("part") == "SKIPPED") > 0, "PARTIAL")
        .otherwise("COMPLETE")
        .alias("status"),
        F.count_if(F.col("part") == "SKIPPED").alias("skipped"),
    )


def write_bundle(bundle: DataFrame, path: str) -> None:
    bundle.write.mode("overwrite").partitionBy("paper_version_id").json(path)


def handoff_check(bundle: DataFrame, limit: int = 200, max_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """Per version: claims, bytes and the reason a handoff is refused (or null)."""
    return bundle.groupBy("paper_version_id").agg(
        F.count_if(F.col("part") == "claims").alias("claims"),
        F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("bytes"),
        F.bool_or(F.col("part") == "SKIPPED").alias("skipped"),
    ).withColumn(
        "refused",
        F.when(F.col("skipped"), "unknown_version")
        .when(F.col("claims") > limit, "too_many_claims")
        .when(F.col("bytes") > max_bytes, "too_large"),
    ).drop("skipped")


def metric_line(metric: Column, labels: Column, value: Column) -> Column:
    """``name{k="v",...} value`` from a name, a label map and a value."""
    pairs = F.transform(
        F.array_sort(F.map_entries(labels)),
        lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')),
    )
    inner = F.array_join(pairs, ",")
    braces = F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit("{"), inner, F.lit("}")))
    return F.concat(metric, braces, F.lit(" "), value.cast("string"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Write (metric, labels, value) rows as text lines."""
    metrics.select(metric_line(F.col("metric"), F.col("labels"), F.col("value")).alias("value")).write.mode(
        "overwrite"
    ).text(path)
