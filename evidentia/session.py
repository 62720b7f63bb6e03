"""Session settings and lineage helpers shared by every job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold on a laptop and on a cluster alike. The number of
#: shuffle partitions is left to the caller: adaptive execution coalesces it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "false",
    # Grouped sets here are small, so hash more groups before sorting them.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "50000",
}


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("evidentia")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or else one below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares, for sinks and checkpoints."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder.

    Iterative jobs call this once per round. The files must survive the loss of an
    executor, so they are never in a folder of one machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    For results with about a row per input row: columns are compressed, and a reader takes
    only those it needs, which a checkpoint of whole rows does not allow.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
