"""Streaming jobs over provider events, task dispatches, heartbeats, traces and texts.

Each function maps a streaming DataFrame to a streaming DataFrame (or starts a
query), and gives on finished input what the matching batch operator gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia import tables
from evidentia.operators import evidence as E
from evidentia.operators import keyed, search
from evidentia.sources import readers, writers
from evidentia.sources.keyed_table import KeyedTable

FRESH_SECONDS = 60
RETENTION_SECONDS = 86400


def provider_health(
    events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Call counts, error and pass rates and latency quantiles per provider and window."""
    kind = F.col("kind")
    latency = F.when(kind == "latency", F.col("latency_ms"))
    grouped = (
        events.withWatermark("occurred", late)
        .groupBy(F.window("occurred", window, slide), "provider")
        .agg(
            F.count_if(kind == "attempt").alias("attempts"),
            F.count_if((kind == "attempt") & (F.col("status") != "OK")).alias("errors"),
            F.count_if(kind == "schema").alias("schemas"),
            F.count_if((kind == "schema") & F.col("success")).alias("schema_ok"),
            F.percentile_approx(latency, F.array(F.lit(0.5), F.lit(0.9)), F.lit(10000)).alias("q"),
        )
    )
    return grouped.select(
        F.col("window.start").alias("window_start"),
        "provider",
        "attempts",
        F.when(F.col("attempts") > 0, F.col("errors") / F.col("attempts")).alias("error_rate"),
        F.when(F.col("schemas") > 0, F.col("schema_ok") / F.col("schemas")).alias("schema_pass_rate"),
        F.get("q", F.lit(0)).alias("latency_p50"),
        F.get("q", F.lit(1)).alias("latency_p90"),
    )


def provider_panes(events: DataFrame, pane: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts and a latency sketch per provider and short pane, to be merged into any window.

    pane_start, provider, attempts, errors, schemas, schema_ok, latencies, sketch (KLL; null
    without latencies). State is one small row per open pane.
    """
    kind = F.col("kind")
    latency = F.when(kind == "latency", F.col("latency_ms").cast("double"))
    return (
        events.withWatermark("occurred", late)
        .groupBy(F.window("occurred", pane), "provider")
        .agg(
            F.count_if(kind == "attempt").alias("attempts"),
            F.count_if((kind == "attempt") & (F.col("status") != "OK")).alias("errors"),
            F.count_if(kind == "schema").alias("schemas"),
            F.count_if((kind == "schema") & F.col("success")).alias("schema_ok"),
            F.count(latency).alias("latencies"),
            F.kll_sketch_agg_double(latency).alias("sketch"),
        )
        .select(
            F.col("window.start").alias("pane_start"), "provider", "attempts", "errors", "schemas", "schema_ok",
            "latencies", F.when(F.col("latencies") > 0, F.col("sketch")).alias("sketch"),
        )
    )


def rolling_health(panes: DataFrame, window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Health per provider and window from ``provider_panes``; ``window`` and ``slide`` are whole panes.

    Counts add up and sketches merge, so a window never goes back to the events.
    """
    placed = panes.withColumn("window", F.window("pane_start", window, slide))
    merged = placed.groupBy(F.col("window.start").alias("window_start"), "provider").agg(
        *[F.sum(c).alias(c) for c in ("attempts", "errors", "schemas", "schema_ok", "latencies")],
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )

    def quantile(q: float):
        return F.when(F.col("latencies") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))

    return merged.select(
        "window_start",
        "provider",
        "attempts",
        F.when(F.col("attempts") > 0, F.col("errors") / F.col("attempts")).alias("error_rate"),
        F.when(F.col("schemas") > 0, F.col("schema_ok") / F.col("schemas")).alias("schema_pass_rate"),
        "latencies",
        quantile(0.5).alias("latency_p50"),
        quantile(0.9).alias("latency_p90"),
    )


def first_dispatches(dispatches: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first dispatch of each idempotency key within the watermark."""
    return dispatches.withWatermark("occurred", late).dropDuplicatesWithinWatermark(["idempotency_key"])


STATE = "state string, retries int"
STEPS = "event_id string, before string, after string, legal boolean, retries int"


def task_steps(events: DataFrame) -> DataFrame:
    """Every state change of a task with whether the rules allow it.

    The state of a task is kept between batches; an illegal step is reported and
    leaves it as it was; nothing may follow a terminal state. The first state is taken.
    ``events``: task_id, event_id, occurred, state.
    """
    legal = {k: frozenset(v) for k, v in tables.TASK_TRANSITIONS.items()}
    key_type = events.schema["task_id"].dataType.simpleString()

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        current, retries = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["occurred", "event_id"])
        out = []
        for event_id, after in zip(rows["event_id"], rows["state"], strict=True):
            ok = current is None or after in legal.get(current, frozenset())
            if ok:
                retries += after == "RETRYING"
            out.append((key[0], event_id, current, after, ok, int(retries)))
            if ok:
                current = after
        # A terminal state is kept too: later events of a finished task are illegal.
        if current is not None:
            state.update((current, int(retries)))
        yield pd.DataFrame(
            out, columns=["task_id", "event_id", "before", "after", "legal", "retries"]
        )

    return events.select("task_id", "event_id", "occurred", "state").groupBy("task_id").applyInPandasWithState(
        advance, f"task_id {key_type}, {STEPS}", STATE, "append", GroupStateTimeout.NoTimeout
    )


def last_beats(beats: DataFrame) -> DataFrame:
    """Newest heartbeat per worker; times that are not finite are ignored."""
    seen = F.col("last_seen")
    usable = beats.where(seen.isNotNull() & ~F.isnan(seen) & (F.abs(seen) < 1e18))
    return usable.groupBy("identity").agg(F.max("last_seen").alias("last_seen"))


def worker_freshness(latest: DataFrame, now: float) -> DataFrame:
    """FRESH up to a minute, STALE up to a day, then forgotten."""
    age = F.greatest(F.lit(0.0), F.lit(now) - F.col("last_seen"))
    return (
        latest.withColumn("age_seconds", age)
        .where(F.col("age_seconds") <= RETENTION_SECONDS)
        .withColumn("state", F.when(F.col("age_seconds") <= FRESH_SECONDS, "FRESH").otherwise("STALE"))
    )


def trace_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions per trace, closed by a pause."""
    return (
        events.withWatermark("occurred", late)
        .groupBy(F.session_window("occurred", gap).alias("session"), "trace_id")
        .agg(F.count("*").alias("events"), F.min("occurred").alias("first_at"), F.max("occurred").alias("last_at"))
        .select("trace_id", F.col("session.start").alias("session_start"), "events", "first_at", "last_at")
    )


def evidence_of(docs: DataFrame) -> DataFrame:
    """Evidence rows of raw documents: one per line, identified by content."""
    lines = readers.text_lines(docs)
    units = lines.select(
        F.col("doc_id").alias("paper_version_id"),
        F.lit("PARAGRAPH").alias("unit_type"),
        (F.floor(F.col("ordinal") / 40) + 1).cast("int").alias("page_number"),
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("line").alias("text"),
        F.lit("PDF_NATIVE").alias("source_method"),
        F.lit(None).cast("double").alias("ocr_confidence"),
        F.lit(None).cast("string").alias("asset_sha256"),
        F.lit(None).cast(tables.BOX).alias("bbox"),
        F.sha2("line", 256).alias("content_sha256"),
    )
    none = docs.sparkSession.createDataFrame([], "sha256 string, asset_id string")
    return E.persist_evidence(units, none)


def ingest(docs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the evidence of arriving documents; documents seen before add nothing.

    A replayed batch finds its rows already stored, so reruns are harmless.
    """

    def write(batch: DataFrame, _: int) -> None:
        writers.upsert_new(evidence_of(batch), path, ["evidence_id"])

    return (
        docs.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


#: What the documents of an ingest are kept as: content, and the first document that had it.
DOCUMENTS = T.StructType([T.StructField(n, T.StringType()) for n in ("content_sha256", "doc_id", "text")])


@dataclass(frozen=True)
class Store:
    """The three sinks of an ingest: documents by content, their evidence, the search projection.

    ``documents`` takes any rows; what ``ingest`` hands to the other two has every key once.
    """

    documents: KeyedTable
    evidence: KeyedTable
    projection: KeyedTable

    @classmethod
    def at(cls, spark: SparkSession, path: str, slots: int = 64) -> Store:
        one = spark.createDataFrame([], "doc_id string, text string")
        evidence = evidence_of(one).schema
        projection = search.build_projection(*projection_inputs(spark.createDataFrame([], evidence))).schema

        def table(name: str, schema: T.StructType, keys: str, slot_by: str) -> KeyedTable:
            return KeyedTable(spark, f"{path}/{name}", schema, (keys,), (slot_by,), slots, unique=True)

        return cls(
            KeyedTable(spark, f"{path}/documents", DOCUMENTS, ("content_sha256",), ("content_sha256",), slots),
            table("evidence", evidence, "evidence_id", "paper_version_id"),
            table("projection", projection, "document_id", "paper_version_id"),
        )

    def ingest(self, docs: DataFrame, commit: str) -> None:
        """One batch through all sinks; each takes what its predecessor committed under this name.

        A batch that stopped between two sinks is sent again under its name: sinks that have it
        do nothing, the others see the same rows as before.
        """
        named = docs.where(F.col("text").isNotNull()).select(
            F.sha2("text", 256).alias("content_sha256"), F.col("doc_id").cast("string").alias("doc_id"), "text"
        )
        first = named.groupBy("content_sha256").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d"))
        self.documents.append(first.select("content_sha256", "d.*"), commit)
        new = self.documents.committed(commit).select(F.col("content_sha256").alias("doc_id"), "text")
        # Texts move, not their lines: equal lines of a document are where it is. Evidence is one row
        # per identifier, and a projection of it one row per evidence.
        self.evidence.append(evidence_of(new.repartition("doc_id")), commit)
        self.projection.append(search.build_projection(*projection_inputs(self.evidence.committed(commit))), commit)


def projection_inputs(evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence as the search projection takes it, with no claims and no papers."""
    spark = evidence.sparkSession
    rows = evidence.select(
        "evidence_id", "paper_version_id", F.col("paper_version_id").alias("paper_id"), F.lit(None).cast("string").alias("section_id"),
        F.col("evidence_type") if "evidence_type" in evidence.columns else F.col("unit_type").alias("evidence_type"),
        F.col("page_number").alias("page_start"), "text",
    )
    claims = "claim_id string, paper_id string, paper_version_id string, claim_type string, category string, statement string, support_state string"
    return rows, spark.createDataFrame([], claims), spark.createDataFrame([], "paper_id string, canonical_title string")


def ingest_chain(docs: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Arriving documents to stored content, evidence and search documents, each once."""
    return (
        docs.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: store.ingest(batch, f"b{number}"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_keyed(stream: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Write the changed rows of every batch to a folder of that batch; a repeated batch replaces its own.

    Update mode: the state holds open windows only, and a batch writes only what it changed.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return (
        stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("update")
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_keyed(spark: SparkSession, stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The newest row of every key that ``start_keyed`` wrote."""
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{folder}/out")
    return keyed.latest_by(rows, keys, ["batch"]).drop("batch")


def run_keyed(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Process all available input in update mode and return the newest row of every key."""
    start_keyed(stream, folder).awaitTermination()
    return read_keyed(stream.sparkSession, stream, folder, keys)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process all available input and return the sink's final content."""
    spark = stream.sparkSession
    path, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", path).trigger(availableNow=True).start()
    else:

        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        query = writer.foreachBatch(replace).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
