"""Streaming jobs run over the given tables until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia import tables as C
from evidentia.operators import identity as I
from evidentia.plans.inputs import Tables
from evidentia.plans.records import LINES
from evidentia.plans.registry import query
from evidentia.session import shared_folder
from evidentia.streaming import jobs as J
from evidentia.streaming import stateful as SF


def live(t, *names: str) -> Tables:
    return Tables(t.spark, t.sf_dir, streaming=names)


def finish(stream, mode: str = "append"):
    return J.run_to_end(stream, shared_folder(stream.sparkSession), mode)


@query("st1_provider_health", """
SELECT time_bucket(INTERVAL 5 MINUTE, occurred) AS window_start, provider, count(*) FILTER (WHERE kind = 'attempt') AS attempts,
  count(*) FILTER (WHERE kind = 'attempt' AND status <> 'OK') / nullif(count(*) FILTER (WHERE kind = 'attempt'), 0) AS error_rate,
  count(*) FILTER (WHERE kind = 'schema' AND success) / nullif(count(*) FILTER (WHERE kind = 'schema'), 0) AS schema_pass_rate FROM provider_events GROUP BY 1, 2""")
def st1(t):
    return rolling(t).drop("latencies", "latency_p50", "latency_p90")


def rolling(t, slide: str | None = None):
    panes = J.provider_panes(stamped(live(t, "events").provider_events))
    stored = J.run_keyed(panes, shared_folder(t.spark), ["pane_start", "provider"])
    return J.rolling_health(stored, "5 minutes", slide)


# A sketch may miss the asked rank by this share of a window's values.
RANK_ERROR = 0.03


@query("st1_sliding_quantiles", """
SELECT window_start, provider, count(*) AS latencies, true AS p50_within, true AS p90_within
FROM (SELECT provider, kind, unnest(range(5)) AS k, time_bucket(INTERVAL 1 MINUTE, occurred) AS pane FROM provider_events WHERE kind = 'latency') q,
  LATERAL (SELECT pane - k * INTERVAL 1 MINUTE AS window_start) w GROUP BY 1, 2""")
def st1_sliding(t):
    """Merged sketches against the latencies themselves: is each quantile within the rank error?"""
    health = rolling(t, "1 minute").where("latencies > 0")
    events = stamped(t.provider_events).where("kind = 'latency'").select("provider", F.window("occurred", "5 minutes", "1 minute").start.alias("window_start"), "latency_ms")
    seen = health.join(events, ["provider", "window_start"]).groupBy("window_start", "provider", "latencies", "latency_p50", "latency_p90").agg(
        *[F.count_if(F.col("latency_ms") < F.col(q)).alias(f"{q}_below") for q in ("latency_p50", "latency_p90")],
        *[F.count_if(F.col("latency_ms") <= F.col(q)).alias(f"{q}_upto") for q in ("latency_p50", "latency_p90")],
    )

    def within(name: str, q: float):
        low, high = F.col(f"latency_{name}_below") / F.col("latencies"), F.col(f"latency_{name}_upto") / F.col("latencies")
        return ((low <= q + RANK_ERROR) & (high >= q - RANK_ERROR)).alias(f"{name}_within")

    return seen.select("window_start", "provider", "latencies", within("p50", 0.5), within("p90", 0.9))


def stamped(events):
    """Event time as a timestamp with time zone, which watermarks need."""
    return events.withColumn("occurred", F.col("occurred").cast("timestamp"))


@query("st2_first_dispatches", "SELECT DISTINCT concat(provider, '|', kind, '|', cast(event_id // 10 AS varchar)) AS dispatch FROM provider_events")
def st2(t):
    events = stamped(live(t, "events").provider_events)
    keyed = I.task_keys(events.withColumn("slot", F.expr("event_id div 10")), ["provider", "kind", "slot"], "kind")
    return finish(J.first_dispatches(keyed)).select(F.concat_ws("|", "provider", "kind", "slot").alias("dispatch"))


LEGAL = " OR ".join(f"(s.current = '{k}' AND e.state IN ({', '.join(repr(x) for x in v)}))" for k, v in C.TASK_TRANSITIONS.items())


@query("st3_task_steps", f"""
WITH RECURSIVE e AS (SELECT job_id AS task_id, task_id AS event_id, state, row_number() OVER (PARTITION BY job_id ORDER BY created_at, task_id) AS i FROM tasks),
s AS (SELECT task_id, i, event_id, NULL::VARCHAR AS before, state AS after, true AS legal, state AS current, cast(state = 'RETRYING' AS integer) AS retries FROM e WHERE i = 1
  UNION ALL SELECT e.task_id, e.i, e.event_id, s.current, e.state, ({LEGAL}), CASE WHEN {LEGAL} THEN e.state ELSE s.current END,
    s.retries + cast(({LEGAL}) AND e.state = 'RETRYING' AS integer) FROM s JOIN e ON e.task_id = s.task_id AND e.i = s.i + 1)
SELECT task_id, event_id, before, after, legal, retries FROM s""")
def st3(t):
    tasks = live(t, "lineitem").tasks.select(
        F.col("job_id").alias("task_id"), F.col("task_id").alias("event_id"), F.col("created_at").cast("timestamp").alias("occurred"), "state"
    )
    with SF.rocksdb_state(t.spark):
        return finish(SF.task_steps(tasks))


@query("st4_worker_freshness", """
WITH b AS (SELECT provider AS identity, max(epoch_us(occurred) / 1000000.0) AS last_seen FROM provider_events GROUP BY 1)
SELECT identity, round(last_seen, 3) AS last_seen, CASE WHEN 1706658900.0 - last_seen <= 60 THEN 'FRESH' ELSE 'STALE' END AS state FROM b WHERE greatest(0, 1706658900.0 - last_seen) <= 86400""")
def st4(t):
    latest = changes(t).groupBy("identity").agg(F.max("last_seen").alias("last_seen"))
    return J.worker_freshness(latest, 1706658900.0).select("identity", F.round("last_seen", 3).alias("last_seen"), "state")


def changes(t):
    """Changes of worker states, with the time of the beats as the clock."""
    beats = stamped(live(t, "events").provider_events).withWatermark("occurred", "0 seconds").select(
        F.col("provider").alias("identity"), (F.unix_micros("occurred") / 1000000.0).alias("last_seen"), "occurred"
    )
    with SF.rocksdb_state(t.spark):
        return finish(SF.worker_states(beats, "EventTime"))


@query("st4_worker_changes", """
WITH b AS (SELECT provider AS identity, max(epoch_ms(occurred)) AS seen FROM provider_events GROUP BY 1),
a AS (SELECT identity, (SELECT max(seen) FROM b) - seen AS age FROM b)
SELECT identity, 'FRESH' AS state FROM a UNION ALL SELECT identity, CASE WHEN age > 86400000 THEN 'GONE' ELSE 'STALE' END FROM a WHERE age > 60000""")
def st4_changes(t):
    return changes(t).select("identity", "state")


@query("st5_trace_sessions", """
WITH e AS (SELECT provider AS trace_id, occurred, CASE WHEN occurred - lag(occurred) OVER w >= INTERVAL 30 MINUTE OR lag(occurred) OVER w IS NULL THEN 1 ELSE 0 END AS opens
  FROM provider_events WINDOW w AS (PARTITION BY provider ORDER BY occurred)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY trace_id ORDER BY occurred) AS n FROM e)
SELECT trace_id, min(occurred) AS session_start, count(*) AS events, min(occurred) AS first_at, max(occurred) AS last_at FROM s GROUP BY trace_id, n""")
def st5(t):
    events = stamped(live(t, "events").provider_events).withColumnRenamed("provider", "trace_id")
    return finish(J.trace_sessions(events), "complete")


@query("st6_ingest", f"WITH {LINES} SELECT DISTINCT doc_id AS paper_version_id, cast(1 + floor(ordinal / 40) AS integer) AS page_number, sha256(line) AS content_sha256 FROM lines")
def st6(t):
    folder = shared_folder(t.spark)
    J.ingest(live(t, "documents").documents, f"{folder}/evidence", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/evidence").select("paper_version_id", "page_number", "content_sha256")


CONTENT = f"""WITH {LINES}, found AS (SELECT DISTINCT sha256(d.text) AS paper_version_id, cast(1 + floor(ordinal / 40) AS integer) AS page_number, sha256(line) AS content_sha256, line
  FROM lines l JOIN documents d ON d.doc_id = l.doc_id)"""


def ingested(t) -> J.Store:
    """All documents through the three sinks; then the last batch once more, as after a failure."""
    folder = shared_folder(t.spark)
    store = J.Store.at(t.spark, f"{folder}/store", 16)
    J.ingest_chain(live(t, "documents").documents, store, f"{folder}/checkpoint").awaitTermination()
    store.ingest(t.documents, "b0")
    store.ingest(t.documents, "again")
    return store


@query("st6_chain_evidence", f"{CONTENT} SELECT paper_version_id, page_number, content_sha256 FROM found")
def st6_evidence(t):
    return ingested(t).evidence.rows().select("paper_version_id", "page_number", "content_sha256")


@query("st6_chain_projection", f"""{CONTENT} SELECT 'EVIDENCE' AS document_type, paper_version_id, page_number AS page_start, line AS content, content_sha256 FROM found WHERE length(trim(line)) > 0""")
def st6_projection(t):
    return ingested(t).projection.rows().select("document_type", "paper_version_id", "page_start", "content", "content_sha256")


@query("s6_keyed_append", "SELECT sha256(text) AS content_sha256, cast(min(cast(doc_id AS varchar)) AS varchar) AS doc_id FROM documents GROUP BY 1")
def s6_keyed(t):
    """Documents sent in two overlapping batches and once more are stored once each."""
    folder = shared_folder(t.spark)
    store = J.Store.at(t.spark, folder, 16)
    named = t.documents.select(F.sha2("text", 256).alias("content_sha256"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    first = named.groupBy("content_sha256").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d")).select("content_sha256", "d.*")
    store.documents.append(first.where("content_sha256 < 'a'"), "one")
    store.documents.append(first.where("content_sha256 > '5'"), "two")
    store.documents.append(named, "all")
    return store.documents.rows().select("content_sha256", "doc_id")
