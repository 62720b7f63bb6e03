"""Operational analytics: tasks, jobs, providers, traces, storage and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import tables
from evidentia.functions import text as X
from evidentia.operators import keyed

# State groups and thresholds.
WAITING = ("PENDING", "QUEUED", "WAITING")
WORKING = ("RUNNING", "RETRYING")
SUCCESS = ("SUCCEEDED", "SUCCEEDED_WITH_WARNINGS")
STATE_PRIORITY = (
    "FAILED",
    "RUNNING",
    "RETRYING",
    "BLOCKED",
    "WAITING",
    "QUEUED",
    "PENDING",
    "CANCELLED",
    "SUCCEEDED_WITH_WARNINGS",
    "SUCCEEDED",
    "SKIPPED",
)
STALE_SECONDS = 300
CANARY_SECONDS = 86400
RATE_LIMIT_CODES = ("LLM_002", "PROVIDER_002")
LOW_OCR = 0.8
SCHEMA_FAILURES = ("JSON_INVALID", "SCHEMA_INVALID", "SEMANTIC_INVALID", "EVIDENCE_INVALID")
STORAGE_CLASSES = {
    "objects": "KEEP",
    "cache": "CACHE",
    "temp": "TEMP",
    "tmp": "TEMP",
    "debug": "DEBUG_TTL",
}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1_000_000.0


# ---- counts ------------------------------------------------------------------------


def corpus_totals(inputs: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    out = None
    for name, df in inputs.items():
        row = df.agg(F.count("*").alias("total")).select(F.lit(name).alias("name"), "total")
        out = row if out is None else out.unionByName(row)
    return out


def queue_counts(tasks: DataFrame) -> DataFrame:
    state = F.col("state")
    return tasks.agg(
        F.count_if(state.isin(*WAITING)).alias("pending"),
        F.count_if(state.isin(*WORKING)).alias("running"),
        F.count_if(state == "FAILED").alias("failed"),
    )


def tasks_by_type(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_type", "state").agg(F.count("*").alias("tasks"))


def labelled(df: DataFrame, metric: str, labels: dict[str, str], value: Column | None = None) -> DataFrame:
    """(metric, labels, value) rows from a grouped count."""
    columns = list(labels.values())
    grouped = df.groupBy(*columns).agg((value if value is not None else F.count("*")).cast("double").alias("value"))
    pairs: list[Column] = []
    for label, column in labels.items():
        pairs += [F.lit(label), F.col(column).cast("string")]
    data = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return grouped.select(F.lit(metric).alias("metric"), data.alias("labels"), "value")


def ops_metrics(
    jobs: DataFrame,
    tasks: DataFrame,
    model_calls: DataFrame,
    evidence: DataFrame,
    claims: DataFrame,
    verifications: DataFrame,
) -> DataFrame:
    """All counters in long form: metric, labels, value."""
    live = ("PENDING", "QUEUED", "RUNNING", "WAITING", "RETRYING", "BLOCKED")

    def pages(name: str, rows: DataFrame) -> DataFrame:
        return labelled(rows.select("paper_version_id", "page_start").distinct(), name, {})

    def summary(name: str, df: DataFrame, duration: Column, labels: dict[str, str]) -> list[DataFrame]:
        usable = df.withColumn("_d", duration).where(F.col("_d") >= 0)
        return [
            labelled(usable, f"{name}_count", labels),
            labelled(usable, f"{name}_sum", labels, F.round(F.sum("_d"), 6)),
        ]

    provider = {"provider": "provider_id", "model": "model_id"}
    parts = [
        labelled(jobs, "jobs_total", {}),
        labelled(jobs.where(F.col("state").isin(*live)), "jobs_active", {}),
        labelled(jobs.where("state = 'FAILED'"), "jobs_failed_total", {}),
        labelled(tasks, "tasks_total", {"type": "task_type", "state": "state"}),
        labelled(model_calls, "provider_requests_total", {**provider, "status": "transport_status"}),
        labelled(model_calls.where("transport_status = 'RATE_LIMITED'"), "provider_rate_limit_total", {}),
        labelled(model_calls.where(F.col("schema_status").isin(*SCHEMA_FAILURES)), "provider_schema_fail_total", {}),
        labelled(evidence, "evidence_created_total", {"type": "evidence_type"}),
        labelled(claims, "claims_created_total", {"type": "claim_type"}),
        labelled(claims, "claims_status_total", {"support_state": "support_state"}),
        labelled(verifications, "verification_total", {"verdict": "verdict", "type": "verifier_type"}),
        pages("ocr_pages_total", evidence.where(F.col("source_method").isin("OCR", "MIXED_NATIVE_OCR"))),
        pages("ocr_low_confidence_total", evidence.where(F.col("ocr_confidence") < LOW_OCR)),
        *summary("task_duration_seconds", tasks, F.col("duration_s"), {"type": "task_type"}),
        *summary("provider_latency_seconds", model_calls, F.col("latency_ms") / 1000.0, provider),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- providers -----------------------------------------------------------------------


def provider_observations(events: DataFrame, now: str) -> DataFrame:
    """Health of each provider as of ``now`` from its events.

    ``events``: event_id, provider, kind, occurred, status, success, latency_ms,
    canary_state, circuit_breaker_state.
    """
    at = F.lit(now).cast("timestamp")
    kind = F.col("kind")

    def newest(column: str, of: str) -> Column:
        return F.max_by(
            F.when(kind == of, F.col(column)), F.when(kind == of, F.struct("occurred", "event_id"))
        )

    def age(column: str) -> Column:
        return seconds_between(at, F.col(column))

    grouped = events.groupBy("provider").agg(
        F.count_if(kind == "attempt").alias("attempts"),
        F.count_if((kind == "attempt") & ~F.col("status").eqNullSafe("OK")).alias("errors"),
        F.count_if(kind == "schema").alias("schemas"),
        F.count_if((kind == "schema") & F.col("success")).alias("schema_ok"),
        F.count_if(kind == "citation").alias("citations"),
        F.count_if((kind == "citation") & F.col("success")).alias("citation_ok"),
        F.count_if(kind == "unsupported").alias("unsupported"),
        F.max(F.when(kind == "attempt", F.col("occurred"))).alias("last_attempt"),
        F.max(F.when(kind == "canary", F.col("occurred"))).alias("last_canary"),
        F.max(F.when(kind == "breaker", F.col("occurred"))).alias("last_breaker"),
        newest("canary_state", "canary").alias("canary"),
        newest("circuit_breaker_state", "breaker").alias("breaker"),
    )
    n = F.col("n")
    quantiles = keyed.order_statistics(
        events.where(kind == "latency"),
        ["provider"],
        "latency_ms",
        {
            "latency_p50": F.floor((n - 1) / 2) + 1,
            "latency_p90": F.least(n - 1, F.floor(n * 0.9)) + 1,
        },
        F.floor("latency_ms"),
    )

    def rate(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))

    canary = (
        F.when(age("last_canary") > CANARY_SECONDS, "STALE").otherwise(F.coalesce("canary", F.lit("UNKNOWN")))
    )
    breaker = F.when(
        F.col("last_breaker").isNull() | (age("last_breaker") > STALE_SECONDS), "UNKNOWN"
    ).otherwise(F.coalesce("breaker", F.lit("UNKNOWN")))
    out = grouped.withColumn("canary_state", canary).withColumn("circuit_breaker_state", breaker)
    availability = (
        F.when(F.col("circuit_breaker_state") == "OPEN", "UNAVAILABLE")
        .when(F.col("canary_state").isin("FAILED", "STALE") | (F.col("circuit_breaker_state") == "HALF_OPEN"), "DEGRADED")
        .when((F.col("attempts") > 0) & (age("last_attempt") > STALE_SECONDS), "UNKNOWN")
        .when((F.col("attempts") > 0) & (F.col("errors") / F.col("attempts") > 0.2), "DEGRADED")
        .when(F.col("attempts") > 0, "HEALTHY")
        .otherwise("UNKNOWN")
    )
    return out.join(quantiles, "provider", "left").select(
        "provider",
        availability.alias("availability_state"),
        "canary_state",
        "circuit_breaker_state",
        F.col("attempts").alias("total_calls"),
        rate("errors", "attempts").alias("transport_error_rate"),
        rate("schema_ok", "schemas").alias("schema_pass_rate"),
        rate("citation_ok", "citations").alias("citation_pass_rate"),
        F.least(F.lit(1.0), rate("unsupported", "schemas")).alias("unsupported_claim_rate"),
        "latency_p50",
        "latency_p90",
    )


def provider_counters(events: DataFrame) -> DataFrame:
    """Counters per provider and model, with latency count and sum in seconds."""
    kind = F.col("kind")
    attempt = kind == "attempt"
    return events.groupBy("provider", F.coalesce("model", F.lit("unknown")).alias("model")).agg(
        F.count_if(attempt).alias("requests"),
        F.count_if(attempt & (F.col("status") == "OK")).alias("requests_ok"),
        F.count_if(attempt & F.col("status").isin(*RATE_LIMIT_CODES)).alias("rate_limited"),
        F.count_if((kind == "schema") & ~F.coalesce("success", F.lit(False))).alias("schema_failures"),
        F.count_if(kind == "ocr").alias("ocr_pages"),
        F.count_if((kind == "ocr") & (F.col("latency_ms").isNull() | (F.col("latency_ms") < LOW_OCR))).alias(
            "ocr_low_confidence"
        ),
        F.count_if(kind == "latency").alias("latency_count"),
        F.round(F.sum(F.when(kind == "latency", F.col("latency_ms"))) / 1000.0, 6).alias("latency_seconds"),
    )


def storage_by_class(inventory: DataFrame) -> DataFrame:
    """Bytes per retention class; unknown directories are unattributed."""
    pairs = [F.lit(v) for pair in STORAGE_CLASSES.items() for v in pair]
    known = F.element_at(F.create_map(*pairs), F.col("storage_class"))
    return inventory.groupBy(F.coalesce(known, F.lit("unattributed")).alias("retention_class")).agg(
        F.sum("size_bytes").alias("bytes"), F.count("*").alias("files")
    )


# ---- jobs ---------------------------------------------------------------------------


def eta(tasks: DataFrame, now: str, peers: int = 100, minimum: int = 5) -> DataFrame:
    """Remaining seconds per job from the latest successful peers of each open task.

    ``tasks``: job_id, task_id, task_type, state, started_at, finished_at. Null when a
    type lacks history or a task is blocked; jobs without open work have zero left.
    """
    at = F.lit(now).cast("timestamp")
    history = tasks.where(
        F.col("state").isin(*SUCCESS) & F.col("started_at").isNotNull() & F.col("finished_at").isNotNull()
    ).select(
        "task_type",
        F.struct(
            (-micros(F.col("finished_at"))).alias("o"),
            "task_id",
            seconds_between(F.col("finished_at"), F.col("started_at")).alias("d"),
        ).alias("item"),
    )
    recent = keyed.top_k_items(history, ["task_type"], "item", peers)
    durations = F.array_sort(F.filter(F.transform("items", lambda i: i["d"]), lambda d: d >= 0))
    n = F.size("durations")
    known = (
        recent.withColumn("durations", durations)
        .where(n >= minimum)
        .select(
            "task_type",
            F.element_at("durations", F.ceil(n * 0.5).cast("int")).alias("p50"),
            F.element_at("durations", F.ceil(n * 0.9).cast("int")).alias("p90"),
        )
    )
    open_task = ~F.col("state").isin(*tables.TERMINAL_STATES)
    elapsed = F.when(
        (F.col("state") == "RUNNING") & F.col("started_at").isNotNull(),
        F.greatest(F.lit(0.0), seconds_between(at, F.col("started_at"))),
    ).otherwise(0.0)
    joined = tasks.join(known, "task_type", "left").withColumn("open", open_task)
    unknown = F.bool_or(F.col("open") & (F.col("p50").isNull() | (F.col("state") == "BLOCKED")))

    def left(q: str) -> Column:
        return F.coalesce(
            F.sum(F.when(F.col("open"), F.greatest(F.lit(0.0), F.col(q) - elapsed))), F.lit(0.0)
        )

    return joined.groupBy("job_id").agg(
        F.count_if("open").alias("open_tasks"),
        F.when(~unknown, F.round(left("p50"), 6)).alias("eta_p50"),
        F.when(~unknown, F.round(left("p90"), 6)).alias("eta_p90"),
    )


def job_progress(tasks: DataFrame) -> DataFrame:
    """Tasks per job and state, with the job total and whether all are terminal."""
    states = sorted({*tables.TASK_TRANSITIONS, *tables.TERMINAL_STATES})
    return tasks.groupBy("job_id").agg(
        F.count("*").alias("tasks_total"),
        F.bool_and(F.col("state").isin(*tables.TERMINAL_STATES)).alias("terminal"),
        *[F.count_if(F.col("state") == s).alias(s.lower()) for s in states],
    )


def job_state(tasks: DataFrame) -> DataFrame:
    """State of each job from the newest task of every type."""
    newest = keyed.latest_by(
        tasks.select("job_id", "task_type", "created_at", "task_id", "state", "quality_state"),
        ["job_id", "task_type"],
        ["created_at", "task_id"],
    )
    state = F.col("state")
    facts = newest.groupBy("job_id").agg(
        F.bool_or(state == "FAILED").alias("failed"),
        F.bool_and(state.isin(*tables.TERMINAL_STATES)).alias("finished"),
        F.bool_or(
            state.isin("SKIPPED", "SUCCEEDED_WITH_WARNINGS") | (F.col("quality_state") == "DEGRADED")
        ).alias("warned"),
    )
    return facts.select(
        "job_id",
        F.when(F.col("failed"), "FAILED")
        .when(F.col("finished") & F.col("warned"), "SUCCEEDED_WITH_WARNINGS")
        .when(F.col("finished"), "SUCCEEDED")
        .otherwise("RUNNING")
        .alias("state"),
    )


def job_stages(tasks: DataFrame) -> DataFrame:
    """Most urgent state and quality of each (job, stage)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATE_PRIORITY]), F.col("state"))
    quality = F.col("quality_state")
    return tasks.groupBy("job_id", "stage").agg(
        F.min_by("state", rank).alias("state"),
        F.when(F.bool_or(quality == "DEGRADED"), "DEGRADED")
        .when(F.bool_and(quality == "GOOD"), "GOOD")
        .otherwise("UNKNOWN")
        .alias("quality"),
        F.count("*").alias("subtasks"),
    )


MAX_JOBS = 200


def job_list(jobs: DataFrame, state: str | None = None, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= MAX_JOBS:
        raise ValueError(f"a job list has 1 to {MAX_JOBS} rows")
    out = jobs if state is None else jobs.where(F.col("state") == state)
    return out.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)


def ready_queue(tasks: DataFrame, jobs: DataFrame, now: str, limit: int = 100) -> DataFrame:
    """Tasks that may start: the first open one of each live job, if queued and due.

    Deep-tier jobs come first, then higher priority, then older tasks.
    """
    at = F.lit(now).cast("timestamp")
    live = jobs.where(~F.col("state").isin("CANCELLED", "FAILED")).select("job_id", "tier", "priority")
    open_tasks = tasks.where(~F.col("state").isin(*tables.TERMINAL_STATES)).select(
        "job_id", "stage_no", "created_at", "task_id", "state", "next_retry_at"
    )
    first = keyed.earliest_by(
        open_tasks.join(live.select("job_id"), "job_id", "left_semi"),
        ["job_id"],
        ["stage_no", "created_at", "task_id"],
    )
    due = first.where(
        (F.col("state") == "QUEUED")
        & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= at))
    )
    return (
        due.join(live, "job_id")
        .orderBy(F.col("tier") != "T3_DEEP", F.col("priority").desc(), "created_at", "task_id")
        .limit(limit)
        .select("task_id", "job_id", "tier", "priority")
    )


def retry_backlog(failures: DataFrame) -> DataFrame:
    """Next state and delay of failed attempts: doubling, at most 300 seconds."""
    again = F.col("attempt") < F.col("max_attempts")
    steps = F.least(F.greatest(F.col("attempt") - 1, F.lit(0)), F.lit(9))
    delay = F.least(F.lit(300.0), F.pow(F.lit(2.0), steps)).cast("int")
    return failures.withColumn("next_state", F.when(again, "QUEUED").otherwise("FAILED")).withColumn(
        "delay_seconds", F.when(again, delay)
    )


def legal_step(before: Column, after: Column) -> Column:
    ok = F.lit(False)
    for state, targets in tables.TASK_TRANSITIONS.items():
        ok = ok | ((before == state) & after.isin(*targets))
    return ok


def transition_audit(events: DataFrame) -> DataFrame:
    """State changes (task_id, occurred, event_id, state) that the rules do not allow."""
    steps = keyed.previous_in_key(
        events, ["task_id"], ["occurred", "event_id"], None, "state", "before"
    )
    return steps.where(
        F.col("before").isNotNull() & ~legal_step(F.col("before"), F.col("state"))
    ).select("task_id", "event_id", "before", F.col("state").alias("after"))


def stage_regressions(events: DataFrame) -> DataFrame:
    """Stage events (job_id, occurred, event_id, stage_no) below a stage already reached."""
    seen = keyed.running_max_before(
        events, ["job_id"], ["occurred", "event_id"], None, "stage_no", "reached"
    )
    return seen.where(F.col("stage_no") < F.col("reached")).select(
        "job_id", "event_id", "stage_no", "reached"
    )


def stage_coverage(versions: DataFrame, rows: dict[str, DataFrame], runs: DataFrame, required: DataFrame) -> DataFrame:
    """(version, stage, done) grid from the presence of each stage's rows.

    ``rows``: stage to a frame with paper_version_id; ``runs``: paper_version_id,
    agent_type, status; ``required``: tier, agent_type. ``versions`` carries tier.
    """
    base = versions.select("paper_version_id", "tier").distinct()
    out = None
    for stage, df in rows.items():
        have = df.select("paper_version_id").distinct().withColumn("found", F.lit(True))
        part = base.join(have, "paper_version_id", "left").select(
            "paper_version_id", F.lit(stage).alias("stage"), F.col("found").isNotNull().alias("done")
        )
        out = part if out is None else out.unionByName(part)
    good = runs.where(F.col("status").isin(*SUCCESS)).select("paper_version_id", "agent_type").distinct()
    wanted = required.groupBy("tier").agg(F.count("*").alias("wanted"))
    ran = (
        base.join(good, "paper_version_id")
        .join(required, ["tier", "agent_type"])
        .groupBy("paper_version_id")
        .agg(F.count("*").alias("ran"))
    )
    analyzed = (
        base.join(wanted, "tier", "left")
        .join(ran, "paper_version_id", "left")
        .select(
            "paper_version_id",
            F.lit("ANALYZED").alias("stage"),
            F.coalesce((F.col("wanted") > 0) & (F.col("ran") == F.col("wanted")), F.lit(False)).alias("done"),
        )
    )
    return analyzed if out is None else out.unionByName(analyzed)


# ---- traces ---------------------------------------------------------------------------

TIMELINE = ["trace_id", "occurred_at", "event_id", "kind", "ref_id", "message"]


def trace_rows(events: DataFrame, runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Trace events, agent runs and model calls as one row shape."""
    none = F.lit(None).cast("string")
    return (
        events.select("trace_id", "occurred_at", "event_id", "kind", none.alias("ref_id"), "message")
        .unionByName(
            runs.select(
                "trace_id", F.col("started_at").alias("occurred_at"), F.lit(0).cast("long").alias("event_id"),
                F.lit("agent.run").alias("kind"), F.col("run_id").cast("string").alias("ref_id"),
                F.col("agent_type").alias("message"),
            )
        )
        .unionByName(
            calls.select(
                "trace_id", F.col("created_at").alias("occurred_at"), F.lit(0).cast("long").alias("event_id"),
                F.lit("model.call").alias("kind"), F.col("model_call_id").cast("string").alias("ref_id"),
                F.lit("model call").alias("message"),
            )
        )
    )


def trace_timeline(events: DataFrame, runs: DataFrame, calls: DataFrame, limit: int = 1000) -> DataFrame:
    """First ``limit`` rows of every trace in time order, and whether the trace has more.

    A report, cut for display; ``trace_rows`` has all rows.
    """
    rows = trace_rows(events, runs, calls)
    item = F.struct("occurred_at", "event_id", "kind", "ref_id", "message").alias("item")
    top = keyed.top_k_items(rows.select("trace_id", item), ["trace_id"], "item", limit)
    sizes = rows.groupBy("trace_id").agg((F.count("*") > limit).alias("truncated"))
    return (
        top.select("trace_id", F.posexplode("items").alias("position", "item"))
        .join(sizes, "trace_id")
        .select("trace_id", "position", "item.*", "truncated")
    )


def debug_rows(timeline: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Bundle rows with secrets removed: the timeline and, for jobs, the tasks."""
    out = timeline.select(
        "trace_id", F.lit("event").alias("part"), X.redact(F.concat_ws(" ", "kind", "ref_id", "message")).alias("item")
    )
    if tasks is not None:
        extra = tasks.select(
            "trace_id", F.lit("task").alias("part"), X.redact(F.concat_ws(" ", "task_id", "task_type", "state", "error")).alias("item")
        )
        out = out.unionByName(extra)
    return out


# ---- retention -------------------------------------------------------------------------


def gc_candidates(
    inventory: DataFrame,
    assets: DataFrame,
    references: DataFrame,
    now: str,
    temp_hours: int = 24,
    debug_days: int = 14,
) -> DataFrame:
    """What retention would reclaim and what it protects, with reasons (a dry run).

    ``inventory``: storage_key, storage_class, size_bytes, modified_at; ``assets``:
    asset_id, storage_key, retention_class, size_bytes; ``references``: asset_id.
    """
    at = F.lit(now).cast("timestamp")
    age = seconds_between(at, F.col("modified_at"))
    kind = F.element_at(
        F.create_map(*[F.lit(v) for pair in STORAGE_CLASSES.items() for v in pair]), F.col("storage_class")
    )
    report = F.col("storage_key").rlike("(^|/)extraction_reports/")
    files = (
        inventory.withColumn("retention_class", kind)
        .where(F.col("retention_class").isin("TEMP", "DEBUG_TTL", "CACHE"))
        .withColumn(
            "reason",
            F.when((F.col("retention_class") == "TEMP") & (age >= temp_hours * 3600), "temporary file expired")
            .when((F.col("retention_class") == "DEBUG_TTL") & (age >= debug_days * 86400), "debug artifact expired")
            .when((F.col("retention_class") == "CACHE") & report, "extraction report required for replay")
            .when(F.col("retention_class") == "CACHE", "regenerable cache entry"),
        )
        .where("reason IS NOT NULL")
        .select(
            F.col("storage_key").alias("object"), "retention_class", "size_bytes", "reason",
            ((F.col("retention_class") == "CACHE") & report).alias("protected"),
        )
    )
    stored = inventory.select(
        F.regexp_replace("storage_key", "^objects/", "").alias("storage_key"),
        F.col("size_bytes").alias("stored_bytes"),
    ).dropDuplicates(["storage_key"])
    used = references.select("asset_id").distinct().withColumn("used", F.lit(True))
    keep = F.col("retention_class") == "KEEP"
    rows = (
        assets.join(stored, "storage_key", "left")
        .join(used, "asset_id", "left")
        .withColumn(
            "reason",
            F.when(keep & F.col("used").isNotNull(), "referenced by active records")
            .when(keep, "no current reference: operator decision")
            .when(F.col("stored_bytes").isNull(), "asset row without stored object")
            .when(F.col("retention_class").isin("TEMP", "DEBUG_TTL"), "asset is not canonical"),
        )
        .where("reason IS NOT NULL")
        .select(
            F.col("storage_key").alias("object"), "retention_class",
            F.coalesce("stored_bytes", "size_bytes").alias("size_bytes"), "reason", keep.alias("protected"),
        )
    )
    return files.unionByName(rows)


def gc_totals(candidates: DataFrame) -> DataFrame:
    """Dry-run totals and a scope hash that expires after fifteen minutes."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", "object", "size_bytes"), 256), 1, 12), 16, 10)
    return candidates.agg(
        F.count_if(~F.col("protected")).alias("candidates"),
        F.count_if("protected").alias("protected"),
        F.coalesce(F.sum(F.when(~F.col("protected"), F.col("size_bytes"))), F.lit(0)).alias("reclaimable_bytes"),
        F.sum(F.when(~F.col("protected"), digest.cast("decimal(38,0)"))).alias("_sum"),
    ).select(
        "candidates", "protected", "reclaimable_bytes",
        X.short_hash(F.col("candidates").cast("string"), F.col("_sum").cast("string")).alias("scope_hash"),
        F.expr("current_timestamp() + interval 15 minutes").alias("expires_at"),
    )
