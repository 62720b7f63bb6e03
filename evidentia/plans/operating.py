"""Queries over operational analytics, bundles and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia import tables as C
from evidentia.operators import ops as O
from evidentia.operators import search as S
from evidentia.plans import duck
from evidentia.plans.registry import query
from evidentia.sources import writers as W

NOW = "2024-01-31 00:00:00"
TERMINAL = duck.in_list(C.TERMINAL_STATES)


@query("a11_corpus_totals", """
SELECT 'papers' AS name, count(*) AS total FROM papers UNION ALL SELECT 'claims', count(*) FROM claims UNION ALL SELECT 'claims_supported', count(*) FROM claims WHERE support_state = 'SUPPORTED'
UNION ALL SELECT 'evidence', count(*) FROM evidence UNION ALL SELECT 'model_calls', count(*) FROM model_calls""")
def a11(t):
    return O.corpus_totals(
        {
            "papers": t.papers,
            "claims": t.claims,
            "claims_supported": t.claims.where("support_state = 'SUPPORTED'"),
            "evidence": t.evidence,
            "model_calls": t.model_calls,
        }
    )


@query("a11_queue_counts", """
SELECT count(*) FILTER (WHERE state IN ('PENDING', 'QUEUED', 'WAITING')) AS pending, count(*) FILTER (WHERE state IN ('RUNNING', 'RETRYING')) AS running, count(*) FILTER (WHERE state = 'FAILED') AS failed FROM tasks""")
def a11_queue(t):
    return O.queue_counts(t.tasks)


@query("a11_tasks_by_type", "SELECT task_type, state, count(*) AS tasks FROM tasks GROUP BY 1, 2")
def a11_types(t):
    return O.tasks_by_type(t.tasks)


JOBS = """jobs AS MATERIALIZED (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'RUNNING' ELSE 'QUEUED' END AS state,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'T3_DEEP' ELSE 'T1_SCAN' END AS tier, o_totalprice AS priority, o_orderdate AS created_at FROM orders)"""


def jobs(t):
    return t.orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'RUNNING' ELSE 'QUEUED' END").alias("state"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'T3_DEEP' ELSE 'T1_SCAN' END").alias("tier"),
        F.col("o_totalprice").alias("priority"),
        F.col("o_orderdate").alias("created_at"),
    )


def lines_sql(name, source, labels, value="count(*)", where=""):
    pairs = " || ',' || ".join(f"'{k}=\"' || cast({v} AS varchar) || '\"'" for k, v in sorted(labels.items())) or "''"
    group = " GROUP BY " + ", ".join(labels.values()) if labels else ""
    return f"SELECT '{name}' AS metric, {pairs} AS labels, cast({value} AS double) AS value FROM {source} {where}{group}"


PM = {"provider": "provider_id", "model": "model_id"}
METRICS = " UNION ALL ".join(
    [
        lines_sql("jobs_total", "jobs", {}),
        lines_sql("jobs_active", "jobs", {}, where="WHERE state IN ('RUNNING', 'QUEUED')"),
        lines_sql("jobs_failed_total", "jobs", {}, where="WHERE state = 'FAILED'"),
        lines_sql("tasks_total", "tasks", {"type": "task_type", "state": "state"}),
        lines_sql("provider_requests_total", "model_calls", {**PM, "status": "transport_status"}),
        lines_sql("provider_rate_limit_total", "model_calls", {}, where="WHERE transport_status = 'RATE_LIMITED'"),
        lines_sql("provider_schema_fail_total", "model_calls", {}, where="WHERE schema_status = 'JSON_INVALID'"),
        lines_sql("evidence_created_total", "evidence", {"type": "evidence_type"}),
        lines_sql("claims_created_total", "claims", {"type": "claim_type"}),
        lines_sql("claims_status_total", "claims", {"support_state": "support_state"}),
        lines_sql("verification_total", "verifications", {"verdict": "verdict", "type": "verifier_type"}),
        lines_sql("ocr_pages_total", "(SELECT DISTINCT paper_version_id, page_start FROM evidence WHERE source_method = 'OCR') q", {}),
        lines_sql("ocr_low_confidence_total", "(SELECT DISTINCT paper_version_id, page_start FROM evidence WHERE ocr_confidence < 0.8) q", {}),
        lines_sql("task_duration_seconds_count", "tasks", {"type": "task_type"}),
        lines_sql("task_duration_seconds_sum", "tasks", {"type": "task_type"}, "round(sum(duration_s), 6)"),
        lines_sql("provider_latency_seconds_count", "model_calls", PM),
        lines_sql("provider_latency_seconds_sum", "model_calls", PM, "round(sum(latency_ms / 1000.0), 6)"),
    ]
)


def metrics(t):
    return O.ops_metrics(jobs(t), t.tasks, t.model_calls, t.evidence, t.claims, t.verifications)


@query("a12_ops_metrics", f"WITH {JOBS} SELECT metric, labels, value FROM ({METRICS}) q")
def a12(t):
    pairs = F.transform(
        F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))
    )
    return metrics(t).select("metric", F.array_join(pairs, ",").alias("labels"), "value")


@query("s10_metric_lines", f"""WITH {JOBS} SELECT metric || CASE WHEN labels = '' THEN '' ELSE '{{' || labels || '}}' END || ' ' || cast(cast(value AS bigint) AS varchar) AS line FROM ({METRICS}) q WHERE metric NOT LIKE '%_sum'""")
def s10(t):
    rows = metrics(t).where("metric NOT LIKE '%_sum'")
    return rows.select(
        W.metric_line(F.col("metric"), F.col("labels"), F.col("value").cast("long")).alias("line")
    )


@query("a13_provider_observations", f"""
WITH g AS (SELECT provider, count(*) FILTER (WHERE kind = 'attempt') AS a, count(*) FILTER (WHERE kind = 'attempt' AND status <> 'OK') AS e, count(*) FILTER (WHERE kind = 'schema') AS s,
  count(*) FILTER (WHERE kind = 'schema' AND success) AS so, count(*) FILTER (WHERE kind = 'citation') AS c, count(*) FILTER (WHERE kind = 'citation' AND success) AS co,
  count(*) FILTER (WHERE kind = 'unsupported') AS u, max(occurred) FILTER (WHERE kind = 'attempt') AS la, max(occurred) FILTER (WHERE kind = 'canary') AS lc, max(occurred) FILTER (WHERE kind = 'breaker') AS lb,
  arg_max(canary_state, (occurred, event_id)) FILTER (WHERE kind = 'canary') AS can, arg_max(circuit_breaker_state, (occurred, event_id)) FILTER (WHERE kind = 'breaker') AS br,
  list_sort(list(latency_ms) FILTER (WHERE kind = 'latency')) AS lat FROM provider_events GROUP BY 1),
h AS (SELECT *, CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(lc) > 86400000000 THEN 'STALE' ELSE coalesce(can, 'UNKNOWN') END AS canary_state,
  CASE WHEN lb IS NULL OR epoch_us(TIMESTAMP '{NOW}') - epoch_us(lb) > 300000000 THEN 'UNKNOWN' ELSE br END AS circuit_breaker_state FROM g)
SELECT provider, CASE WHEN circuit_breaker_state = 'OPEN' THEN 'UNAVAILABLE' WHEN canary_state IN ('FAILED', 'STALE') OR circuit_breaker_state = 'HALF_OPEN' THEN 'DEGRADED'
  WHEN a > 0 AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(la) > 300000000 THEN 'UNKNOWN' WHEN a > 0 AND e / a > 0.2 THEN 'DEGRADED' WHEN a > 0 THEN 'HEALTHY' ELSE 'UNKNOWN' END AS availability_state,
  canary_state, circuit_breaker_state, a AS total_calls, e / nullif(a, 0) AS transport_error_rate, so / nullif(s, 0) AS schema_pass_rate, co / nullif(c, 0) AS citation_pass_rate,
  least(1.0, u / nullif(s, 0)) AS unsupported_claim_rate, lat[(len(lat) - 1) // 2 + 1] AS latency_p50, lat[least(len(lat) - 1, cast(floor(len(lat) * 0.9) AS bigint)) + 1] AS latency_p90 FROM h""")
def a13(t):
    return O.provider_observations(t.provider_events, NOW)


@query("a14_provider_counters", """
SELECT provider, model, count(*) FILTER (WHERE kind = 'attempt') AS requests, count(*) FILTER (WHERE kind = 'attempt' AND status = 'OK') AS requests_ok,
  count(*) FILTER (WHERE kind = 'attempt' AND status IN ('LLM_002', 'PROVIDER_002')) AS rate_limited, count(*) FILTER (WHERE kind = 'schema' AND NOT success) AS schema_failures,
  count(*) FILTER (WHERE kind = 'latency') AS latency_count, round(sum(latency_ms) FILTER (WHERE kind = 'latency') / 1000.0, 6) AS latency_seconds FROM provider_events GROUP BY 1, 2""")
def a14(t):
    return O.provider_counters(t.provider_events).drop("ocr_pages", "ocr_low_confidence")


CLASS = "CASE lang WHEN 'en' THEN 'objects' WHEN 'de' THEN 'temp' WHEN 'fr' THEN 'cache' ELSE 'other' END"


def inventory(t):
    return t.documents.select(
        F.concat(F.expr(CLASS), F.when(F.col("source") == "src5", "/extraction_reports/").otherwise("/"), F.col("doc_id")).alias("storage_key"),
        F.expr(CLASS).alias("storage_class"),
        F.col("n_chars").alias("size_bytes"),
        F.expr("timestamp '2024-01-30 20:00:00' - make_interval(0, 0, 0, 0, cast(doc_id % 50 AS int))").alias("modified_at"),
    )


@query("a15_storage_by_class", f"""
SELECT CASE {CLASS} WHEN 'objects' THEN 'KEEP' WHEN 'temp' THEN 'TEMP' WHEN 'cache' THEN 'CACHE' ELSE 'unattributed' END AS retention_class, cast(sum(n_chars) AS bigint) AS bytes, count(*) AS files FROM documents GROUP BY 1""")
def a15(t):
    return O.storage_by_class(inventory(t))


@query("k1_gc_candidates", f"""
WITH inv AS (SELECT concat({CLASS}, CASE WHEN source = 'src5' THEN '/extraction_reports/' ELSE '/' END, doc_id) AS k, {CLASS} AS c, n_chars, 4 + doc_id % 50 AS age, source FROM documents),
a AS (SELECT concat('ast_', doc_id) AS asset_id, concat({"CASE WHEN source = 'src5' THEN 'extraction_reports/' ELSE '' END"}, doc_id) AS k, n_chars + 1 AS n, CASE source WHEN 'src1' THEN 'TEMP' WHEN 'src2' THEN 'DEBUG_TTL' ELSE 'KEEP' END AS rc, lang, doc_id FROM documents)
SELECT k AS object, CASE c WHEN 'temp' THEN 'TEMP' ELSE 'CACHE' END AS retention_class, n_chars AS size_bytes, CASE WHEN c = 'temp' THEN 'temporary file expired' WHEN source = 'src5' THEN 'extraction report required for replay'
  ELSE 'regenerable cache entry' END AS reason, c = 'cache' AND source = 'src5' AS protected FROM inv WHERE (c = 'temp' AND age >= 24) OR c = 'cache'
UNION ALL SELECT k, rc, CASE WHEN lang = 'en' THEN n - 1 ELSE n END, CASE WHEN rc = 'KEEP' AND l.doc_id IS NOT NULL THEN 'referenced by active records' WHEN rc = 'KEEP' THEN 'no current reference: operator decision'
  WHEN lang <> 'en' THEN 'asset row without stored object' ELSE 'asset is not canonical' END, rc = 'KEEP' FROM a LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = a.doc_id""")
def k1(t):
    assets = t.documents.select(
        F.concat(F.lit("ast_"), "doc_id").alias("asset_id"),
        F.concat(F.when(F.col("source") == "src5", "extraction_reports/").otherwise(""), F.col("doc_id")).alias("storage_key"),
        (F.col("n_chars") + 1).alias("size_bytes"),
        F.expr("CASE source WHEN 'src1' THEN 'TEMP' WHEN 'src2' THEN 'DEBUG_TTL' ELSE 'KEEP' END").alias("retention_class"),
    )
    references = t.labels.select(F.concat(F.lit("ast_"), "doc_id").alias("asset_id"))
    return O.gc_candidates(inventory(t), assets, references, NOW)


# ---- tasks and jobs ----------------------------------------------------------------


def timed(t):
    """Tasks with start and finish times and quality."""
    return t.tasks.select(
        "*",
        F.col("created_at").alias("started_at"),
        F.expr("created_at + make_interval(0, 0, 0, 0, 0, 0, duration_s)").alias("finished_at"),
        F.expr("CASE WHEN attempt = 1 THEN 'GOOD' WHEN attempt = 4 THEN 'DEGRADED' ELSE 'UNKNOWN' END").alias("quality_state"),
        F.col("stage_no").alias("stage"),
        F.expr("CASE WHEN attempt = 3 THEN timestamp '2030-01-01' END").alias("next_retry_at"),
    )


@query("a16_eta", f"""
WITH r AS (SELECT task_type, duration_s AS d, row_number() OVER (PARTITION BY task_type ORDER BY epoch_us(created_at) + cast(duration_s AS bigint) * 1000000 DESC, task_id) AS rn FROM tasks WHERE state = 'SUCCEEDED'),
k AS (SELECT task_type, list_sort(list(d)) AS ds FROM r WHERE rn <= 100 GROUP BY 1 HAVING count(*) >= 5),
p AS (SELECT task_type, ds[cast(ceil(len(ds) * 0.5) AS bigint)] AS p50, ds[cast(ceil(len(ds) * 0.9) AS bigint)] AS p90 FROM k),
j AS (SELECT t.*, p50, p90, state NOT IN ({TERMINAL}) AS open, CASE WHEN state = 'RUNNING' THEN greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 1000000.0) ELSE 0 END AS el FROM tasks t LEFT JOIN p ON t.task_type = p.task_type)
SELECT job_id, count(*) FILTER (WHERE open) AS open_tasks, CASE WHEN NOT bool_or(open AND (p50 IS NULL OR state = 'BLOCKED')) THEN round(coalesce(sum(greatest(0, p50 - el)) FILTER (WHERE open), 0), 6)::double END AS eta_p50,
  CASE WHEN NOT bool_or(open AND (p50 IS NULL OR state = 'BLOCKED')) THEN round(coalesce(sum(greatest(0, p90 - el)) FILTER (WHERE open), 0), 6)::double END AS eta_p90 FROM j GROUP BY 1""")
def a16(t):
    return O.eta(timed(t), NOW)


@query("a17_job_progress", f"""
SELECT job_id, count(*) AS tasks_total, bool_and(state IN ({TERMINAL})) AS terminal, count(*) FILTER (WHERE state = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE state = 'FAILED') AS failed,
  count(*) FILTER (WHERE state = 'QUEUED') AS queued FROM tasks GROUP BY 1""")
def a17(t):
    return O.job_progress(t.tasks).select("job_id", "tasks_total", "terminal", "succeeded", "failed", "queued")


@query("a18_job_state", f"""
WITH n AS (SELECT job_id, task_type, arg_max(state, (created_at, task_id)) AS state, arg_max(attempt, (created_at, task_id)) AS attempt FROM tasks GROUP BY 1, 2)
SELECT job_id, CASE WHEN bool_or(state = 'FAILED') THEN 'FAILED' WHEN bool_and(state IN ({TERMINAL})) THEN CASE WHEN bool_or(attempt = 4) THEN 'SUCCEEDED_WITH_WARNINGS' ELSE 'SUCCEEDED' END ELSE 'RUNNING' END AS state FROM n GROUP BY 1""")
def a18(t):
    return O.job_state(timed(t))


PRIORITY = "CASE state " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(O.STATE_PRIORITY)) + " END"


@query("a19_job_stages", f"""
SELECT job_id, stage_no AS stage, arg_min(state, {PRIORITY}) AS state, CASE WHEN bool_or(attempt = 4) THEN 'DEGRADED' WHEN bool_and(attempt = 1) THEN 'GOOD' ELSE 'UNKNOWN' END AS quality, count(*) AS subtasks FROM tasks GROUP BY 1, 2""")
def a19(t):
    return O.job_stages(timed(t))


@query("t4_job_list", f"WITH {JOBS} SELECT job_id, created_at FROM jobs WHERE state = 'RUNNING' ORDER BY created_at DESC, job_id DESC LIMIT 200")
def t4(t):
    return O.job_list(jobs(t), "RUNNING", O.MAX_JOBS).select("job_id", "created_at")


@query("w4_ready_queue", f"""
WITH {JOBS}, f AS (SELECT t.job_id, arg_min(task_id, (stage_no, t.created_at, task_id)) AS task_id, arg_min(t.state, (stage_no, t.created_at, task_id)) AS state, arg_min(attempt, (stage_no, t.created_at, task_id)) AS attempt,
  arg_min(t.created_at, (stage_no, t.created_at, task_id)) AS created_at FROM tasks t JOIN jobs j ON j.job_id = t.job_id AND j.state NOT IN ('CANCELLED', 'FAILED') WHERE t.state NOT IN ({TERMINAL}) GROUP BY 1)
SELECT task_id, f.job_id, tier, priority FROM f JOIN jobs j ON j.job_id = f.job_id WHERE f.state = 'QUEUED' AND attempt <> 3 ORDER BY tier <> 'T3_DEEP', priority DESC, f.created_at, task_id LIMIT 100""")
def w4(t):
    return O.ready_queue(timed(t).drop("priority"), jobs(t), NOW)


@query("w5_retry_backlog", """
SELECT task_id, CASE WHEN attempt < 3 THEN 'QUEUED' ELSE 'FAILED' END AS next_state, CASE WHEN attempt < 3 THEN cast(least(300, power(2, least(attempt - 1, 9))) AS integer) END AS delay_seconds FROM tasks WHERE state = 'FAILED'""")
def w5(t):
    failed = t.tasks.where("state = 'FAILED'").withColumn("max_attempts", F.lit(3))
    return O.retry_backlog(failed).select("task_id", "next_state", "delay_seconds")


STEPS = " OR ".join(f"(before = '{s}' AND state IN ({duck.in_list(v)}))" for s, v in C.TASK_TRANSITIONS.items())


@query("w6_transition_audit", f"""
WITH s AS (SELECT job_id AS task_id, task_id AS event_id, state, lag(state) OVER (PARTITION BY job_id ORDER BY created_at, task_id) AS before FROM tasks)
SELECT task_id, event_id, before, state AS after FROM s WHERE before IS NOT NULL AND NOT ({STEPS})""")
def w6(t):
    events = t.tasks.select(
        F.col("job_id").alias("task_id"), F.col("task_id").alias("event_id"), F.col("created_at").alias("occurred"), "state"
    )
    return O.transition_audit(events)


@query("w7_stage_regressions", """
WITH s AS (SELECT job_id, task_id AS event_id, stage_no, max(stage_no) OVER (PARTITION BY job_id ORDER BY created_at, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM tasks)
SELECT job_id, event_id, stage_no, reached FROM s WHERE stage_no < reached""")
def w7(t):
    events = t.tasks.select("job_id", F.col("task_id").alias("event_id"), F.col("created_at").alias("occurred"), "stage_no")
    return O.stage_regressions(events)


TIERS = "CASE paper_id % 3 WHEN 0 THEN 'T1_SCAN' ELSE 'T2_FULL' END"


@query("a23_stage_coverage", f"""
WITH v AS (SELECT paper_version_id, {TIERS} AS tier FROM paper_versions),
req AS (SELECT 'T1_SCAN' AS tier, unnest(['agents.method', 'agents.result']) AS a UNION ALL SELECT 'T2_FULL', unnest(['agents.method', 'agents.result', 'agents.structural', 'agents.reliability'])),
ran AS (SELECT DISTINCT c.paper_version_id, agent_type FROM claims c JOIN runs r ON c.run_id = r.run_id WHERE support_state = 'SUPPORTED'),
k AS (SELECT v.paper_version_id, count(*) FILTER (WHERE ran.agent_type IS NOT NULL) = count(*) AS done FROM v JOIN req ON req.tier = v.tier LEFT JOIN ran ON ran.paper_version_id = v.paper_version_id AND ran.agent_type = req.a GROUP BY 1)
SELECT paper_version_id, 'ANALYZED' AS stage, done FROM k
UNION ALL SELECT paper_version_id, 'EVIDENCE_INDEXED', paper_version_id IN (SELECT paper_version_id FROM evidence WHERE source_method = 'OCR' AND section_class = 'RESULT') FROM v
UNION ALL SELECT paper_version_id, 'VERIFIED', paper_version_id IN (SELECT paper_version_id FROM claims WHERE category = 'research.gap' AND claim_type = 'CRITIQUE') FROM v""")
def a23(t):
    versions = t.paper_versions.select("paper_version_id", F.expr(TIERS).alias("tier"))
    agents = {
        "T1_SCAN": ["agents.method", "agents.result"],
        "T2_FULL": ["agents.method", "agents.result", "agents.structural", "agents.reliability"],
    }
    lists = F.explode(
        F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(a).alias("agent_type")) for k, v in agents.items() for a in v])
    ).alias("need")
    required = versions.select("tier").distinct().select(F.col("tier").alias("t"), lists).where("t = need.tier").select("need.*")
    runs = t.claims.where("support_state = 'SUPPORTED'").join(t.runs, "run_id").select(
        "paper_version_id", "agent_type", F.lit("SUCCEEDED").alias("status")
    )
    rows = {
        "EVIDENCE_INDEXED": t.evidence.where("source_method = 'OCR' AND section_class = 'RESULT'"),
        "VERIFIED": t.claims.where("category = 'research.gap' AND claim_type = 'CRITIQUE'"),
    }
    return O.stage_coverage(versions, rows, runs, required)


# ---- traces and bundles ----------------------------------------------------------------


def trace_inputs(t):
    events = t.conversations.select(
        (F.col("conv_id") % 7).alias("trace_id"), F.col("turn").alias("occurred_at"), F.col("conv_id").alias("event_id"),
        F.col("role").alias("kind"), F.col("text").alias("message"),
    )
    runs = t.runs.select(
        F.col("run_id").alias("trace_id"), F.lit(3).cast("long").alias("started_at"), "run_id", "agent_type"
    )
    calls = t.conversations.where("role = 'assistant'").select(
        (F.col("conv_id") % 7).alias("trace_id"), F.col("turn").alias("created_at"),
        F.concat_ws("_", "conv_id", "turn").alias("model_call_id"),
    )
    return events, runs, calls


TRACE = """tr AS MATERIALIZED (SELECT conv_id % 7 AS trace_id, turn AS occurred_at, conv_id AS event_id, role AS kind, NULL AS ref_id, text AS message FROM conversations
  UNION ALL SELECT run_id, 3, 0, 'agent.run', cast(run_id AS varchar), agent_type FROM runs
  UNION ALL SELECT conv_id % 7, turn, 0, 'model.call', concat(conv_id, '_', turn), 'model call' FROM conversations WHERE role = 'assistant'),
cut AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY occurred_at, event_id, kind, ref_id NULLS FIRST, message) - 1 AS position FROM tr)"""


@query("t2_trace_rows", f"WITH {TRACE} SELECT trace_id, occurred_at, event_id, kind, ref_id, message FROM cut")
def t2_rows(t):
    return O.trace_rows(*trace_inputs(t))


@query("t2_trace_timeline", f"""WITH {TRACE}, n AS (SELECT trace_id, count(*) > 1000 AS truncated FROM cut GROUP BY trace_id)
SELECT trace_id, position, occurred_at, event_id, kind, ref_id, message, truncated FROM cut JOIN n USING (trace_id) WHERE position < 1000""")
def t2(t):
    return O.trace_timeline(*trace_inputs(t)).withColumn("position", F.col("position").cast("long"))


_RED = "concat_ws(' ', kind, ref_id, message)"
for _p, _r in __import__("evidentia.functions.text", fromlist=["SECRETS"]).SECRETS:
    _RED = f"regexp_replace({_RED}, {duck.quote(_p)}, {duck.quote(_r.replace('$1', chr(92) + '1'))}, 'g')"


@query("t3_debug_bundle", f"WITH {TRACE} SELECT trace_id, 'event' AS part, {_RED} AS item FROM cut")
def t3(t):
    return O.debug_rows(O.trace_rows(*trace_inputs(t)))


def bundle(t):
    requested = t.paper_versions.select("paper_version_id").unionByName(
        t.paper_versions.select((-F.col("paper_version_id") - 1).alias("paper_version_id"))
    )
    return W.bundle_rows(
        requested,
        t.paper_versions,
        {
            "claims": t.claims.select("paper_version_id", "claim_id", "statement", "support_state"),
            "evidence_refs": t.evidence.select("paper_version_id", "evidence_id", "page_start"),
        },
    )


@query("s8_export_bundle", """
SELECT paper_version_id, 'claims' AS part, claim_id AS sort_key FROM claims UNION ALL SELECT paper_version_id, 'evidence_refs', evidence_id FROM evidence
UNION ALL SELECT -paper_version_id - 1, 'SKIPPED', '' FROM paper_versions""")
def s8(t):
    return bundle(t).select("paper_version_id", "part", "sort_key")


@query("s8_bundle_status", "SELECT 'PARTIAL' AS status, count(*) AS skipped FROM paper_versions")
def s8_status(t):
    return W.bundle_status(bundle(t))


@query("s9_handoff_check", """
WITH b AS (SELECT paper_version_id, 1 AS c, octet_length(encode('{"claim_id":"' || claim_id || '","statement":"' || statement || '","support_state":"' || support_state || '"}')) AS n FROM claims
  UNION ALL SELECT paper_version_id, 0, octet_length(encode('{"evidence_id":"' || evidence_id || '","page_start":' || page_start || '}')) FROM evidence)
SELECT paper_version_id, cast(sum(c) AS bigint) AS claims, cast(sum(n) AS bigint) AS bytes, CASE WHEN sum(c) > 200 THEN 'too_many_claims' WHEN sum(n) > 2097152 THEN 'too_large' END AS refused FROM b GROUP BY 1
UNION ALL SELECT -paper_version_id - 1, 0, 0, 'unknown_version' FROM paper_versions""")
def s9(t):
    return W.handoff_check(bundle(t))
