"""Streams with bounded state: late, repeated and failed batches."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.session import shared_folder
from evidentia.streaming import jobs, stateful

EVENT = "task_id string, event_id string, occurred timestamp, state string"
BEAT = "identity string, last_seen double, occurred timestamp"
CALL = "event_id long, provider string, occurred timestamp, kind string, status string, success boolean, latency_ms double"


def at(minutes: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark):
    """A folder of batches, read one file per trigger."""
    folder = shared_folder(spark)

    def put(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def stream(schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    return folder, put, stream


def steps(spark, feed, late, keep):
    folder, _, stream = feed
    with stateful.rocksdb_state(spark):
        out = jobs.run_to_end(stateful.task_steps(stream(EVENT), late, keep), folder)
    return [tuple(r) for r in out.orderBy("task_id", "event_id").collect()]


def test_an_earlier_event_of_a_later_batch_is_judged_first(spark, feed):
    folder, put, _ = feed
    put([("a", "1", at(0), "PENDING"), ("a", "3", at(2), "RUNNING"), ("b", "1", at(1), "QUEUED"), ("c", "1", None, "QUEUED")], EVENT)
    put([("a", "2", at(1), "QUEUED"), ("a", "4", at(3), "SUCCEEDED"), ("b", "2", at(50), "RUNNING")], EVENT)
    # The watermark is at 40 minutes now: b's second event still waits, a is finished and forgotten.
    assert steps(spark, feed, "10 minutes", "5 minutes") == [
        ("a", "1", None, "PENDING", True, 0), ("a", "2", "PENDING", "QUEUED", True, 0), ("a", "3", "QUEUED", "RUNNING", True, 0),
        ("a", "4", "RUNNING", "SUCCEEDED", True, 0), ("b", "1", None, "QUEUED", True, 0),
    ]
    assert stateful.stored_rows(spark, f"{folder}/checkpoint", "current") == 1
    # The next run goes on from the checkpoint; a late event is dropped, the forgotten task would start anew.
    put([("b", "3", at(51), "RETRYING"), ("b", "0", at(2), "FAILED"), ("d", "1", at(200), "PENDING")], EVENT)
    got = steps(spark, feed, "10 minutes", "5 minutes")
    assert got[5:] == [("b", "2", "QUEUED", "RUNNING", True, 0), ("b", "3", "RUNNING", "RETRYING", True, 1)]


def test_illegal_steps_and_a_finished_task(spark, feed):
    _, put, _ = feed
    names = ["PENDING", "QUEUED", "SUCCEEDED", "RUNNING", "RETRYING", "QUEUED", "RUNNING", "SUCCEEDED", "QUEUED"]
    rows = [("a", f"e{i}", at(i), s) for i, s in enumerate(names)]
    put(rows[4:] + rows[:4], EVENT)
    got = steps(spark, feed, "0 seconds", "1 hour")
    assert [r[1] for r in got if not r[4]] == ["e2", "e8"]
    assert got[7][-1] == 1 and got[8][2] == "SUCCEEDED"


def test_state_of_finished_tasks_goes(spark, feed):
    folder, put, _ = feed
    put([(f"t{i}", "1", at(0), "QUEUED") for i in range(30)] + [(f"t{i}", "2", at(1), "CANCELLED") for i in range(30)], EVENT)
    put([("clock", "1", at(100), "PENDING")], EVENT)
    put([("clock", "2", at(200), "QUEUED")], EVENT)
    got = steps(spark, feed, "1 minute", "10 minutes")
    assert sum(r[0].startswith("t") for r in got) == 60
    for name in ("current", "waiting"):
        assert stateful.stored_rows(spark, f"{folder}/checkpoint", name) <= 1


def test_tasks_share_state_entries(spark, feed):
    folder, put, stream = feed
    put([(f"t{i}", f"{i}.1", at(1 + i % 7), "QUEUED") for i in range(900)], EVENT)
    put([(f"t{i}", f"{i}.0", at(0.5), "PENDING") for i in range(900)] + [("t0", "0.9", at(100), "RUNNING")], EVENT)
    with stateful.rocksdb_state(spark):
        out = jobs.run_to_end(stateful.task_steps(stream(EVENT), "30 minutes", "1 hour", buckets=8), folder)
    got = {r.event_id: (r.before, r.after, r.legal) for r in out.collect()}
    assert len(got) == 1800  # the step at 100 minutes waits
    assert all(got[f"{i}.0"] == (None, "PENDING", True) and got[f"{i}.1"] == ("PENDING", "QUEUED", True) for i in range(900))
    assert stateful.stored_rows(spark, f"{folder}/checkpoint", "current") <= 8
    assert stateful.stored_rows(spark, f"{folder}/checkpoint", "waiting") == 1


def test_worker_changes_with_the_beats_as_clock(spark, feed):
    folder, put, stream = feed
    zero = at(0).replace(tzinfo=dt.timezone.utc).timestamp()

    def beat(who, minutes):
        return who, zero + minutes * 60, at(minutes)

    put([beat("a", 0), beat("b", 0), ("x", float("nan"), at(0)), ("y", None, at(0))], BEAT)
    put([beat("a", 0.9), beat("clock", 1.5)], BEAT)  # b is stale at 1.5 minutes, a is not
    put([beat("clock", 60)], BEAT)
    put([beat("b", 60.5), beat("clock", 60.6)], BEAT)  # b is back
    put([beat("clock", 60 * 24 * 2)], BEAT)
    put([beat("clock", 60 * 24 * 2 + 0.5)], BEAT)
    beats = stream(BEAT).withWatermark("occurred", "0 seconds")
    with stateful.rocksdb_state(spark):
        out = jobs.run_to_end(stateful.worker_states(beats, "EventTime"), folder)
    rows = [r for r in out.orderBy("identity", "at_ms").collect() if r.identity != "clock"]
    assert [(r.identity, r.state) for r in rows] == [
        ("a", "FRESH"), ("a", "FRESH"), ("a", "STALE"), ("a", "GONE"),
        ("b", "FRESH"), ("b", "STALE"), ("b", "FRESH"), ("b", "GONE"),
    ]
    assert stateful.stored_rows(spark, f"{folder}/checkpoint", "seen") == 1  # the clock


def test_worker_changes_by_processing_time(spark, feed):
    folder, put, stream = feed
    now = time.time()
    put([("new", now, at(0)), ("old", now - 3600, at(0)), ("gone", now - 90_000, at(0))], BEAT)
    with stateful.rocksdb_state(spark):
        # While a timer stands there is always one more batch, so the query is stopped from outside.
        query = (
            stateful.worker_states(stream(BEAT)).writeStream.option("checkpointLocation", f"{folder}/checkpoint")
            .outputMode("append").trigger(processingTime="1 second").format("parquet").option("path", f"{folder}/out").start()
        )
    try:
        for _ in range(60):
            time.sleep(1)
            if query.lastProgress and query.lastProgress["batchId"] >= 1:
                break
    finally:
        query.stop()
    out = spark.read.parquet(f"{folder}/out")
    assert {r.identity: r.state for r in out.collect()} == {"new": "FRESH", "old": "STALE"}


def calls(rng, n, provider, start):
    return [
        (i, provider, at(start + float(rng.uniform(0, 4.9))), "latency", "OK", None, float(v))
        for i, v in enumerate(rng.lognormal(3, 1, n))
    ]


def test_merged_sketches_keep_their_rank_error(spark, feed):
    folder, put, stream = feed
    rng = np.random.default_rng(3)
    all_rows = []
    for batch in range(3):  # the same windows over several batches
        rows = calls(rng, 3000, "p", 0) + calls(rng, 5, "few", 0) + [(9, "none", at(1), "attempt", "LLM_001", None, 1.0)]
        put(rows, CALL)
        all_rows += rows
    panes = jobs.run_keyed(jobs.provider_panes(stream(CALL)), folder, ["pane_start", "provider"])
    whole = {r.provider: r for r in jobs.rolling_health(panes).collect()}
    for name, tolerance in (("p", 0.03), ("few", 0.1)):
        values = np.array([r[6] for r in all_rows if r[1] == name])
        assert whole[name].latencies == len(values)
        for q, got in ((0.5, whole[name].latency_p50), (0.9, whole[name].latency_p90)):
            assert (values < got).mean() <= q + tolerance and (values <= got).mean() >= q - tolerance
    assert whole["none"].latency_p50 is None and whole["none"].error_rate == 1.0 and whole["none"].attempts == 3
    sliding = jobs.rolling_health(panes, "5 minutes", "1 minute").groupBy("provider").agg(F.sum("latencies").alias("n")).collect()
    assert {r.provider: r.n for r in sliding}["p"] == 5 * 9000


def test_a_repeated_batch_replaces_its_own_rows(spark, feed):
    folder, put, stream = feed
    put([(1, "p", at(0), "attempt", "OK", None, None)], CALL)
    panes = jobs.provider_panes(stream(CALL))
    jobs.start_keyed(panes, folder).awaitTermination()
    # A batch that failed after writing is written again under its own number.
    spark.read.parquet(f"{folder}/out/batch=0").write.mode("append").parquet(f"{folder}/copy")
    spark.read.parquet(f"{folder}/copy").write.mode("overwrite").parquet(f"{folder}/out/batch=0")
    got = jobs.read_keyed(spark, panes, folder, ["pane_start", "provider"]).collect()
    assert [r.attempts for r in got] == [1]
    put([(2, "p", at(0.5), "attempt", "LLM_001", None, None)], CALL)
    got = jobs.run_keyed(panes, folder, ["pane_start", "provider"]).collect()
    assert [(r.attempts, r.errors) for r in got] == [(2, 1)]
