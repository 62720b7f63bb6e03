"""Keyed streaming jobs with timers: task steps in event order, worker freshness.

State is kept in RocksDB, by buckets of tasks or one entry per worker, and is dropped by timers, so it is
bounded by what is active and not by what has ever been seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia import tables

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FRESH_MS = 60_000
RETENTION_MS = 86_400_000


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


STEPS = "event_id string, before string, after string, legal boolean, retries int"
#: Tasks share state entries by hash. A stream's checkpoint fixes the number.
BUCKETS = 4096


class TaskSteps(StatefulProcessor):
    """Holds events until the watermark has passed them, then judges them in order of time.

    A key is a bucket of tasks, so that calls to the state store follow the number of buckets and
    batches, not that of tasks. ``current``: state, retries and time of each task, column by
    column. ``waiting``: events the watermark has not passed, one entry per batch. ``alarm``: the
    bucket's one timer, at its earliest waiting event or, where that is sooner, at the moment
    a finished task's state may go.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms
        self.legal = {k: frozenset(v) for k, v in tables.TASK_TRANSITIONS.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "task array<string>, state array<string>, retries array<int>, at_us array<long>")
        self.waiting = handle.getListState("waiting", "task array<string>, at_us array<long>, event_id array<string>, state array<string>")
        self.alarm = handle.getValueState("alarm", "at_ms long")

    def _alarm(self, wanted: int | None, sooner: bool) -> None:
        """Set the timer; with ``sooner`` one that stands before ``wanted`` stays."""
        old = self.alarm.get()
        if old is not None and (old[0] == wanted or (sooner and old[0] < wanted)):
            return
        if old is not None:
            self.handle.deleteTimer(old[0])
        if wanted is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(wanted)
            self.alarm.update((wanted,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [[f[c].tolist() for c in ("task", "at_us", "event_id", "state")] for f in rows if len(f)]
        self.waiting.appendList([tuple(n) for n in new])
        self._alarm(-(-min(min(n[1]) for n in new) // 1000), True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        stored = self.current.get()
        current = {t: tuple(r) for t, *r in zip(*stored, strict=True)} if stored else {}
        events = [e for entry in self.waiting.get() for e in zip(*entry, strict=True)]
        due = [e for e in events if e[1] <= now * 1000]
        left = [e for e in events if e[1] > now * 1000]
        due.sort(key=lambda e: (e[1], e[2], e[3] or ""))
        out = []
        for task, at_us, event_id, after in due:
            state, retries, _ = before = current.get(task, (None, 0, 0))
            ok = state is None or after in self.legal.get(state, frozenset())
            if ok:
                retries += after == "RETRYING"
                current[task] = (after, retries, at_us)
            else:
                current[task] = before
            out.append((task, event_id, state, after, ok, retries))
        busy = {e[0] for e in left}
        next_ms = [-(-min(e[1] for e in left) // 1000)] if left else []
        kept = {}
        for task, (state, retries, at_us) in current.items():
            if state in tables.TERMINAL_STATES and task not in busy:
                expiry = -(-at_us // 1000) + self.keep_ms
                if expiry <= now:
                    continue
                next_ms.append(expiry)
            kept[task] = (state, retries, at_us)
        if due:
            self.waiting.put([columns(left)]) if left else self.waiting.clear()
        if kept:
            self.current.update(columns([(task, *r) for task, r in kept.items()]))
        else:
            self.current.clear()
        self._alarm(min(next_ms, default=None), False)
        if out:
            yield pd.DataFrame(out, columns=["task", "event_id", "before", "after", "legal", "retries"])


def columns(rows: list[tuple]) -> tuple:
    return tuple(list(c) for c in zip(*rows, strict=True))


def task_steps(events: DataFrame, late: str = "0 seconds", keep: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Every state change of a task, in order of time, with whether the rules allow it.

    An event waits until the watermark, ``late`` behind the newest event of all, has passed
    it, so an earlier event of a later batch is still judged first; one that comes after that
    is dropped. An illegal step is reported and leaves the task as it was; nothing may
    follow a terminal state for ``keep`` of event time, after which the task is forgotten.
    The first state is taken. Ties of time go by event_id.
    ``events``: task_id (kept as text inside), event_id, occurred (timestamp), state; rows without
    a time are dropped.
    """
    key_type = events.schema["task_id"].dataType.simpleString()
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    timed = events.where(F.col("occurred").isNotNull() & F.col("event_id").isNotNull()).withWatermark("occurred", late)
    named = timed.select(F.pmod(F.xxhash64("task_id"), F.lit(buckets)).alias("bucket"), F.col("task_id").cast("string").alias("task"),
                         F.col("event_id").cast("string").alias("event_id"), "occurred",
                         F.unix_micros("occurred").alias("at_us"), "state")
    judged = named.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=TaskSteps(keep_ms),
        outputStructType=f"task string, {STEPS}",
        outputMode="append",
        timeMode="EventTime",
    )
    return judged.select(F.col("task").cast(key_type).alias("task_id"), "event_id", "before", "after", "legal", "retries")


FRESHNESS = "last_seen double, state string, at_ms long"


def milliseconds(seconds: float) -> int:
    return round(seconds * 1_000_000) // 1000


class Freshness(StatefulProcessor):
    """Remembers the newest beat of a worker; timers say when it is stale and when it is forgotten."""

    def __init__(self, event_time: bool):
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_seen double, state string")

    def now(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(r["last_seen"] for r in rows)
        old = self.seen.get()
        if old is not None and newest <= old[0]:
            return
        now = self.now(timerValues)
        age = now - milliseconds(newest)
        if age > RETENTION_MS:
            return
        state = "FRESH" if age <= FRESH_MS else "STALE"
        self.seen.update((newest, state))
        wait = FRESH_MS if state == "FRESH" else RETENTION_MS
        self.handle.registerTimer(milliseconds(newest) + wait + 1)
        yield Row(identity=key[0], last_seen=newest, state=state, at_ms=now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.seen.get()
        if known is None:
            return
        last_seen, state = known
        now = self.now(timerValues)
        age = now - milliseconds(last_seen)
        if age > RETENTION_MS:
            self.seen.clear()
            yield Row(identity=key[0], last_seen=last_seen, state="GONE", at_ms=now)
        elif age > FRESH_MS and state == "FRESH":
            self.seen.update((last_seen, "STALE"))
            self.handle.registerTimer(milliseconds(last_seen) + RETENTION_MS + 1)
            yield Row(identity=key[0], last_seen=last_seen, state="STALE", at_ms=now)


def worker_states(beats: DataFrame, clock: str = "ProcessingTime") -> DataFrame:
    """The changes of every worker's state: FRESH at a beat, STALE after a minute, GONE after a day.

    identity, last_seen (seconds), state, at_ms. One row per worker and batch at most for its
    beats, and one per timer. ``clock`` is ``ProcessingTime``, or ``EventTime``, where the
    beats' own watermark is the time and nothing depends on when the job runs. Times
    that are not finite are ignored; a beat older than the known one changes nothing.
    ``beats``: identity, last_seen, and with ``EventTime`` a watermarked timestamp ``occurred``.
    """
    seen = F.col("last_seen")
    usable = beats.where(seen.isNotNull() & ~F.isnan(seen) & (F.abs(seen) < 1e18))
    columns = ["identity", "last_seen"] + ["occurred"] * (clock == "EventTime")
    key_type = beats.schema["identity"].dataType.simpleString()
    return usable.select(*columns).groupBy("identity").transformWithState(
        statefulProcessor=Freshness(clock == "EventTime"),
        outputStructType=f"identity {key_type}, {FRESHNESS}",
        outputMode="append",
        timeMode=clock,
    )


def stored_rows(spark: SparkSession, checkpoint: str, name: str) -> int:
    """Entries of one state of a stopped query."""
    state = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return state.count()
