"""Structured Streaming jobs: ingest, exact deduplication, dirty days, live state, health."""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

KEYS = ("hub_id", "event_id")


def append_days(batch: DataFrame, path: str) -> list[str]:
    """Append a micro-batch to the event log by day, each id once; returns the touched days.

    Rows without an id are told apart by their content. Only the day partitions that
    the batch touches are read, and a replay of the same batch adds nothing.
    """
    spark = batch.sparkSession
    key = F.coalesce(F.nullif("event_id", F.lit("")), F.sha1(F.to_json(F.struct("session_id", "ts_raw", "role", "text", "line_no"))))
    fresh = batch.withColumn("event_id", key).dropDuplicates([*KEYS, "day"]).persist()
    try:
        days = [r["day"] for r in fresh.select("day").distinct().collect()]  # days of one micro-batch
        if not days:
            return []
        if log_exists(spark, path):
            stored = spark.read.parquet(path).where(F.col("day").isin(days)).select(*KEYS, "day")
            fresh_rows = fresh.join(stored, [*KEYS, "day"], "left_anti")
        else:
            fresh_rows = fresh
        fresh_rows.write.mode("append").partitionBy("day").parquet(path)
        return sorted(str(d) for d in days)
    finally:
        fresh.unpersist()


def log_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(where) and len(fs.listStatus(where)) > 0


def ingest(events: DataFrame, path: str, checkpoint: str, on_days: Callable[[SparkSession, list[str]], None] | None = None, trigger: dict | None = None):
    """Start the ingest query; ``on_days`` gets the days each batch touched and rebuilds what hangs on them."""

    def each(batch: DataFrame, _: int) -> None:
        days = append_days(batch, path)
        if on_days and days:
            on_days(batch.sparkSession, days)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def rebuild_days(source: str, target: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, list[str]], None]:
    """A handler that rebuilds the touched day partitions of a derived table and leaves the others."""

    def run(spark: SparkSession, days: list[str]) -> None:
        rows = build(spark.read.parquet(source).where(F.col("day").cast("string").isin(days)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)

    return run


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cheap variant: repeated ids within a watermark are dropped from the stream itself."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(KEYS))


def late_rows(batch: DataFrame, compacted: DataFrame) -> DataFrame:
    """Rows of months that are compacted already; the next compaction merges them."""
    months = compacted.select("hub_id", "month").distinct()
    return batch.withColumn("month", F.date_format("day", "yyyy-MM")).join(months, ["hub_id", "month"], "left_semi")


LIVE = "hub_id string, session_id string, agent string, model string, cwd string, started_at timestamp, last_activity timestamp, message_count long, intent string, last_user string, status string, recent array<string>"
STATE = "agent string, model string, cwd string, started_at timestamp, last_activity timestamp, message_count long, intent string, last_user string"
TURN = "line string"
IDLE_MS, STALE_MS = 300_000, 1_800_000


class LiveSession(StatefulProcessor):
    """State of one session: counts, intent, last user text and its last turns; timers let it go idle, stale and away."""

    def __init__(self, keep_turns: int = 20, retention_ms: int = 24 * 3600 * 1000):
        self.keep_turns, self.retention_ms = keep_turns, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)
        self.turns = handle.getListState("turns", TURN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "line_no"], kind="stable")
        old = self.state.get() if self.state.exists() else None
        agent, model, cwd, started, last, count, intent, last_user = old if old else (None, None, None, None, None, 0, None, None)
        lines = [r[0] for r in self.turns.get()] if old else []
        for r in batch.itertuples():
            ts = r.ts.to_pydatetime()
            started = ts if started is None or ts < started else started
            last = ts if last is None or ts > last else last
            agent, model, cwd, count = r.agent, r.model or model, r.cwd or cwd, count + 1
            if r.said:
                intent, last_user = intent or r.said, r.said
            lines.append(f"[{r.role}] {r.text}")
        lines = lines[-self.keep_turns :]
        self.state.update((agent, model, cwd, started, last, count, intent, last_user))
        self.turns.put([(x,) for x in lines])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentProcessingTimeInMs()
        for wait in (IDLE_MS, STALE_MS, self.retention_ms):
            self.handle.registerTimer(now + wait)
        yield self.row(key, "active", lines)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = len(list(self.handle.listTimers()))
        if left == 0:
            self.state.clear()
            self.turns.clear()
            return
        yield self.row(key, "idle" if left == 2 else "stale", [r[0] for r in self.turns.get()])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        none = lambda v: None if pd.isna(v) else v
        self.state.update((none(r["agent"]), none(r["model"]), none(r["cwd"]), r["started_at"].to_pydatetime(), r["last_activity"].to_pydatetime(), int(r["message_count"]), none(r["intent"]), none(r["last_user"])))
        self.turns.put([(x,) for x in r["recent"]])

    def row(self, key: tuple, status: str, lines: list[str]) -> pd.DataFrame:
        agent, model, cwd, started, last, count, intent, last_user = self.state.get()
        names = [c.split()[0] for c in LIVE.split(", ")]
        return pd.DataFrame([(*key, agent, model, cwd, started, last, count, intent, last_user, status, lines)], columns=names)

    def close(self) -> None:
        return None


def live_sessions(events: DataFrame, initial: DataFrame | None = None, keep_turns: int = 20) -> DataFrame:
    """Stream of live session rows, keyed by hub and session. ``initial`` restores state from a batch aggregate of the log."""
    from ..functions import text as T

    said = F.when(F.col("role") == "user", T.intent(F.col("text")))
    rows = events.select("hub_id", "session_id", "ts", "line_no", "agent", "model", "cwd", "role", F.substring("text", 1, 800).alias("text"), F.coalesce(said, F.lit("")).alias("said"))
    grouped = rows.groupBy("hub_id", "session_id")
    first = None if initial is None else initial.groupBy("hub_id", "session_id")
    return grouped.transformWithStateInPandas(LiveSession(keep_turns), LIVE, "update", "ProcessingTime", first)


class Health(StreamingQueryListener):
    """Progress of each query as JSON lines: heartbeat, rows, errors. ``quality.freshness`` reads them."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def note(self, **fields) -> None:
        with open(f"{self.folder}/health.jsonl", "a") as f:
            f.write(json.dumps(fields) + "\n")

    def onQueryStarted(self, event) -> None:
        self.note(name=event.name or str(event.id), timestamp=event.timestamp, input_rows=0, error=None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.note(name=p.name or str(p.id), timestamp=p.timestamp, input_rows=p.numInputRows, error=None)

    def onQueryIdle(self, event) -> None:
        self.note(name=str(event.id), timestamp=event.timestamp, input_rows=0, error=None)

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.note(name=str(event.id), timestamp=None, input_rows=0, error=event.exception[:500])


def ingest_tiers(rows: DataFrame, root: str, checkpoint: str, after: Callable[[int], None] = lambda batch: None, trigger: dict | None = None):
    """Stream lines (``compaction.COLUMNS``) into the recent tier, those of compacted months too; the next compaction merges them.

    A batch that is replayed, because the job stopped between its write and its commit,
    finds its lines in either tier and adds nothing, even if a compaction ran between.
    ``after`` is called with the batch's number once it is written.
    """
    from ..operators import compaction

    def each(batch: DataFrame, number: int) -> None:
        compaction.append(batch, root)
        after(number)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 seconds"})).start()


RETAINED = "hub_id string, session_id string, last_activity timestamp, events long, status string"
HELD = "last_activity timestamp, events long, open boolean, logged array<date>"
CONTROL = "hub_id string, session_id string, ts timestamp, kind string, day date, open boolean"


class RetainedSession(StatefulProcessor):
    """State of a session that goes ``hours`` after its last event, unless an open task holds it or the log lacks its last day.

    Rows are of kind event, task (``open`` says whether a task holds the session now) or
    logged (``day`` is in the event log). A session that is held when its timer ends waits
    for the row that sets it free; a later event starts it anew.
    """

    def __init__(self, hours: int = 24):
        self.wait = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, events, held, logged = self.state.get() if self.state.exists() else (None, 0, False, [])
        logged = set(logged or [])
        for r in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            if r.kind == "event":
                ts = r.ts.to_pydatetime()
                last, events = ts if last is None or ts > last else last, events + 1
            elif r.kind == "task":
                held = bool(r.open)
            elif r.kind == "logged":
                logged.add(r.day if not hasattr(r.day, "date") else r.day.date())
        # days before the last event decide nothing any more
        logged = sorted(d for d in logged if last is None or d >= last.date())
        self.state.update((last, events, held, logged))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None and not held and last.date() in logged:
            end = int(last.replace(tzinfo=dt.UTC).timestamp() * 1000) + self.wait
            self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
        yield self.row(key, "held" if held else "live")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.row(key, "pruned")
        self.state.clear()

    def row(self, key: tuple, status: str) -> pd.DataFrame:
        last, events, _, _ = self.state.get()
        return pd.DataFrame([(*key, last, events, status)], columns=[c.split()[0] for c in RETAINED.split(", ")])

    def close(self) -> None:
        return None


def retained_sessions(rows: DataFrame, hours: int = 24, delay: str = "0 seconds") -> DataFrame:
    """Stream of session states and of their end (status pruned) from rows of ``CONTROL``, by event time."""
    keyed = rows.select(*(c.split()[0] for c in CONTROL.split(", "))).withWatermark("ts", delay)
    return keyed.groupBy("hub_id", "session_id").transformWithStateInPandas(RetainedSession(hours), RETAINED, "update", "EventTime")
