"""Micro-batches give what one batch gives."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from ravelog.operators import activity, evidence, quality
from ravelog.streaming import jobs

EVENT = "hub_id string, event_id string, ts timestamp, ts_raw string, agent string, model string, session_id string, cwd string, role string, text string, tokens_out long, source_file string, line_no long, day date"


def events(spark, n, start=0):
    t = lambda i: dt.datetime(2026, 1, 1 + i % 3, 10, i % 60)
    rows = [("h", f"e{i}", t(i), t(i).isoformat(), f"a{i % 2}", "m", f"s{i % 4}", f"/w{i % 2}", "user" if i % 3 else "assistant", f"text number {i}", i, "f", i, t(i).date()) for i in range(start, start + n)]
    return spark.createDataFrame(rows, EVENT)


def test_append_is_idempotent(spark, tmp_path):
    log = str(tmp_path / "log")
    assert jobs.append_days(events(spark, 30), log) == ["2026-01-01", "2026-01-02", "2026-01-03"]
    jobs.append_days(events(spark, 40, 10).union(events(spark, 5)), log)
    jobs.append_days(events(spark, 50), log)
    rows = spark.read.parquet(log)
    assert rows.count() == 50 == rows.select("event_id").distinct().count()
    assert jobs.append_days(events(spark, 30).limit(0), log) == []
    bare = events(spark, 1).withColumn("event_id", F.lit(""))
    jobs.append_days(bare, log)
    jobs.append_days(bare, log)
    assert spark.read.parquet(log).count() == 51


def test_ingest_and_dirty_days(spark, tmp_path):
    src, log, derived = (str(tmp_path / n) for n in ("src", "log", "derived"))
    build = lambda rows: evidence.build_evidence(rows.withColumn("tool_uses", F.array().cast("array<struct<name:string,input_summary:string>>")))
    for part in (events(spark, 20), events(spark, 25, 10).union(events(spark, 3))):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENT).parquet(src)
        jobs.ingest(stream, log, str(tmp_path / "ck"), jobs.rebuild_days(log, derived, build), {"availableNow": True}).awaitTermination(120)
    assert spark.read.parquet(log).count() == 35
    batch = build(events(spark, 35)).select("day", "session_id", "id")
    assert sorted(map(str, spark.read.parquet(derived).select("day", "session_id", "id").collect())) == sorted(map(str, batch.collect()))


def test_watermark_dedup(spark, tmp_path):
    src = str(tmp_path / "src")
    events(spark, 20).union(events(spark, 10)).coalesce(1).write.parquet(src)
    q = jobs.deduplicated(spark.readStream.schema(EVENT).parquet(src)).writeStream.format("memory").queryName("dedup_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup_out").count() == 20


def test_late_rows(spark):
    months = spark.createDataFrame([("h", "2026-01")], "hub_id string, month string")
    assert jobs.late_rows(events(spark, 4), months).count() == 4


def test_live_state_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out = str(tmp_path / "src"), []
    for part in (events(spark, 12), events(spark, 12, 12)):
        part.coalesce(1).write.mode("append").parquet(src)
        live = jobs.live_sessions(spark.readStream.schema(EVENT).parquet(src))
        q = live.writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    last = {r.session_id: r for r in out}
    for r in activity.live_index(events(spark, 24)).collect():
        x = last[r.session_id]
        assert (x.message_count, x.started_at, x.last_activity, x.intent, x.last_user) == (r.message_count, r.started_at, r.last_activity, r.intent, r.last_user)
        assert len(x.recent) == 6 and x.status == "active"


def test_freshness(spark):
    now = dt.datetime(2026, 1, 1, 12)
    p = spark.createDataFrame([("a", now - dt.timedelta(seconds=30), 5, None), ("b", now - dt.timedelta(seconds=900), 1, None), ("c", now, 0, "boom")], "name string, timestamp timestamp, input_rows long, error string")
    assert {r.name: r.state for r in quality.freshness(p, F.lit(now)).collect()} == {"a": "ok", "b": "late", "c": "failed"}


def test_retention_equals_its_sql_at_the_edges(spark, tmp_path):
    """A session just past, at and just under 24 hours, one held by a task, one missing in the log, one with events on both sides."""
    ends = {1: "2024-01-29 23:57:59.999", 2: "2024-01-29 23:58:00", 4: "2024-01-29 23:58:00.001", 5: "2024-01-02 00:00:00", 10: "2024-01-03 00:00:00", 6: "2024-01-28 00:00:00", 9: "2024-02-02 00:00:00"}
    rows = [(10 * u + k, u, "view", t, 1.5, '{"k": 3}') for u, t in ends.items() for k, t in enumerate((t, "2024-01-01 08:00:00"))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in __spark_entry__.queries()["str_retention"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["str_retention"]).fetchall()) == [("h0", "6", 2), ("h1", "1", 2), ("h2", "2", 2)]
