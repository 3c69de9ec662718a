"""Transcript formats, growing files, archives."""

import io
import json
import os
import tarfile

import pytest
import zstandard

from ravelog.operators import quality
from ravelog.sources import archives, transcripts
from ravelog.sources.tail import TailReader, TailSource


def lines(spark, rows, path="/log/rollout-2026-10-18T01-02-03-aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee.jsonl"):
    return spark.createDataFrame([(path, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows, 1)], "source_file string, line_no long, raw string")


def test_claude(spark):
    t = "2026-10-18T10:00:00Z"
    rows = [
        {"type": "user", "timestamp": t, "sessionId": "s1", "cwd": "/w", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "timestamp": t, "sessionId": "s1", "message": {"role": "assistant", "model": "m1", "usage": {"output_tokens": 7}, "content": [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "one"}, {"type": "tool_use", "name": "Read", "input": {"path": "a.py"}}, {"type": "text", "text": "two"}]}},
        {"type": "user", "timestamp": t, "sessionId": "s1", "message": {"role": "user", "content": [{"type": "tool_result", "content": "x"}]}},
        {"type": "user", "timestamp": t, "sessionId": "s1", "message": {"role": "user", "content": []}},
        {"type": "summary", "timestamp": t},
        {"type": "user", "message": {"content": "no time"}},
        "{broken",
        "[1, 2]",
    ]
    got = transcripts.claude(lines(spark, rows)).orderBy("line_no").collect()
    assert [(r.line_no, r.role, r.text, r.tokens_out) for r in got] == [(1, "user", "hello", 0), (2, "assistant", "one\ntwo", 7), (3, "tool", "", 0)]
    assert got[1].tool_uses[0].name == "Read" and "a.py" in got[1].tool_uses[0].input_summary and got[0].model == "unknown" and got[1].model == "m1"
    bad = quality.bad_lines(lines(spark, rows)).collect()
    assert [(r.bad_lines, r.first_bad_line) for r in bad] == [(2, 7)]


def test_codex_fills_metadata_forward(spark):
    sid = "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee"
    message = lambda text, role="user": {"timestamp": "2026-10-18T10:00:01Z", "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}}
    rows = [
        {"timestamp": "t", "type": "session_meta", "payload": {"session_id": sid, "cwd": "/a", "model_provider": "p", "originator": "Codex Desktop"}},
        message("first"),
        {"type": "turn_context", "payload": {"model": "gpt", "cwd": "/b"}},
        message("abcdefghi", "assistant"),
        {"timestamp": "x", "type": "response_item", "payload": {"type": "reasoning"}},
        {"timestamp": "2026-10-18T10:00:02Z", "type": "response_item", "payload": {"type": "custom_tool_call", "name": "apply", "input": "patch"}},
        {"timestamp": "2026-10-18T10:00:03Z", "type": "response_item", "payload": {"type": "function_call_output", "output": "done  it"}},
    ]
    got = transcripts.codex(lines(spark, rows)).orderBy("line_no").collect()
    assert [(r.role, r.text, r.model, r.cwd, r.tokens_out, r.agent) for r in got] == [
        ("user", "first", "p", "/a", 0, "codex-desktop"), ("assistant", "abcdefghi", "gpt", "/b", 3, "codex-desktop"),
        ("assistant", "", "gpt", "/b", 0, "codex-desktop"), ("tool", "[tool_output] done it", "gpt", "/b", 0, "codex-desktop"),
    ]
    assert all(r.session_id == sid for r in got) and got[2].tool_uses[0].name == "apply"
    known = transcripts.codex_sessions(lines(spark, rows))
    later = transcripts.codex(lines(spark, [message("later")]), known).collect()
    assert [(r.model, r.cwd, r.agent) for r in later] == [("p", "/a", "codex-desktop")]


def test_harness_drops_copied_history(spark):
    row = lambda kind, time, **data: {"type": kind, "time": time, "data": data}
    text = lambda t: {"content": [{"type": "text", "text": t}]}
    rows = [
        {"type": "session", "id": "session-1", "cwd": "/w", "createdAt": 1000, "isSeeded": True},
        row("user/message", 500, **text("copied")),
        row("user/message", 1500, **text("mine")),
        row("user/message", 1600, **text("<system-reminder> x")),
        row("assistant/message", 1700, message={"content": [{"type": "text", "text": "answer"}], "source": {"model": "deep"}, "tokens_out": 5}),
        row("tool/call", 1800, name="sh", arguments={"c": "ls"}),
        row("tool/result", 1900, output="o" * 500),
    ]
    got = transcripts.harness(lines(spark, rows, "/s/session.jsonl")).orderBy("line_no").collect()
    assert [(r.role, r.text[:6], r.tokens_out) for r in got] == [("user", "mine", 0), ("assistant", "answer", 5), ("assistant", "", 0), ("tool", "oooooo", 0)]
    assert len(got[3].text) == 400 and got[1].model == "deep" and got[0].ts_raw.startswith("1970-01-01T00:00:01")


def test_zstd_lines_and_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress(b'{"type": "session", "id": "x"}\n\n{"type": "tool/result"}\n'))
    got = transcripts.raw_lines(spark, str(tmp_path / "*.zst")).orderBy("line_no").collect()
    assert [(r.line_no, r.byte_offset) for r in got] == [(1, 0), (3, 32)]


def test_snapshots(spark):
    files = spark.createDataFrame([("/m/2026-10-18.md", " worked \n"), ("/m/2026-10-19.md", "  ")], "source_file string, value string")
    got = transcripts.work_logs(files).collect()
    assert [(r.ts_raw, r.session_id, r.text, r.tokens_out) for r in got] == [("2026-10-18T23:59:00", "qclaw-memory-2026-10-18", "worked", 2)]
    store = json.dumps({"id": "q", "name": "N", "status": "done", "updatedAt": "2026-10-18T01:00:00Z", "agents": [{"model": "unknown"}, {"model": "mm"}], "lastMessageCount": 4})
    files = spark.createDataFrame([("/w/s/q/store.json", store), ("/w/s/r/store.json", json.dumps({"id": "r"})), ("/w/s/q/summary_b.md", "B"), ("/w/s/q/summary_a.md", "A")], "source_file string, value string")
    got = {r.session_id: (r.text, r.model, r.cwd) for r in transcripts.session_stores(files, files).collect()}
    assert got == {"qclaw-q": ("A", "mm", "/w"), "qclaw-r": ("Session: r (status=unknown, messages=0)", "unknown", "/w")}


def test_classify_takes_the_longest_root(spark):
    files = spark.createDataFrame([("/a/b/x.jsonl",), ("/a/y.jsonl",), ("/c/z",)], "source_file string")
    roots = spark.createDataFrame([("/a", "claude"), ("/a/b/", "codex")], "root string, kind string")
    assert {r.source_file: r.kind for r in transcripts.classify(files, roots).collect()} == {"/a/b/x.jsonl": "codex", "/a/y.jsonl": "claude", "/c/z": None}


def test_events_have_identity_and_day(spark):
    parsed = transcripts.claude(lines(spark, [{"type": "user", "timestamp": "2026-10-18T23:30:00Z", "sessionId": "s", "message": {"content": "a"}}]))
    utc, local = (transcripts.to_events(parsed, "h", z).collect()[0] for z in ("UTC", "Asia/Shanghai"))
    assert str(utc.day) == "2026-10-18" and str(local.day) == "2026-10-19" and utc.event_id == local.event_id and len(utc.event_id) == 64


def test_tail_reads_complete_lines_once(spark, tmp_path):
    spark.dataSource.register(TailSource)
    log, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    log.mkdir()
    (log / "a.jsonl").write_bytes(b"one\ntwo\nthr")

    def run():
        stream = spark.readStream.format("line_tail").option("path", f"{log}/*.jsonl").load()
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted((os.path.basename(r.source_file), r.line_no, r.byte_offset, r.raw) for r in spark.read.parquet(str(out)).collect())

    assert run() == [("a.jsonl", 1, 0, "one"), ("a.jsonl", 2, 4, "two")]
    with (log / "a.jsonl").open("ab") as f:
        f.write(b"ee\nfour\n")
    (log / "b.jsonl").write_bytes("über\n".encode())
    got = run()
    assert got[2:] == [("a.jsonl", 3, 8, "three"), ("a.jsonl", 4, 14, "four"), ("b.jsonl", 1, 0, "über")]


def test_tail_numbers_go_on_and_slices_meet(tmp_path):
    """A batch reads its own bytes; a reader that starts anew takes up a file longer than a slice where it was left."""
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"".join(b"line %d\n" % i for i in range(100)))
    options = {"path": str(path), "maxBytesPerFile": "50"}
    reader = TailReader(options)
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    rows = [r for p in parts for r in reader.read(p)]
    assert len(parts) > 10 and [(r[2], r[3]) for r in rows] == [(i + 1, f"line {i}") for i in range(100)]
    with path.open("ab") as f:
        f.write(b"next\n" * 30 + b"unfinis")
    again = TailReader(options)
    more = [r for p in again.partitions(end, again.latestOffset()) for r in again.read(p)]
    assert [(r[2], r[3]) for r in more] == [(101 + i, "next") for i in range(30)]
    with path.open("ab") as f:
        f.write(b"hed\n" + b"x" * 200 + b"\nlast\n")
    middle = {"files": json.dumps(again.known)}
    steps = []
    while (offset := again.latestOffset()) != middle:
        steps += [(p.start, r[2], r[3]) for p in again.partitions(middle, offset) for r in again.read(p)]
        middle = offset
    assert [x[1:] for x in steps] == [(131, "unfinished"), (132, "x" * 200), (133, "last")]
    assert min(p for p, _, _ in steps) >= 100 * 8  # nothing before the offset is read


def test_archives(spark, tmp_path):
    def member(tar, name, body):
        info = tarfile.TarInfo(name)
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))

    with tarfile.open(tmp_path / "2026-09.tar.gz", "w:gz") as tar:
        member(tar, "2026-09/2026-09-01/sessions.jsonl", b'{"a": 1}\n{"a": 2}\n')
        member(tar, "2026-09/2026-09-01/token.jsonl", b"secret\n")
        member(tar, "../evil", b"x\n")
    (tmp_path / "2026-08.tar.gz").write_bytes(b"no archive at all")
    rows = archives.read_archives(spark, str(tmp_path / "*.tar.gz"))
    assert {r.problem.split(":")[0] for r in rows.where("problem is not null").collect()} == {"secret name", "unsafe member", "unreadable archive"}
    good = archives.good_months(rows).orderBy("line_no").collect()
    assert [(str(r.day), r.file, r.line_no, r.raw) for r in good] == [("2026-09-01", "sessions.jsonl", 1, '{"a": 1}'), ("2026-09-01", "sessions.jsonl", 2, '{"a": 2}')]


def test_backfill_and_reconcile(spark, tmp_path):
    (tmp_path / "old.jsonl").write_text("o\n")
    os.utime(tmp_path / "old.jsonl", (1_000_000, 1_000_000))
    (tmp_path / "new.jsonl").write_text("n\nm\n")
    rows, old = transcripts.backfill(spark, str(tmp_path), "2020-01-01T00:00:00")
    assert sorted(r.raw for r in rows.collect()) == ["m", "n"] and [(os.path.basename(r.source_file), r.bytes) for r in old.collect()] == [("old.jsonl", 2)]
    listed = [(r.source_file, r.size) for r in transcripts.to_reconcile(spark, str(tmp_path), spark.createDataFrame([], "source_file string, bytes long")).collect()]
    offsets = spark.createDataFrame([(f, s if f.endswith("old.jsonl") else 1) for f, s in listed], "source_file string, bytes long")
    assert [os.path.basename(r.source_file) for r in transcripts.to_reconcile(spark, str(tmp_path), offsets).collect()] == ["new.jsonl"]


@pytest.mark.parametrize("name,safe", [("sessions.jsonl", True), ("token.json", False), ("id_rsa", False), (".env", False), ("tokens_out.csv", True)])
def test_safe_names(name, safe):
    assert archives.safe_name(name) is safe
