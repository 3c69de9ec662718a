"""The day's pack, the numbering and the evenly spaced choice against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ravelog.operators import evidence, packing
from ravelog.operators.numbering import numbered

TURN = "hub_id string, day date, agent string, session_id string, event_id string, line_no long, ts timestamp, role string, text string, tool_uses array<struct<name:string,input_summary:string>>, dup boolean"


def events(spark, seed, sessions, rows):
    rnd = random.Random(seed)
    out, at = [], dt.datetime(2026, 1, 1)
    for i in range(rows):
        s = rnd.randrange(sessions)
        text = rnd.choice(["", "ok", "x" * rnd.randint(1, 700), "y" * rnd.randint(80, 500)])
        tools = [("t" * rnd.randint(1, 60), "")] if rnd.random() < 0.3 else []
        out.append(("h", (at + dt.timedelta(days=s % 2)).date(), f"a{s % 3}", f"s{s}", f"e{i}", i, at + dt.timedelta(days=s % 2, minutes=rnd.randint(0, 900)), rnd.choice(["user", "assistant", "assistant", "system"]), text, tools, rnd.random() < 0.1))
    return spark.createDataFrame(out, TURN)


def plain_pack(rows, anchors, per_agent, total, budget):
    """One day, row by row; rows are dicts with cost and priority."""
    sessions = {}
    for r in rows:
        sessions.setdefault((r["agent"], r["session_id"]), []).append(r)
    order = sorted(sessions, key=lambda k: (min((r["ts"], r["line_no"]) for r in sessions[k]), k))
    taken, spent, agents = [], 0, {}

    def take(r):
        nonlocal spent
        fits = agents.get(r["agent"], 0) < per_agent and len(taken) < total and spent + r["cost"] <= budget
        if fits:
            taken.append(r["event_id"])
            spent += r["cost"]
            agents[r["agent"]] = agents.get(r["agent"], 0) + 1
        return fits

    for k in order:
        for e in dict.fromkeys(x for x in anchors.get(k, ()) if x):
            for r in sessions[k]:
                if r["event_id"] == e:
                    take(r)
    queues = [[r for r in sorted(sessions[k], key=lambda r: (-r["priority"], r["ts"], r["line_no"])) if r["event_id"] not in taken] for k in order]
    going = True
    while going:
        going = False
        for q in queues:
            if q and take(q.pop(0)):
                going = True
    return taken


@pytest.mark.parametrize("seed, sessions, rows, limits", [(1, 4, 120, (40, 80, 32_000)), (2, 12, 200, (9, 25, 32_000)), (3, 10, 150, (40, 80, 2_500)), (4, 30, 160, (6, 80, 3_300)), (5, 3, 40, (40, 80, 100)), (6, 1, 90, (200, 7, 99_999))])
def test_pack_equals_a_plain_loop(spark, seed, sessions, rows, limits):
    df = events(spark, seed, sessions, rows)
    base = packing.with_priority(df.where("role <> 'system' and not dup")).withColumn("cost", packing.row_cost(F.col("text"), F.col("tool_uses")))
    anchors = {}
    for r in packing.anchor_events(df.where("not dup")).collect():
        anchors.setdefault(r.day, {})[r.agent, r.session_id] = (r.goal_event, r.outcome_event)
    days = {}
    for r in base.collect():
        days.setdefault(r.day, []).append(r.asDict())
    want = {(day, e) for day, own in days.items() for e in plain_pack(own, anchors.get(day, {}), *limits)}
    got = [(r.day, r.event_id) for r in packing.pack(df, *limits).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_numbers_equal_one_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randint(0, 50), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    got = numbered(df, ["k"], [F.desc("v"), F.col("i")], "n").collect()
    want = {}
    for k in ("a", "b", None):
        want |= {r[2]: n for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1)}
    assert len(got) == 700 and all(want[r.i] == r.n for r in got)
    assert numbered(df.limit(0), ["k"], [F.col("v")], "n").count() == 0


def test_evenly_spaced_texts_of_a_long_session(spark):
    n = 997
    at = dt.datetime(2026, 1, 1)
    rows = [("h", at.date(), "s", "e%05d" % i, i, at, at.isoformat(), "a", "m", "/w", "user" if i % 2 else "assistant", f"text {i} " + "z" * 60, "f", []) for i in range(n)]
    kind = "hub_id string, day date, session_id string, event_id string, line_no long, ts timestamp, ts_raw string, agent string, model string, cwd string, role string, text string, source_file string, tool_uses array<struct<name:string,input_summary:string>>"
    r = evidence.build_evidence(spark.createDataFrame(rows, kind)).first()
    spread = lambda xs, k: [xs[i] for i in dict.fromkeys(round(j * (len(xs) - 1) / (k - 1)) for j in range(k))]
    texts = [x[11] for x in rows]
    assert r.goals == spread(texts[1::2], 5) and r.actions == spread(texts[::2], 12) and r.results == [] and len(r.source_event_ids) == n
