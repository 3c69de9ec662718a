"""A batch of decision marks is accepted as if each came alone, in order."""

import random

import pytest

from ravelog.operators import decisions as D

MEMORY = "hub_id string, id string, title string, content string, type string, status string, confidence double, created_at string, updated_at string, supersedes array<string>, source_session_ids array<string>, source_event_ids array<string>, line_no long"


def memories(spark, names, supersedes=()):
    old = dict(supersedes)
    rows = [("h", n, n, n, "fact", "active", 0.7, "2024-01-01", "2024-01-01", old.get(n, []), ["s"], [], i) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, MEMORY)


def marks(spark, rows):
    """(memory, replacements or None for an acceptance) in order."""
    data = [("h", None, m, "superseded" if to else "accepted", "because", None, ["s"], [], list(to or []), None, None, i) for i, (m, to) in enumerate(rows)]
    return spark.createDataFrame(data, D.EVENT)


def one_by_one(structural, stored, batch):
    """Which marks are refused, taken one after the other."""
    latest, refused = {m: set(to or ()) for m, to in stored}, []
    for i, (m, to) in enumerate(batch):
        edges = set(structural) | {(a, b) for a, bs in latest.items() for b in bs}
        seen, open_ = set(), list(to or ())
        while open_:
            x = open_.pop()
            if x not in seen:
                seen.add(x)
                open_ += [b for a, b in edges if a == x]
        if m in seen:
            refused.append(i)
        else:
            latest[m] = set(to or ())
    return refused


def refused(df):
    return sorted(r.line_no for r in df.collect() if r.problem == "cycle")


def test_two_marks_that_close_a_loop_together(spark):
    none = spark.createDataFrame([], D.EVENT)
    got = D.check_marks(marks(spark, [("a", ["b"]), ("b", ["a"])]), memories(spark, "ab"), none)
    assert refused(got) == [1]


def test_a_revocation_between_opens_the_way(spark):
    none = spark.createDataFrame([], D.EVENT)
    got = D.check_marks(marks(spark, [("a", ["b"]), ("a", None), ("b", ["a"]), ("a", ["b"])]), memories(spark, "ab"), none)
    assert refused(got) == [3]


@pytest.mark.parametrize("seed", range(2))
def test_batches_equal_one_by_one(spark, seed):
    rnd = random.Random(seed)
    names = [f"m{i}" for i in range(7)]
    pick = lambda m: rnd.sample([x for x in names if x != m], rnd.choice([1, 1, 2]))
    structural = [("m0", "m1"), ("m4", "m5")]
    draw = lambda n: [(m, pick(m) if rnd.random() < 0.75 else None) for m in rnd.choices(names, k=n)]
    stored, batch = [(m, to) for m, to in draw(3) if m not in ("m1", "m5")], draw(14)
    log = marks(spark, stored).selectExpr("hub_id", "concat('dec_', line_no) as id", "memory_id", "decision", "reason", "concat('2024-01-01T00:00:', lpad(line_no, 2, '0')) as ts", "source_session_ids", "source_event_ids", "replacement_ids", "reverses", "target", "line_no")
    known = memories(spark, names, [("m1", ["m0"]), ("m5", ["m4"])])
    assert refused(D.check_marks(marks(spark, batch), known, log)) == one_by_one(structural, stored, batch)


def test_a_batch_is_recorded_once(spark, tmp_path):
    root, known = str(tmp_path), memories(spark, "abc")
    batch = marks(spark, [("a", ["b"]), ("b", ["a"]), ("b", ["x"]), ("c", None), ("c", None)])
    first = {r.line_no: (r.problem, r.id) for r in D.record_marks(batch, known, root, "one").collect()}
    assert [first[i][0] for i in range(5)] == [None, "cycle", "unknown replacement", None, None]
    assert first[4][1] != first[3][1] and first[4][1].startswith(first[3][1].split("_2")[0][:20])
    assert {r.line_no: (r.problem, r.id) for r in D.record_marks(batch, known, root, "one").collect()} == first
    assert D.stored_events(spark, root).count() == 3
    second = D.record_marks(marks(spark, [("b", ["a"]), ("a", None)]), known, root, "two")
    assert refused(second) == [0] and D.stored_events(spark, root).count() == 4
    assert refused(D.record_marks(marks(spark, [("b", ["a"])]), known, root, "three")) == []
