"""Registered queries on small tables of the shapes that the findings of round 4 came from."""

import datetime
import functools
import random

import duckdb
import pytest
import test_marks

from ravelog.operators import decisions, graph
from ravelog.plans import catalog, catalog_jobs, retrieval  # noqa: F401


def stored(spark, folder, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_sql(key, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    rel = con.execute(catalog.ORACLES[key])
    names = [c[0] for c in rel.description]
    return sorted((tuple(float(v) if type(v).__name__ == "Decimal" else v for _, v in sorted(zip(names, r, strict=True))) for r in rel.fetchall()), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def benchmark(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_events_of_users_beyond_the_memories_are_marked(spark, tmp_path):
    at = datetime.datetime(2024, 1, 2)
    events = spark.createDataFrame([(i, at, user, "view", 1.0, '{"k": 1}') for i, user in enumerate((3, 400, 401, 799, 1201))], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    d = stored(spark, tmp_path, events=events, benchmark=benchmark(spark, "one two", "three"))
    assert rows_of(catalog.QUERIES["state_annotate"](spark, d)) == by_sql("state_annotate", d, "events", "benchmark") == [(5,)]


def test_every_copy_of_a_text_has_a_scope(spark, tmp_path):
    rows = [(0, "say one two three four now", "en", "src0"), (1, "say one two three four now", "de", "src0"), (2, "ONE two three four", "en", "src1"), (3, "one two three", "en", "src0"), (4, None, "en", "src0"), (5, "one two three four", None, None)]
    d = stored(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), benchmark=benchmark(spark, "one two three four five"))
    got = rows_of(catalog.QUERIES["ret_scope"](spark, d))
    assert len(got) == 4 and got == by_sql("ret_scope", d, "documents", "benchmark")


@pytest.mark.parametrize(("most", "share"), [(2000, 200_000), (2000, 7), (6, 7), (1, 3)])
def test_counts_of_reached_nodes(spark, monkeypatch, most, share):
    """Whole groups, groups cut by tasks, and groups too large for one task."""
    rnd = random.Random(most + share)
    edges = [(f"h{i % 2}", f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}" if rnd.random() < 0.95 else None) for i in range(75)]
    monkeypatch.setattr(graph, "gathered", functools.partial(graph.gathered, share=share))
    df = spark.createDataFrame([*edges, ("h0", None, "n1")], "hub_id string, src string, dst string").repartition(3)
    got = {(r.hub_id, r.start): r.reachable for r in graph.reach_counts(df, most).collect()}
    want = {}
    for hub, start, _ in edges:
        seen, left = set(), {d for h, s, d in edges if (h, s) == (hub, start)}
        while left:
            seen.add(node := left.pop())
            left |= {d for h, s, d in edges if h == hub and s == node} - seen
        want[hub, start] = len(seen)
    assert got == want


def test_closed_groups_take_few_jobs(spark, sf):
    """Rounds of joins took over a hundred."""
    spark.sparkContext.setJobGroup("reached", "")
    try:
        assert catalog.QUERIES["graph_reach"](spark, sf).count() > 0
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("reached")) < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize(("most", "share"), [(2000, 200_000), (2000, 5), (4, 5), (1, 2)])
def test_marks_gathered_by_groups_equal_one_by_one(spark, monkeypatch, most, share):
    rnd = random.Random(most * share)
    names = [f"m{i}" for i in range(12)]
    structural = [("m0", "m1"), ("m4", "m5")]
    batch = [(m, rnd.sample([x for x in names if x != m], rnd.choice([1, 1, 2])) if rnd.random() < 0.7 else None) for m in rnd.choices(names, k=16)]
    batch[3:3] = [("m2", ["nobody"])]
    monkeypatch.setattr(decisions, "gathered", functools.partial(graph.gathered, most=most, share=share))
    known = test_marks.memories(spark, names, [("m1", ["m0"]), ("m5", ["m4"])])
    got = {r.line_no: r.problem for r in decisions.check_marks(test_marks.marks(spark, batch), known, spark.createDataFrame([], decisions.EVENT)).collect()}
    good = [i for i in range(len(batch)) if i != 3]
    refused = [good[i] for i in test_marks.one_by_one(structural, [], [batch[i] for i in good])]
    assert got == {i: "unknown replacement" if i == 3 else "cycle" if i in refused else None for i in range(len(batch))}


@pytest.mark.parametrize(("key", "most"), [("val_decision_mark", 120), ("sink_decision", 250)])
def test_marks_are_decided_by_few_jobs(spark, sf, key, most):
    """Rounds of joins took over five hundred for the same marks."""
    spark.sparkContext.setJobGroup("marked", "")
    try:
        assert catalog.QUERIES[key](spark, sf).count() > 0
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("marked")) < most
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_an_index_of_the_moment_holds_asked_terms_alone(spark):
    docs = spark.createDataFrame([("h", 1, "alpha beta beta gammas"), ("h", 2, "delta"), ("h", 3, None)], "hub_id string, doc_id long, text string")
    index = retrieval.index_of(docs, terms=spark.createDataFrame([("beta",), ("gamma",), ("none",)], "term string"))
    assert sorted((r.doc_id, r.term, r.tf, r.length) for r in index.postings.where("term is not null").collect()) == [(1, "beta", 2, 5), (1, "gamma", 1, 5)]
    assert {(r.doc_id, r.length) for r in index.postings.where("bucket = -1").collect()} == {(1, 5), (2, 1), (3, 0)}
