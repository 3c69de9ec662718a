"""A stored index gives what a scan gives; a refresh touches changed days only and can be stopped anywhere."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ravelog.functions import text as T
from ravelog.plans import retrieval as R
from ravelog.plans import stored_index as X

from test_retrieval import CUT, DOC, ask, corpus


def test_words_equal_the_column_function(spark):
    texts = ["Files: src/app.py, 检索词 classes boss A _x_ ..a.. ss gas", "", None, "一鿿 x", "--- ./: Grüße naïve", "ABC_d-e:/f.s buses", "a\tb\nccs  DDS"]
    df = spark.createDataFrame([("h", i, t) for i, t in enumerate(texts)], "hub_id string, doc_id long, text string")
    for r in df.select("doc_id", "text", T.tokenize(F.col("text")).alias("x")).collect():
        assert list(X.words(r.text or "")) == r.x
    got = {(r.doc_id, r.term): (r.tf, r.length) for r in X.posted(df).collect()}
    assert all((i, None) in got for i in range(len(texts))) and got[0, None][1] == len(list(X.words(texts[0])))


QUERIES = [
    {}, {"f_agent": "b"}, {"f_date": "2026-10-17"}, {"days": 1}, {"exclude_session": "me"}, {"as_of": None, "ref_now": CUT}, {"as_of": None, "ref_now": CUT, "exclude_session": "s1", "f_source": "session"},
    {"text": "lunch noise"}, {"text": "charter", "f_agent": "a", "exclude_session": "s1"}, {"as_of": CUT - dt.timedelta(hours=1)}, {"f_source": "memory"}, {"text": "项"}, {"text": "zzz"},
]
WIDE = {"hub_id": "string", "query_id": "long", "text": "string", "as_of": "timestamp", "ref_now": "timestamp", "cwd": "string", "f_agent": "string", "f_source": "string", "f_date": "string", "days": "int", "exclude_session": "string"}


def many(spark):
    rows = [{"hub_id": "h", "query_id": i, "text": "project charter 立项书", "as_of": CUT, "cwd": "/projects/alpha", **q} for i, q in enumerate(QUERIES)]
    return spark.createDataFrame([tuple(r.get(c) for c in WIDE) for r in rows], ", ".join(f"{c} {k}" for c, k in WIDE.items()))


def extended(spark):
    more = [("h", 20 + i, "memory" if i % 2 else "session", "p", None, None, "/projects/alpha", "a", "s9", "assistant", None, f"timeless charter note {i}", []) for i in range(3)]
    more += [("g", 40, "session", "p", CUT.date(), CUT, "/x", "a", "s", "user", None, "project charter of another hub", [])]
    return corpus(spark).union(spark.createDataFrame(more, DOC))


def by_definition(docs, q):
    """class statistics from pairs of class and document."""
    lengths = X.posted(docs).where("term is null").select("hub_id", "doc_id", "length")
    return {r.class_id: (r.n, r.average) for r in R.eligible(docs, q).join(lengths, ["hub_id", "doc_id"]).groupBy("class_id").agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("length")).alias("average")).collect()}


def test_class_statistics_from_sums(spark):
    docs, q = extended(spark), R.prepared(many(spark))
    index = R.index_of(docs)
    spans = R.class_days(q, index.sums.groupBy("hub_id").agg(F.nullif(F.max("day"), F.lit(X.NO_DAY).cast("date")).alias("__last")))
    got = {r.class_id: (r.n, r.average) for r in R.class_statistics(index, spans).collect()}
    want = by_definition(R.complete(docs, R.DOC_DEFAULTS), q)
    assert set(got) == set(want)
    assert all(got[k][0] == n and abs(got[k][1] - a) < 1e-9 for k, (n, a) in want.items())


def test_stored_equals_scan_for_every_filter(spark, tmp_path):
    docs, q, root = extended(spark), many(spark), str(tmp_path)
    R.refresh_index(docs.where("doc_id <> 2"), root)
    stale = R.search(docs.where("doc_id <> 2"), q, index=X.opened(spark, root))
    assert R.parity(R.search(docs, q), stale).count() > 0
    states = {str(r.day): r.state for r in R.refresh_index(docs, root).collect()}
    assert states == {"2026-10-17": "kept", "2026-10-18": "changed", X.NO_DAY: "kept"}
    fresh = R.search(docs, q, index=X.opened(spark, root))
    assert R.parity(R.search(docs, q), fresh).count() == 0 and fresh.count() > 20


def test_partitions_are_pruned(spark, tmp_path):
    docs, root = extended(spark), str(tmp_path)
    R.refresh_index(docs, root)
    q = R.prepared(ask(spark, days=1))
    spans = R.class_days(q, X.opened(spark, root).sums.groupBy("hub_id").agg(F.max("day").alias("__last")))
    found, _ = R.reached(X.opened(spark, root), R.query_terms(q), spans)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    filters = next(x for x in plan.split("\n") if x.startswith("PartitionFilters"))
    assert "bucket" in filters and "2026-10-18" in filters
    assert {str(r.day) for r in found.select("day").distinct().collect()} <= {"2026-10-18", X.NO_DAY}


def test_a_day_that_shrinks_leaves_nothing_behind(spark, tmp_path):
    root = str(tmp_path)
    row = lambda i, day, text: ("h", i, "session", "p", dt.date(2026, 1, day), None, "", "", "s", "user", None, text, [])
    full = spark.createDataFrame([row(1, 1, " ".join(f"word{i}" for i in range(200))), row(2, 2, "two"), row(3, 3, "three")], DOC)
    R.refresh_index(full, root, buckets=4)
    less = spark.createDataFrame([row(1, 1, "word1"), row(2, 2, "two"), row(4, 4, "four")], DOC)
    states = {r.day.day: (r.state, r.documents, r.postings) for r in R.refresh_index(less, root, buckets=4).collect()}
    assert states == {1: ("changed", 1, 1), 2: ("kept", 1, 1), 3: ("removed", 0, 0), 4: ("new", 1, 1)}
    index = X.opened(spark, root, 4)
    assert sorted(r.term for r in index.postings.where("term is not null").collect()) == ["four", "two", "word1"] == sorted(r.term for r in index.terms.collect())
    assert {r.day.day for r in X.listed(spark, root).collect()} == {1, 2, 4}
    R.refresh_index(less.limit(0), root, buckets=4)
    assert X.opened(spark, root, 4) is None


def test_stopped_before_the_list_is_published(spark, tmp_path, monkeypatch):
    docs, root = extended(spark), str(tmp_path)
    R.refresh_index(docs.where("doc_id <> 2"), root)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(X.versions, "publish", stop)
        with pytest.raises(RuntimeError):
            R.refresh_index(docs, root)
    assert {r.state for r in R.refresh_index(docs, root).collect()} == {"kept", "changed"}
    assert R.parity(R.search(docs, many(spark)), R.search(docs, many(spark), index=X.opened(spark, root))).count() == 0
