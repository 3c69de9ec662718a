"""Ranking rules, intent, tokens and budgets on hand-made corpora."""

import datetime as dt

from pyspark.sql import functions as F

from ravelog.functions import text as T
from ravelog.plans import intent as I
from ravelog.plans import retrieval as R

CUT = dt.datetime(2026, 10, 18, 11, 1, 39)
DOC = "hub_id string, doc_id long, source string, path string, day date, instant timestamp, cwd string, agent string, session_id string, role string, status string, text string, files array<string>"


def at(hours):
    return CUT - dt.timedelta(hours=hours)


def corpus(spark):
    rows = [
        (1, "session", at(2), "/projects/alpha", "a", "s1", "assistant", None, "I will write the 立项书 project charter next", []),
        (2, "session", at(0.3), "/projects/alpha", "a", "s1", "assistant", None, "The project charter 立项书 is written: [charter](docs/charter.md)", []),
        (3, "session", at(-1), "/projects/alpha", "a", "s2", "assistant", None, "future project charter 立项书 done `docs/charter.md`", []),
        (4, "session", at(0.1), "/projects/alpha", "a", "me", "user", None, "project charter 立项书", []),
        (5, "session", at(0.2), "/projects/beta", "b", "s3", "assistant", None, "unrelated noise about lunch", []),
        (6, "session", at(1), "/projects/beta", "b", "s3", "assistant", None, "project charter 立项书 for beta, completed", []),
        (7, "session", at(24), "/projects/alpha", "b", "s4", "assistant", None, "completed project charter 立项书 yesterday", ["a.md", "b.md", "c.md", "d.md"]),
        (8, "session", CUT, "/projects/alpha", "b", "s5", "assistant", None, "project charter 立项书 exactly at the cutoff", []),
    ]
    return spark.createDataFrame([("h", i, s, "p", t.date(), t, c, a, ses, r, st, x, f) for i, s, t, c, a, ses, r, st, x, f in rows], DOC)


def ask(spark, **more):
    base = {"hub_id": "h", "query_id": 1, "text": "project charter 立项书", "as_of": CUT, "cwd": "/projects/alpha"} | more
    return spark.createDataFrame([base], ", ".join(f"{k} {'timestamp' if k in ('as_of', 'ref_now') else 'long' if k in ('query_id',) else 'int' if k in ('days', 'lim') else 'double' if k == 'half_life' else 'boolean' if k in ('symmetric', 'other_agent') else 'date' if k == 'target_day' else 'string'}" for k in base))


def ranked(spark, **more):
    return R.search(corpus(spark), ask(spark, **more)).orderBy("rank").collect()


def test_delivery_first_and_cutoff_exclusive(spark):
    hits = ranked(spark)
    assert hits[0].doc_id == 2 and not {3, 8} & {h.doc_id for h in hits} and 5 not in {h.doc_id for h in hits}
    assert [a.resolved for a in hits[0].artifacts] == ["/projects/alpha/docs/charter.md"] and hits[0].delivery == "delivered"
    by = {h.doc_id: h for h in hits}
    assert by[1].delivery == "planned" and by[4].echo and by[4].explain.echo_factor == 0.2 and by[6].scope == "cross_project"
    assert by[7].explain.artifact_delivery == 0.0 and [h.doc_id for h in hits][-2:] == [6, 4]  # four listed files name none; local hits come first, echoes last


def test_filters_and_windows(spark):
    asked = [{"f_agent": "b"}, {"f_date": "2026-10-17"}, {"days": 1}, {"exclude_session": "me"}, {"text": "  "}, {"text": "zzzz"}, {}, {"cwd": "/nowhere"}]
    q = None
    for i, more in enumerate(asked):
        one = ask(spark, query_id=i, **more)
        q = one if q is None else q.unionByName(one, allowMissingColumns=True)
    hits = R.search(corpus(spark), q).collect()
    found = lambda i: {h.doc_id for h in hits if h.query_id == i}
    assert found(0) == {6, 7} and found(1) == {7} and found(2) == {1, 2, 4, 6}
    assert 4 not in found(3) and found(4) == set() == found(5)
    assert {(h.query_id, h.cwd_fallback) for h in hits if h.query_id >= 6} == {(6, False), (7, True)}


def test_time_hints(spark):
    hits = ranked(spark, kind="yesterday", half_life=1200.0, symmetric=True, target_day=dt.date(2026, 10, 17))
    by = {h.doc_id: h.explain.recency for h in hits}
    assert max(by, key=by.get) == 7


def test_index_equals_scan_and_batches(spark):
    docs = corpus(spark)
    q = ask(spark).unionByName(ask(spark, query_id=2, text="lunch noise"))
    one, two = R.search(docs, q), R.search(docs, q, index=R.index_of(docs))
    assert R.parity(one, two).count() == 0 and {r.query_id for r in one.collect()} == {1, 2}


def test_phrase_inside_a_word(spark):
    docs = spark.createDataFrame([("h", 1, "session", "p", None, None, "", "", "s", "user", None, "xcharterx only", [])], DOC)
    assert [h.doc_id for h in R.search(docs, ask(spark, text="charter", as_of=None)).collect()] == [1]


def test_tokens(spark):
    row = spark.createDataFrame([("Files: src/app.py, 检索词 classes boss A _x_",)], "t string")
    assert row.select(T.tokenize(F.col("t")).alias("x")).first().x == ["files", "file", "src/app.py", "检", "索", "词", "检索", "索词", "classes", "classe", "boss"]
    q = spark.createDataFrame([("h", 1, "检索 reports")], "hub_id string, query_id long, text string")
    got = {r.term: r.weight for r in R.query_terms(q).collect()}
    assert got["search"] == 3 and got["retrieval"] == 3 and got["报告"] == 1 and got["reports"] == 1


def test_intent():
    today = dt.date(2026, 10, 18)
    one = I.understand("你看一下刚才写的项目立项书", today)
    assert (one["clean"], one["kind"], one["artifact_request"]) == ("项目立项书", "just_now", True)
    two = I.understand("Please find the retrieval index another agent wrote yesterday", today)
    assert two["kind"] == "yesterday" and two["other_agent"] and two["target_day"] == dt.date(2026, 10, 17) and "retrieval index" in two["clean"]
    assert I.understand("10月5日 的报告", today)["target_day"] == dt.date(2026, 10, 5)
    assert I.understand("2026-13-45 report", today)["kind"] is None and I.understand(None, today)["clean"] == ""


def test_query_filters_need_a_boundary(spark):
    q = spark.createDataFrame([("agent:codex x date:2026-10-01",), ("subagent:x y",)], "text string")
    got = [(r.f_agent, r.f_date, r.rest) for r in I.query_filters(q).collect()]
    assert got == [("codex", "2026-10-01", "x"), (None, None, "subagent:x y")]


def test_artifacts(spark):
    text = "[a](docs/a.md) [b](https://x.y/b.md) `src/c.py` `name` [k](.env) [t](my_token.md) `docs/a.md#L3` [s](/h/sessions/x.md)"
    row = spark.createDataFrame([(text, ["d.txt", "id_rsa.pem"])], "text string, files array<string>")
    got = row.select(R.artifacts(F.col("text"), F.col("files"), F.lit("/w")).alias("a")).first().a
    assert [(x.resolved, x.via, x.source_ref) for x in got] == [("/w/docs/a.md", "markdown_link", False), ("/h/sessions/x.md", "markdown_link", True), ("/w/src/c.py", "backtick_path", False), ("/w/d.txt", "files_field", False)]


def test_delivery(spark):
    rows = [("not yet completed", None, "unknown"), ("已完成", None, "delivered"), ("尚未完成", None, "unknown"), ("will do", None, "planned"), ("x", "done", "delivered"), ("x", None, "unknown")]
    df = spark.createDataFrame(rows, "text string, status string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", R.delivery(F.col("status"), F.col("text"), F.lit("assistant"))).collect())


def test_redaction(spark):
    rows = ["key sk-abcdefghijklmnopqrstuvwx end", "Authorization: Bearer abcdefghijklmnop", "password = hunter2hunter2", "https://u:secretpw@h/x", "-----BEGIN RSA PRIVATE KEY-----\nabc", 'token = "0123456789abcdef0123"']
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    once = [r.x for r in df.select(T.redact(F.col("t")).alias("x")).collect()]
    assert all(T.MARK in x for x in once[:5]) and T.MARK not in once[5] and "hunter2" not in once[2] and once[3] == f"https://u:{T.MARK}@h/x"
    assert [r.x for r in df.select(T.redact(T.redact(F.col("t"))).alias("x")).collect()] == once
    assert T.MARK in df.select(T.redact(F.col("t"), strict=True).alias("x")).collect()[5].x


def test_claims(spark):
    cases = [(["测试通过", "后来失败了"], "blocked"), (["尚未完成"], "in_progress"), (["all tests passed"], "completed"), (["will be 已完成"], "in_progress"), (["未能通过"], "blocked"), ([], "in_progress"), (["done? it failed! fixed"], "completed")]
    df = spark.createDataFrame(cases, "texts array<string>, want string")
    got = df.withColumn("got", T.claimed_status(F.col("texts"))).collect()
    assert all(r.got == r.want for r in got), [(r.texts, r.want, r.got) for r in got if r.got != r.want]


def test_budget_passes_over_large_hits(spark):
    rows = spark.createDataFrame([("h", 1, 1, 100, 11), ("h", 1, 2, 500, 12), ("h", 1, 3, 50, 13)], "hub_id string, query_id long, rank int, tokens long, doc_id long")
    got = R.fit_budget(rows, 220).first()
    assert got.kept == [1, 3] and got.used == 198 and got.dropped == 1


def test_acceptance(spark):
    hits = R.search(corpus(spark), ask(spark))
    want = spark.createDataFrame([("h", 1, "p", "docs/charter.md"), ("h", 9, "p", None)], "hub_id string, query_id long, want_path string, want_artifact string")
    assert {r.query_id: r.correct for r in R.accepted(hits, want).collect()} == {1: True, 9: False}
