"""Registered queries over the given tables, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import activity as act
from ..operators import decisions, evidence, graph, packing, quality, reports, retention, tiers, turns
from . import adapters as A
from . import retrieval as R
from . import stored_index as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return keep


def stamp(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def day(c="day") -> F.Column:
    return F.col(c).cast("string")


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
DOC = A.table


# ---------------------------------------------------------------- scalar functions


@register("sc_clip", r"""with s as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as one from documents)
  select doc_id, case when length(one) <= 120 then one else substr(one, 1, 120) || '…' end as clipped, case when length(one) <= 120 then one else substr(one, 1, 119) || '…' end as clipped_short from s""")
def sc_clip(spark, d):
    return DOC(spark, d, "documents").select("doc_id", T.clip(F.col("text"), 120).alias("clipped"), T.clip(F.col("text"), 120, 119).alias("clipped_short"))


@register("sc_est_tokens", "select doc_id, greatest(1, (strlen(text) + 3) // 4) as tokens from documents")
def sc_est_tokens(spark, d):
    return DOC(spark, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@register("sc_redact", r"""select doc_id, regexp_replace(regexp_replace(text, '\bAKIA[A-Z0-9]{16}\b', '[redacted:credential]', 'g'), '(?i)((?:[\w.-]*(?:api[_-]?key|secret|access[_-]?token|password|passwd)|密码)\s*["'']?\s*[:=]\s*["'']?)([^\s"''`,;&<>]{8,})', '\1[redacted:credential]', 'g') as masked from documents""")
def sc_redact(spark, d):
    return DOC(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("masked"))


@register("sc_redact_strict")
def sc_redact_strict(spark, d):
    return DOC(spark, d, "documents").select("doc_id", T.redact(F.col("text"), strict=True).alias("masked"))


@register("sc_content_key", "select event_id, sha1(event_id || '|' || event_type) as key from events")
def sc_content_key(spark, d):
    return DOC(spark, d, "events").select("event_id", F.sha1(F.concat_ws("|", F.col("event_id").cast("string"), "event_type")).alias("key"))


@register("sc_month_end", "select distinct strftime(o_orderdate, '%Y-%m') as month, cast(last_day(o_orderdate) as varchar) as month_end from orders")
def sc_month_end(spark, d):
    months = A.orders(spark, d).select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    return months.select("month", ids.month_end(F.col("month")).cast("string").alias("month_end"))


@register("sc_month_days", "with m as (select distinct date_trunc('month', ts) as m from events) select strftime(m, '%Y-%m') as month, cast(cast(unnest(generate_series(m, last_day(m), interval 1 day)) as date) as varchar) as day from m")
def sc_month_days(spark, d):
    months = DOC(spark, d, "events").select(F.date_format("ts", "yyyy-MM").alias("month")).distinct()
    return months.select("month", F.explode(F.transform(ids.month_days(F.col("month")), lambda x: x.cast("string"))).alias("day"))


@register("sc_parse_ts", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as whole, strftime(ts, '%Y-%m-%d 00:00:00') as by_day, strftime(ts - interval 8 hour, '%Y-%m-%d %H:%M:%S') as offset_8 from events")
def sc_parse_ts(spark, d):
    raw = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    e = DOC(spark, d, "events")
    return e.select("event_id", stamp(ids.instant(F.concat(raw, F.lit("Z")))).alias("whole"), stamp(ids.instant(F.substring(raw, 1, 10))).alias("by_day"), stamp(ids.instant(F.concat(raw, F.lit("+08:00")))).alias("offset_8"))


@register("sc_bare_date_end", "select distinct cast(cast(ts as date) as varchar) as day, strftime(cast(ts as date) + interval 1 day - interval 1 second, '%Y-%m-%d %H:%M:%S') as cutoff from events")
def sc_bare_date_end(spark, d):
    days = DOC(spark, d, "events").select(F.to_date("ts").cast("string").alias("day")).distinct()
    return days.select("day", stamp(ids.bare_date_end(F.col("day"))).alias("cutoff"))


@register("sc_locator", "select doc_id, source || '#L' || doc_id as place, 'a.tar.gz!' || source || '#L' || doc_id as cold_place from documents")
def sc_locator(spark, d):
    x = DOC(spark, d, "documents")
    return x.select("doc_id", ids.locator(F.col("source"), F.col("doc_id")).alias("place"), ids.locator(F.lit("a.tar.gz"), F.col("doc_id"), F.col("source")).alias("cold_place"))


@register("sc_row_cost", f"""with {A.TURNS} select event_id, cast(least(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 400) + coalesce(length(tool), 0) + 80 as bigint) as cost from turns""")
def sc_row_cost(spark, d):
    return A.turns(spark, d).select("event_id", packing.row_cost(F.col("text"), F.col("tool_uses")).alias("cost"))


@register("sc_priority", f"""with {A.TURNS} select event_id, cast(case when trim(text) = '' and tool is null then 0 when role = 'assistant' and length(trim(text)) >= 80 then 4 when role = 'user' and trim(text) <> '' then 3 when tool is not null then 2 else 1 end as bigint) as priority from turns""")
def sc_priority(spark, d):
    return act.with_priority(A.turns(spark, d)).select("event_id", F.col("priority").cast("long").alias("priority"))


@register("sc_status_clause", r"""with c as (select doc_id, unnest(regexp_split_to_array(lower(text), '[.!?\n]')) as clause from documents)
  select doc_id, count(*) filter (regexp_matches(clause, '\b(?:blocked|failed|failure|timeout)\b')) as blocked, count(*) as clauses from c group by doc_id""")
def sc_status_clause(spark, d):
    c = DOC(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"[.!?\n]")).alias("clause"))
    return c.groupBy("doc_id").agg(F.count_if(T.clause_status(F.col("clause")) == "blocked").alias("blocked"), F.count("*").alias("clauses"))


@register("sc_files_regex", r"""with f as (select doc_id, unnest(regexp_extract_all(text, '(?:^|[^\w./-])((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+)', 1)) as f from documents) select doc_id, count(*) as n from f group by doc_id""")
def sc_files_regex(spark, d):
    x = DOC(spark, d, "documents").select("doc_id", F.size(F.filter(T.file_tokens(F.col("text")), lambda f: f.contains("/"))).cast("long").alias("n"))
    return x.where("n > 0")


# ---------------------------------------------------------------- tokens, statistics, ranking


@register("ret_tokenize", f"with {A.TOKENS} select doc_id, term, tf from postings")
def ret_tokenize(spark, d):
    return R.postings(A.corpus(spark, d)).select("doc_id", "term", "tf")


@register("agg_corpus_stats", f"""with {A.TOKENS}, df as (select term, count(*) as df from postings group by 1)
  select term, df, (select count(*) from documents) as n, round((select greatest(1.0, avg(length)) from lengths), 4) as average from df where df >= 2""")
def agg_corpus_stats(spark, d):
    docs = A.corpus(spark, d, dated=False)
    df = R.postings(docs).groupBy("hub_id", "term").agg(F.count("*").alias("df")).where("df >= 2")
    size = R.document_lengths(docs).groupBy("hub_id").agg(F.count("*").alias("n"), F.round(F.greatest(F.lit(1.0), F.avg("length")), 4).alias("average"))
    return df.join(F.broadcast(size), "hub_id").select("term", "df", "n", "average")


@register("ret_synonyms")
def ret_synonyms(spark, d):
    return R.query_terms(A.asked(spark, d), synonyms=True).select("query_id", "term", "weight", "strong")


@register("ret_strong_terms", f"with {A.ASKED}, {A.QUERY_TOKENS} select query_id, count(*) as strong_terms, cast(sum(weight) as bigint) as tokens from qterms group by 1")
def ret_strong_terms(spark, d):
    return R.query_terms(A.asked(spark, d), synonyms=False).where("strong").groupBy("query_id").agg(F.count("*").alias("strong_terms"), F.sum("weight").alias("tokens"))


LEXICAL = f"""{A.ASKED}, {A.QUERY_TOKENS}, {A.TOKENS}, nd as (select count(*) as n from documents), av as (select greatest(1.0, avg(length)) as a from lengths),
  df as (select term, count(*) as df from postings group by 1), strong as (select query_id, count(*) as n_strong from qterms group by 1),
  hits as (select q.query_id, p.doc_id, sum(weight * (ln((1 + n) / (1 + df)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))) as s, count(*) as hit
    from qterms q join postings p using (term) join df using (term) join lengths l on l.doc_id = p.doc_id, nd, av group by 1, 2),
  ph as (select query_id, doc_id from asked join documents on contains(lower(documents.text), lower(asked.text))),
  cand as (select coalesce(h.query_id, p.query_id) as query_id, coalesce(h.doc_id, p.doc_id) as doc_id, coalesce(s, 0.0) as s, coalesce(hit, 0) as hit, case when p.doc_id is null then 0.0 else 2.5 end as phrase
    from hits h full outer join ph p on h.query_id = p.query_id and h.doc_id = p.doc_id),
  scored as (select query_id, doc_id, s * (0.5 + 0.5 * hit / n_strong) as lexical, hit / n_strong as coverage, phrase from cand join strong using (query_id))"""


def lexical(spark, d) -> DataFrame:
    docs, q = A.corpus(spark, d, dated=False), R.prepared(A.asked(spark, d))
    return R.lexical(R.index_of(docs), q, R.phrase_hits(docs, q), synonyms=False)


@register("ret_bm25", f"with {LEXICAL} select query_id, doc_id, round(lexical, 4) as lexical from scored qualify row_number() over (partition by query_id order by round(lexical, 4) desc, doc_id) <= 20")
def ret_bm25(spark, d):
    order = Window.partitionBy("query_id").orderBy(F.desc("lexical"), "doc_id")
    rows = lexical(spark, d).select("query_id", "doc_id", F.round("lexical", 4).alias("lexical"))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n <= 20").drop("__n")


@register("ret_coverage", f"with {LEXICAL} select query_id, doc_id, round(coverage, 4) as coverage from scored where coverage >= 0.5")
def ret_coverage(spark, d):
    return lexical(spark, d).where("coverage >= 0.5").select("query_id", "doc_id", F.round("coverage", 4).alias("coverage"))


@register("ret_phrase", f"with {A.ASKED} select query_id, doc_id from asked join documents on contains(lower(documents.text), lower(asked.text))")
def ret_phrase(spark, d):
    return R.phrase_hits(A.corpus(spark, d), A.asked(spark, d).withColumn("phrase", F.col("text"))).select("query_id", "doc_id")


@register("ret_gate", f"with {LEXICAL} select query_id, count(*) as candidates, count(*) filter (phrase > 0) as with_phrase from scored group by 1")
def ret_gate(spark, d):
    return lexical(spark, d).groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("phrase_bonus") > 0).alias("with_phrase"))


@register("join_postings", f"with {A.ASKED}, {A.QUERY_TOKENS}, {A.TOKENS} select query_id, doc_id, term, tf, weight from qterms join postings using (term)")
def join_postings(spark, d):
    terms = R.query_terms(A.asked(spark, d), synonyms=False)
    return R.postings(A.corpus(spark, d)).join(terms, ["hub_id", "term"]).select("query_id", "doc_id", "term", "tf", "weight")


@register("join_stats", f"""with {A.ASKED}, {A.QUERY_TOKENS}, {A.TOKENS}, df as (select term, count(*) as df from postings group by 1)
  select query_id, term, df, round(ln((1 + (select count(*) from documents)) / (1 + df)) + 1, 4) as idf from qterms join df using (term)""")
def join_stats(spark, d):
    docs = A.corpus(spark, d)
    df = R.postings(docs).groupBy("hub_id", "term").agg(F.count("*").alias("df"))
    n = docs.groupBy("hub_id").agg(F.count("*").alias("n"))
    rows = R.query_terms(A.asked(spark, d), synonyms=False).join(df, ["hub_id", "term"]).join(n, "hub_id")
    return rows.select("query_id", "term", "df", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 4).alias("idf"))


SEARCH = f"""{LEXICAL}, full_rows as (select query_id, doc_id, source as path, lexical, coverage, phrase, lang,
    trim(regexp_replace(text, '\\s+', ' ', 'g')) as one,
    case when regexp_matches(text, '(?i)\\bdone\\b|\\bcompleted\\b|\\bcreated\\b|\\bgenerated\\b|\\bwritten\\b|\\bfinalized\\b|\\bdelivered\\b|\\bupdated\\b|\\bsaved\\b') then 'delivered'
         when regexp_matches(text, '(?i)TODO|\\bwill\\b|\\bgoing\\s+to\\b|\\bplan(?:ned|ning)?\\b|\\bnext\\b') then 'planned' else 'unknown' end as delivery
    from scored join documents using (doc_id)),
  weighed as (select *, round((lexical + phrase) * 0.7 * case when delivery = 'planned' and (coverage >= 0.5 or phrase > 0) then 0.7 else 1.0 end, 4) as score from full_rows),
  firsts as (select * from weighed qualify row_number() over (partition by query_id, path, substr(one, 1, 240) order by doc_id) = 1),
  ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from firsts)"""


def ranked(spark, d, limit=8) -> DataFrame:
    return R.search(A.corpus(spark, d, dated=False), A.asked(spark, d), limit=limit, synonyms=False)


@register("ret_search", f"with {SEARCH} select query_id, cast(rank as bigint) as rank, doc_id, score, delivery from ranked where rank <= 8")
def ret_search(spark, d):
    return ranked(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score", "delivery")


@register("topk_rank", f"with {SEARCH} select query_id, cast(rank as bigint) as rank, doc_id from ranked where rank <= 3")
def topk_rank(spark, d):
    return ranked(spark, d, 3).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id")


@register("ret_score", f"with {SEARCH} select query_id, doc_id, round(lexical, 4) as lexical, phrase, score from ranked where rank <= 8")
def ret_score(spark, d):
    return ranked(spark, d).select("query_id", "doc_id", F.round("lexical", 4).alias("lexical"), F.col("phrase_bonus").alias("phrase"), "score")


@register("ret_explain", f"with {SEARCH} select query_id, doc_id, round(lexical, 4) as lexical, phrase, 0.7 as source_weight, case when delivery = 'planned' and (coverage >= 0.5 or phrase > 0) then 0.7 else 1.0 end as planned_factor from ranked where rank <= 8")
def ret_explain(spark, d):
    e = lambda c: F.col(f"explain.{c}")
    return ranked(spark, d).select("query_id", "doc_id", e("lexical").alias("lexical"), e("phrase").alias("phrase"), e("source_weight").alias("source_weight"), e("planned_factor").alias("planned_factor"))


@register("win_dedup_hits", f"with {SEARCH} select query_id, count(*) as hits from firsts group by 1")
def win_dedup_hits(spark, d):
    rows = R.search(A.corpus(spark, d, dated=False), A.asked(spark, d), limit=1 << 30, synonyms=False)
    return rows.groupBy("query_id").agg(F.count("*").alias("hits"))


@register("ret_delivery", f"with {SEARCH} select query_id, delivery, count(*) as hits from firsts group by all")
def ret_delivery(spark, d):
    rows = R.search(A.corpus(spark, d, dated=False), A.asked(spark, d), limit=1 << 30, synonyms=False)
    return rows.groupBy("query_id", "delivery").agg(F.count("*").alias("hits"))


OLD = "doc_id % 7 <> 3"
STALE_SEARCH = re.sub(r"\bdocuments\b", "old_documents", SEARCH)


@register("ret_parity", f"""with now as (with {SEARCH} select query_id, cast(rank as bigint) as rank, doc_id, score from ranked where rank <= 8),
  then_ as (with old_documents as (select * from documents where {OLD}), {STALE_SEARCH} select query_id, cast(rank as bigint) as rank, doc_id, score from ranked where rank <= 8)
  select 'first' as side, * from (select * from now except all select * from then_) union all select 'second', * from (select * from then_ except all select * from now)""")
def ret_parity(spark, d):
    """What a search through an index that missed its last refresh gives differently from a scan."""
    docs, q, root = A.corpus(spark, d, dated=False), A.asked(spark, d), f"{graph.shared_folder(spark)}/stale-{uuid.uuid4().hex}"
    R.refresh_index(docs.where(OLD), root)
    stale = R.search(docs.where(OLD), q, synonyms=False, index=X.opened(spark, root))
    rows = R.parity(R.search(docs, q, synonyms=False), stale)
    return rows.select("side", "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@register("ret_indexed", f"with {SEARCH} select query_id, cast(rank as bigint) as rank, doc_id, score from ranked where rank <= 8")
def ret_indexed(spark, d):
    """Search through a stored index that was built without the newest rows and refreshed since."""
    docs, q, root = A.corpus(spark, d, dated=False), A.asked(spark, d), f"{graph.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    R.refresh_index(docs.where(OLD), root)
    R.refresh_index(docs, root)
    return R.search(docs, q, synonyms=False, index=X.opened(spark, root)).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def recency_rows(spark, d, kind, half_life=None, symmetric=None) -> DataFrame:
    e = A.activity(spark, d).select("event_id", F.col("ts").alias("instant"), "day")
    e = e.withColumns({"ref_now": A.instant(A.NOW), "kind": F.lit(kind), "half_life": F.lit(half_life).cast("double"), "symmetric": F.lit(symmetric).cast("boolean"), "target_day": F.lit("2024-01-15").cast("date")})
    return e.select("event_id", F.round(R.recency(F.col("instant"), F.col("day"))["score"], 4).alias("score"))


AGE = "(epoch_us(timestamp '2024-01-30 23:58:00') - epoch_us(cast(ts as timestamp))) / 60000000.0"


@register("ret_recency", f"""select cast(event_id as varchar) as event_id, round(8.0 * pow(0.5, greatest(0.0, {AGE}) / 1440.0), 4) as forward, round(8.0 * pow(0.5, abs(epoch_us(cast(ts as timestamp)) - epoch_us(timestamp '2024-01-15 12:00:00')) / 60000000.0 / 1200.0), 4) as around,
  round(0.5 * greatest(0.0, 1 - greatest(0.0, {AGE}) / 1440.0 / 30.0), 4) as plain from events""")
def ret_recency(spark, d):
    rows = [recency_rows(spark, d, *a).withColumnRenamed("score", n) for n, a in (("forward", ("last", 1440.0, False)), ("around", ("yesterday", 1200.0, True)), ("plain", (None,)))]
    return rows[0].join(rows[1], "event_id").join(rows[2], "event_id")


@register("ret_scope", f"""with {A.ASKED}, x as (select query_id, doc_id, source = 'src' || (query_id % 20) as same_cwd, lang = 'en' as same_agent from asked join documents on contains(lower(documents.text), lower(asked.text)))
  select query_id, doc_id, case when same_cwd then 'cwd' else 'cross_project' end as scope, case when same_cwd then 3.0 else 0.0 end + case when same_agent then 1.0 else 0.0 end as bonus from x""")
def ret_scope(spark, d):
    """Scope of every document that holds a phrase, copies of a text included (a search shows the first copy of a path alone)."""
    q = A.asked(spark, d).withColumns({"phrase": F.col("text"), "cwd": F.concat(F.lit("src"), F.col("query_id") % 20), "agent": F.lit("en")})
    docs = R.complete(A.corpus(spark, d, dated=False), R.DOC_DEFAULTS)
    own = docs.select("hub_id", "doc_id", F.col("cwd").alias("d_cwd"), F.col("agent").alias("d_agent"), F.col("session_id").alias("d_session"))
    rows = R.phrase_hits(R.spread(docs), q).join(R.complete(q, R.QUERY_DEFAULTS), ["hub_id", "query_id"]).join(own, ["hub_id", "doc_id"])
    return R.scoped(rows).select("query_id", "doc_id", "scope", F.col("scope_bonus").alias("bonus"))


@register("join_scope_fallback", f"""with {SEARCH}, c as (select r.query_id, r.doc_id, r.path, coverage, score from ranked r), s as (select *, path = 'src' || (query_id % 20) as own, round(score + case when path = 'src' || (query_id % 20) then 3.0 * 0.7 * case when delivery = 'planned' and (coverage >= 0.5 or phrase > 0) then 0.7 else 1.0 end else 0.0 end, 3) as total from (select r.*, 1 as one_ from ranked r)),
  k as (select query_id, own from s qualify row_number() over (partition by query_id order by not (own and coverage >= 0.5), total desc, doc_id) <= 8)
  select query_id, not bool_or(own) as cwd_fallback from k group by 1""")
def join_scope_fallback(spark, d):
    q = A.asked(spark, d).withColumn("cwd", F.concat(F.lit("src"), F.col("query_id") % 20))
    return R.search(A.corpus(spark, d, dated=False), q, limit=8, synonyms=False).groupBy("query_id").agg(F.max("cwd_fallback").alias("cwd_fallback"))


LINKED = "concat(text, ' [r](', source, '/r', doc_id % 5, case doc_id % 3 when 0 then '.md' when 1 then '.exe' else '.py#x' end, ') `notes/', source, '.txt`')"
LINKED_SQL = "case doc_id % 3 when 0 then '/w/' || source || '/r' || (doc_id % 5) || '.md,' when 1 then '' else '/w/' || source || '/r' || (doc_id % 5) || '.py,' end || '/w/notes/' || source || '.txt'"


def linked(spark, d) -> DataFrame:
    """Documents whose texts end with a link and a ticked path that depend on their fields."""
    x = DOC(spark, d, "documents").selectExpr("doc_id", f"{LINKED} as text")
    return x.withColumn("artifacts", R.artifacts(F.col("text"), F.array().cast("array<string>"), F.lit("/w")))


@register("ret_artifacts", f"select doc_id, {LINKED_SQL} as paths from documents")
def ret_artifacts(spark, d):
    return linked(spark, d).select("doc_id", F.array_join(F.transform("artifacts", lambda a: a["resolved"]), ",").alias("paths"))


@register("flt_artifact", "select doc_id, case when doc_id % 3 = 1 then 1 else 2 end as kept from documents")
def flt_artifact(spark, d):
    return linked(spark, d).select("doc_id", F.size("artifacts").alias("kept"))


@register("ret_named_artifact", "select doc_id from documents")
def ret_named_artifact(spark, d):
    return linked(spark, d).where(R.names_artifact(F.col("artifacts"))).select("doc_id")


@register("ret_delivery_score", "select doc_id, case when doc_id % 2 = 0 then 9.0 else 2.0 end as bonus from documents")
def ret_delivery_score(spark, d):
    x = linked(spark, d).withColumn("delivery", R.delivery(F.when(F.col("doc_id") % 2 == 0, "completed"), F.lit("x"), F.lit("assistant")))
    named = R.names_artifact(F.col("artifacts"))
    return x.select("doc_id", (F.when(named, R.ARTIFACT).otherwise(0.0) + F.when(named & (F.col("delivery") == "delivered"), R.DELIVERED).otherwise(0.0)).alias("bonus"))


@register("ret_echo", f"with {A.TURNS}, q as (select trim(regexp_replace(text, '\\s+', ' ', 'g')) as one from turns where role = 'user') select event_id from turns where role = 'user' and trim(regexp_replace(text, '\\s+', ' ', 'g')) in (select one from q where one <> '')")
def ret_echo(spark, d):
    t = A.turns(spark, d)
    q = t.where("role = 'user'").select(T.squeeze(F.col("text")).alias("one")).where("one <> ''").distinct()
    rows = t.withColumn("one", T.squeeze(F.col("text"))).join(q, "one")
    return rows.where(R.is_echo(F.col("role"), F.lit("session"), F.sha1("one"), F.col("one"))).select("event_id")


@register("ret_sufficiency", f"with {SEARCH} select query_id, case when delivery = 'planned' then 'thin' when coverage >= 0.65 then 'sufficient' else 'thin' end as sufficiency from ranked where rank = 1")
def ret_sufficiency(spark, d):
    top = ranked(spark, d).where("rank = 1").withColumn("artifact_request", F.lit(False))
    return R.sufficiency(top).select("query_id", "sufficiency")


@register("ret_route_hint", "select doc_id, regexp_matches(text, '(?i)yesterday|recent|earlier|last week|today|another (?:agent|session)') as hint from documents")
def ret_route_hint(spark, d):
    from .intent import refers_to_earlier_work

    return DOC(spark, d, "documents").select("doc_id", refers_to_earlier_work(F.col("text")).alias("hint"))


@register("ret_intent")
def ret_intent(spark, d):
    from .intent import with_intent

    q = with_intent(A.asked(spark, d).withColumn("ref_day", F.lit("2024-01-30").cast("date")))
    return q.select("query_id", "intent.clean", "intent.kind", "intent.other_agent", "intent.artifact_request")


@register("flt_query_terms", f"with {A.ASKED} select query_id, 'en' as f_agent, 'src' || (query_id % 20) as f_source, trim(regexp_replace(text, ' $', '')) as rest from asked")
def flt_query_terms(spark, d):
    from .intent import query_filters

    q = A.asked(spark, d).withColumn("text", F.concat(F.lit("agent:en source:src"), (F.col("query_id") % 20).cast("string"), F.lit(" "), F.col("text")))
    return query_filters(q).select("query_id", "f_agent", "f_source", F.trim(F.regexp_replace("rest", "^ +", "")).alias("rest"))


@register("flt_doc_meta", f"with {A.ASKED} select query_id, count(*) as eligible from asked join documents on lang = 'en' and source = 'src' || (query_id % 20) group by 1")
def flt_doc_meta(spark, d):
    q = A.asked(spark, d).withColumns({"f_agent": F.lit("en"), "f_source": F.concat(F.lit("src"), F.col("query_id") % 20)})
    docs = R.complete(A.corpus(spark, d, dated=False).withColumn("source", F.col("path")), R.DOC_DEFAULTS)
    q = R.prepared(q)
    return R.eligible(docs, q).join(q.select("hub_id", "query_id", "class_id"), ["hub_id", "class_id"]).groupBy("query_id").agg(F.count("*").alias("eligible"))


@register("ret_payload")
def ret_payload(spark, d):
    requests = A.literal(spark, [("h0", "daily", "2024-01-02", "pending"), ("h0", "daily", "2024-01-01", "done")], "hub_id string, kind string, period string, status string")
    return R.payload(ranked(spark, d), requests, 800).select("query_id", F.size("kept").alias("kept"), "used", "dropped", "sufficiency", "pending_total")


PACKED = f"""{SEARCH}, line as (select query_id, doc_id, rank, substr(one, 1, 240) as line, path from ranked where rank <= 8)"""


@register("prj_compact_hit", f"with {PACKED} select query_id, cast(rank as bigint) as rank, path as locator, length(line) as line_chars from line")
def prj_compact_hit(spark, d):
    return R.compact(ranked(spark, d)).select("query_id", F.col("rank").cast("long").alias("rank"), "locator", F.length("line").cast("long").alias("line_chars"))


@register("pack_budget")
def pack_budget(spark, d):
    return R.fit_budget(R.compact(ranked(spark, d)), 400).select("query_id", F.array_join("kept", ",").alias("kept"), "used", "dropped")


@register("prj_record_text", "select doc_id, text || ' ' || source || ' ' || lang as text from documents")
def prj_record_text(spark, d):
    x = DOC(spark, d, "documents")
    return x.select("doc_id", R.record_text({"text": F.col("text"), "cwd": F.col("source"), "agent": F.col("lang")}).alias("text"))


@register("src_corpus", """select 'session' as source, count(*) as documents, count(distinct source) as paths from documents union all select 'report', count(*), count(distinct url) from pages union all select 'memory', count(*), count(distinct item_id) from benchmark""")
def src_corpus(spark, d):
    session = A.corpus(spark, d).drop("source")
    report = DOC(spark, d, "pages").selectExpr("'h0' as hub_id", "page_id as doc_id", "url as path", "html as text")
    memory = DOC(spark, d, "benchmark").selectExpr("'h0' as hub_id", "item_id as doc_id", "cast(item_id as string) as path", "text")
    return R.corpus(spark, session=session, report=report, memory=memory).groupBy("source").agg(F.count("*").alias("documents"), F.count_distinct("path").alias("paths"))


BEFORE = "doc_id % 600 <> 7 and doc_id % 60 <> 3"
AFTER = "doc_id % 60 <> 5"
DAYS = """p as (select doc_id % 60 as k, doc_id, term, tf from postings right join documents using (doc_id)),
  sizes as (select k, count(distinct doc_id) as documents, count(term) as postings, cast(coalesce(sum(tf), 0) as bigint) as tokens from p where k <> 5 group by 1),
  moves as (select doc_id % 60 as k, case when doc_id % 60 = 3 then 'new' when doc_id % 60 = 5 then 'removed' when bool_or(doc_id % 600 = 7) then 'changed' else 'kept' end as state from documents group by 1)"""


def refreshed(spark, d) -> tuple[DataFrame, str]:
    """An index of the corpus as it was, brought up to what it is: one day is new, one is gone, some have grown."""
    docs, root = A.corpus(spark, d), f"{graph.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    R.refresh_index(docs.where(BEFORE), root)
    return R.refresh_index(docs.where(AFTER), root), root


@register("sink_index_refresh", f"""with {A.TOKENS}, {DAYS} select cast(date '2024-01-01' + cast(k as integer) as varchar) as day, state, coalesce(documents, 0) as documents, coalesce(postings, 0) as postings, coalesce(tokens, 0) as tokens from moves left join sizes using (k)""")
def sink_index_refresh(spark, d):
    return refreshed(spark, d)[0].select(day().alias("day"), "state", "documents", "postings", "tokens")


@register("agg_index_status", f"""with {A.TOKENS}, pd as (select date '2024-01-01' + cast(doc_id % 60 as integer) as day, * from postings join lengths using (doc_id) where doc_id % 60 <> 5)
  select cast(day as varchar) as day, term, count(*) as df, cast(sum(tf) as bigint) as tf, cast(sum(length) as bigint) as lengths from pd group by all""")
def agg_index_status(spark, d):
    """The stored postings after a refresh, by day and term: read back, beside the frequencies that the index keeps of them."""
    index = X.opened(spark, refreshed(spark, d)[1])
    rows = index.postings.where("term is not null").groupBy("day", "term").agg(F.sum("tf").alias("tf"), F.sum("length").alias("lengths"))
    return rows.join(index.terms.groupBy("day", "term").agg(F.sum("df").alias("df")), ["day", "term"], "full_outer").select(day().alias("day"), "term", "df", "tf", "lengths")


# ---------------------------------------------------------------- filters


@register("flt_noise", "select doc_id from documents where trim(text) <> '' and not contains(lower(text), '<heartbeat>')")
def flt_noise(spark, d):
    return DOC(spark, d, "documents").where(T.useful(F.col("text")) != "").select("doc_id")


SAID = """said as (select event_id, case (conv_no + line_no) % 8 when 1 then '<system-reminder> ' || text when 2 then '<environment_context x=1>' || text when 3 then left(text, 50) || ' [Tool_Output] ' || text
    when 4 then chr(13312) || chr(40959) when 5 then left(text, 2) when 6 then text || ' <app-context>' else text end as text from (select *, cast(session_id as bigint) as conv_no from turns) where role = 'user')"""


@register("flt_intent", f"""with {A.TURNS}, {SAID}, t as (select event_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from said), h as (select event_id, t, lower(substr(t, 1, 200)) as h from t)
  select event_id, substr(t, 1, 200) as intent from h where (length(t) >= 3 or len(regexp_extract_all(t, '[\\x{{3400}}-\\x{{9FFF}}]')) >= 2) and not (contains(h, '<environment_context') or contains(h, '<app-context') or contains(h, '# agents.md instructions')
    or contains(h, '<collaboration_mode') or contains(h, '<heartbeat') or contains(h, '<system-reminder') or contains(h, '[tool_output]') or contains(h, '[tool_result]'))""")
def flt_intent(spark, d):
    """Every user turn, most of them with injected marks, marks beyond the first 200 characters, or too short."""
    said = """case (cast(session_id as bigint) + line_no) % 8 when 1 then concat('<system-reminder> ', text) when 2 then concat('<environment_context x=1>', text) when 3 then concat(left(text, 50), ' [Tool_Output] ', text)
      when 4 then '\u3400\u9fff' when 5 then left(text, 2) when 6 then concat(text, ' <app-context>') else text end"""
    rows = A.turns(spark, d).where("role = 'user'").select("event_id", T.intent(F.expr(said)).alias("intent"))
    return rows.where("intent <> ''")


@register("flt_visible", f"with {A.TURNS} select event_id from turns where role in ('user', 'assistant') and trim(text) <> ''")
def flt_visible(spark, d):
    return A.turns(spark, d).where("role in ('user', 'assistant') and trim(text) <> ''").select("event_id")


@register("flt_roles_reportable", f"with {A.TURNS} select event_id from turns where role not in ('system', 'developer')")
def flt_roles_reportable(spark, d):
    return A.turns(spark, d).where("role not in ('system', 'developer')").select("event_id")


@register("flt_range", "select cast(event_id as varchar) as event_id from events where ts between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-12 12:00:00'")
def flt_range(spark, d):
    e = A.activity(spark, d)
    return e.where(F.col("ts").between(A.instant("2024-01-10 00:00:00"), A.instant("2024-01-12 12:00:00"))).select("event_id")


@register("flt_cwd_prefix", f"with {A.ACTIVITY} select event_id from activity where starts_with(cwd, '/p/1')")
def flt_cwd_prefix(spark, d):
    return A.activity(spark, d).where(F.col("cwd").startswith("/p/1")).select("event_id")


@register("flt_window_days", f"with {A.ACTIVITY} select event_id from activity where day >= date '2024-01-30' - 6")
def flt_window_days(spark, d):
    return A.activity(spark, d).where(F.col("day") >= F.date_sub(F.lit("2024-01-30").cast("date"), 6)).select("event_id")


@register("flt_as_of", f"with {A.ASKED} select query_id, count(*) as eligible from asked join documents on date '2024-01-01' + cast(doc_id % 60 as integer) >= (date '2024-02-10' + cast(query_id % 5 as integer)) - 29 and date '2024-01-01' + cast(doc_id % 60 as integer) < date '2024-02-10' + cast(query_id % 5 as integer) group by 1")
def flt_as_of(spark, d):
    at = F.to_timestamp(F.date_add(F.lit("2024-02-10").cast("date"), (F.col("query_id") % 5).cast("int")))
    q = R.prepared(A.asked(spark, d).withColumn("as_of", at))
    docs = R.complete(A.corpus(spark, d), R.DOC_DEFAULTS)
    return R.eligible(docs, q).join(q.select("hub_id", "query_id", "class_id"), ["hub_id", "class_id"]).groupBy("query_id").agg(F.count("*").alias("eligible"))


@register("flt_archivable", "select distinct strftime(o_orderdate, '%Y-%m') as month from orders where last_day(o_orderdate) + 7 < date '1998-03-08' and strftime(o_orderdate, '%Y-%m') < '1998-03'")
def flt_archivable(spark, d):
    months = A.orders(spark, d).select(F.lit("h0").alias("hub_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    return tiers.archivable(months, F.lit("1998-03-08").cast("date")).select("month")


# ---------------------------------------------------------------- activity


@register("agg_contrib", f"""with {A.ACTIVITY}, s as (select hub_id, session_id, agent || ':' || model as agent_model, sum(tokens_out) as tokens from activity group by all)
  select hub_id, session_id, agent_model, cast(tokens as bigint) as tokens, round(tokens / sum(tokens) over (partition by hub_id, session_id), 4) as share from s""")
def agg_contrib(spark, d):
    return act.contribution(A.activity(spark, d)).select("hub_id", "session_id", "agent_model", "tokens", "share")


@register("agg_contrib_month", f"with {A.ACTIVITY} select hub_id, strftime(day, '%Y-%m') as month, agent, cast(sum(tokens_out) as bigint) as tokens, count(distinct day) as days from activity group by all")
def agg_contrib_month(spark, d):
    return act.contribution_by_month(A.activity(spark, d))


@register("agg_activity", f"with {A.ACTIVITY} select hub_id, cwd, count(distinct session_id) as sessions, count(*) as messages, cast(sum(tokens_out) as bigint) as tokens, {STAMP.format('min(ts)')} as first_ts, {STAMP.format('max(ts)')} as last_ts from activity group by all")
def agg_activity(spark, d):
    return act.activity(A.activity(spark, d)).select("hub_id", "cwd", "sessions", "messages", "tokens", stamp("first_ts").alias("first_ts"), stamp("last_ts").alias("last_ts"))


@register("agg_share", f"""with {A.ACTIVITY}, s as (select hub_id, cwd, agent || ':' || model as agent_model, cast(sum(tokens_out) as bigint) as tokens, count(*) as messages from activity group by all)
  select *, round(100.0 * tokens / sum(tokens) over (partition by hub_id, cwd), 1) as percent from s""")
def agg_share(spark, d):
    return act.agent_share(A.activity(spark, d))


@register("agg_top_tools", f"""with {A.TURNS}, s as (select hub_id, cwd, tool, count(*) as uses, min((ts, session_id, line_no)) as seen from turns where tool is not null group by all)
  select hub_id, cwd, tool, uses, row_number() over (partition by hub_id, cwd order by uses desc, seen, tool) as rank from s qualify rank <= 6""")
def agg_top_tools(spark, d):
    return act.top_tools(A.turns(spark, d)).select("hub_id", "cwd", "tool", "uses", F.col("rank").cast("long").alias("rank"))


@register("lim_recent_prompts", f"with {A.TURNS} select hub_id, cwd, session_id, row_number() over (partition by hub_id, cwd order by ts, session_id, line_no) as rank from turns where role = 'user' and trim(text) <> '' qualify rank <= 3")
def lim_recent_prompts(spark, d):
    return act.recent_prompts(A.turns(spark, d)).select("hub_id", "cwd", "session_id", F.col("rank").cast("long").alias("rank"))


@register("agg_live_index", f"with {A.ACTIVITY} select hub_id, session_id, arg_max(agent, (ts, line_no)) as agent, arg_max(cwd, (ts, line_no)) as cwd, {STAMP.format('min(ts)')} as started_at, {STAMP.format('max(ts)')} as last_activity, count(*) as message_count from activity group by all")
def agg_live_index(spark, d):
    return act.live_index(A.activity(spark, d)).select("hub_id", "session_id", "agent", "cwd", stamp("started_at").alias("started_at"), stamp("last_activity").alias("last_activity"), "message_count")


@register("str_status_timer", f"with {A.ACTIVITY}, s as (select hub_id, session_id, epoch(timestamp '2024-01-30 23:58:00') - epoch(max(ts)) as silent from activity group by all) select hub_id, session_id, case when silent < 300 then 'active' when silent < 1800 then 'idle' else 'stale' end as status from s")
def str_status_timer(spark, d):
    return retention.with_status(act.live_index(A.activity(spark, d)), A.instant(A.NOW)).select("hub_id", "session_id", "status")


@register("sort_live", f"with {A.ACTIVITY} select hub_id, session_id, {STAMP.format('max(ts)')} as last_activity from activity group by all order by max(ts) desc, hub_id, session_id")
def sort_live(spark, d):
    return retention.by_activity(act.live_index(A.activity(spark, d))).select("hub_id", "session_id", stamp("last_activity").alias("last_activity"))


@register("win_recent_turns", f"with {A.TURNS} select hub_id, session_id, event_id, row_number() over (partition by hub_id, session_id order by ts desc, line_no desc) as rank from turns qualify rank <= 20")
def win_recent_turns(spark, d):
    return act.recent_turns(A.turns(spark, d)).select("hub_id", "session_id", "event_id", F.col("rank").cast("long").alias("rank"))


@register("sink_live_snapshot", f"""with {A.TURNS}, r as (select *, row_number() over (partition by hub_id, session_id order by ts desc, line_no desc) as rank from turns qualify rank <= 20)
  select hub_id, session_id, string_agg('[' || role || '] ' || substr(text, 1, 800), chr(10) order by rank desc) as body, count(*) as turns from r where role in ('user', 'assistant') and trim(text) <> '' group by all""")
def sink_live_snapshot(spark, d):
    return act.live_snapshot(A.turns(spark, d))


@register("agg_convo_header", f"with {A.TURNS} select hub_id, cast(day as varchar) as day, count(distinct session_id) as sessions, count(*) filter (role = 'user') as user_messages, count(*) filter (role = 'assistant') as assistant_messages from (select distinct hub_id, day, session_id, event_id, role, text from turns where role in ('user', 'assistant') and trim(text) <> '') group by 1, 2")
def agg_convo_header(spark, d):
    return act.conversation_header(A.turns(spark, d)).withColumn("day", day())


@register("sink_conversations", f"""with {A.TURNS}, s as (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as one from turns where role in ('user', 'assistant') and trim(text) <> '')
  select hub_id, cast(day as varchar) as day, session_id, string_agg('**' || role || '**: ' || case when length(one) <= 400 then one else substr(one, 1, 400) || '…' end, chr(10) order by ts, line_no) as body, count(*) as messages from s group by 1, 2, 3""")
def sink_conversations(spark, d):
    return act.conversations(A.turns(spark, d)).withColumn("day", day())


@register("agg_agent_sections", f"with {A.TURNS} select hub_id, cast(day as varchar) as day, agent, count(distinct session_id) as sessions, string_agg(distinct model, ',' order by model) as models, {STAMP.format('min(ts)')} as first_ts from turns group by 1, 2, 3")
def agg_agent_sections(spark, d):
    return act.agent_sections(A.turns(spark, d)).select("hub_id", day().alias("day"), "agent", "sessions", F.array_join("models", ",").alias("models"), stamp("first_ts").alias("first_ts"))


@register("win_priority_top", f"""with {A.TURNS}, p as (select *, case when trim(text) = '' and tool is null then 0 when role = 'assistant' and length(trim(text)) >= 80 then 4 when role = 'user' and trim(text) <> '' then 3 when tool is not null then 2 else 1 end as priority from turns where role not in ('system', 'developer'))
  select hub_id, cast(day as varchar) as day, agent, event_id, row_number() over (partition by hub_id, day, agent order by priority desc, ts, session_id, line_no) as rank from p where priority > 0 qualify rank <= 10""")
def win_priority_top(spark, d):
    rows = act.with_priority(A.turns(spark, d).where("role not in ('system', 'developer')")).where("priority > 0")
    order = Window.partitionBy("hub_id", "day", "agent").orderBy(F.desc("priority"), "ts", "session_id", "line_no")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 10").select("hub_id", day().alias("day"), "agent", "event_id", "rank")


@register("win_intent", f"""with {A.TURNS}, u as (select *, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) as said from turns where role = 'user' and length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 3)
  select hub_id, session_id, arg_min(said, (ts, line_no)) as intent, arg_max(said, (ts, line_no)) as last_user from u group by all""")
def win_intent(spark, d):
    return act.live_index(A.turns(spark, d)).where("intent is not null").select("hub_id", "session_id", "intent", "last_user")


@register("win_anchors", f"""with {A.TURNS} select hub_id, cast(day as varchar) as day, agent, session_id, arg_min(event_id, (ts, line_no)) filter (role = 'user' and trim(text) <> '') as goal_event,
  arg_max(event_id, (ts, line_no)) filter (role = 'assistant' and length(trim(text)) >= 80) as outcome_event from turns group by 1, 2, 3, 4""")
def win_anchors(spark, d):
    return turns.anchors(A.turns(spark, d)).withColumn("day", day())


@register("win_representative", f"""with {A.TURNS}, r as (select hub_id, session_id, event_id, row_number() over (partition by hub_id, session_id order by line_no) - 1 as rn, count(*) over (partition by hub_id, session_id) as n from turns)
  select hub_id, session_id, event_id from r where n <= 5 or rn in (select round_even(i * (n - 1) / 4.0, 0) from range(5) t(i))""")
def win_representative(spark, d):
    return turns.representative(A.turns(spark, d), ["hub_id", "session_id"], ["line_no"], 5).select("hub_id", "session_id", "event_id")


EXCHANGE = f"""{A.TURNS}, n as (select *, row_number() over (partition by hub_id, session_id order by ts, line_no) as rn from turns),
  a as (select *, coalesce(last_value(case when role = 'user' then rn end ignore nulls) over (partition by hub_id, session_id order by rn rows unbounded preceding), rn) as asked from n),
  t as (select hub_id, session_id, event_id as anchor, asked as start, rn as target from a where role = 'assistant'),
  x as (select a.hub_id, a.session_id, t.anchor, a.event_id, a.rn, a.role, a.text, a.rn = t.target as is_anchor from a join t on a.hub_id = t.hub_id and a.session_id = t.session_id where a.rn between t.start and t.target + 3)"""


def exchanges(spark, d) -> DataFrame:
    e = A.turns(spark, d)
    return turns.exchange(e, e.where("role = 'assistant'").select("hub_id", "session_id", "event_id"))


@register("win_exchange", f"with {EXCHANGE} select hub_id, session_id, anchor, event_id, is_anchor from x")
def win_exchange(spark, d):
    return exchanges(spark, d).select("hub_id", "session_id", "anchor", "event_id", "is_anchor")


@register("ret_read", f"""with {EXCHANGE}, s as (select anchor, event_id, is_anchor, substr(text, 1, 216) as shown from x where is_anchor or (role in ('user', 'assistant') and trim(text) <> ''))
  select anchor, count(*) as candidates, 60 + max(case when is_anchor then greatest(1, (strlen(shown) + 3) // 4) end) > 800 as refused from s group by 1""")
def ret_read(spark, d):
    return R.bounded_exchange(exchanges(spark, d), 1000).select("anchor", "candidates", "refused")


@register("pack_exchange")
def pack_exchange(spark, d):
    return R.bounded_exchange(exchanges(spark, d), 500).select("anchor", F.array_join("kept", ",").alias("kept"), "used", "refused")


@register("win_round_robin", f"""with {A.TURNS}, p as (select *, case when trim(text) = '' and tool is null then 0 when role = 'assistant' and length(trim(text)) >= 80 then 4 when role = 'user' and trim(text) <> '' then 3 when tool is not null then 2 else 1 end as priority from turns where role not in ('system', 'developer')),
  q as (select *, min((ts, line_no, session_id)) over (partition by hub_id, day, agent, session_id) as f, row_number() over (partition by hub_id, day, agent, session_id order by priority desc, ts, line_no) as pass from p)
  select event_id, pass, row_number() over (partition by hub_id, day order by pass, f, agent, session_id) as turn_order from q""")
def win_round_robin(spark, d):
    return turns.round_robin(A.turns(spark, d)).select("event_id", F.col("pass").cast("long").alias("pass"), F.col("turn_order").cast("long").alias("turn_order"))


# ---------------------------------------------------------------- tiers


DUPS = f"""{A.TIER_ROWS}, k as (select *, sha1(raw) as dg, case tier when 'hot' then 0 else 1 end as ti, tier || '/' || cast(day as varchar) || '/' || file || '#L' || line_no as place from tiers),
  w as (select *, row_number() over (partition by hub_id, day, file, event_id, dg order by ti, line_no) as nth, first_value(dg) over (partition by hub_id, day, file, event_id order by ti, line_no) as fd, first_value(place) over (partition by hub_id, day, file, event_id order by ti, line_no) as fp from k),
  marked as (select *, nth > 1 as dup, case when nth = 1 and fd <> dg then fp end as conflict_of from w)"""


@register("win_dup_conflict", f"with {DUPS} select event_id, tier, dup, conflict_of from marked")
def win_dup_conflict(spark, d):
    return tiers.duplicates_and_conflicts(A.tier_rows(spark, d)).select("event_id", "tier", "dup", "conflict_of")


@register("set_merge_distinct", f"with {DUPS} select event_id, tier, sha1(raw) as content from marked where not dup")
def set_merge_distinct(spark, d):
    return tiers.merged(A.tier_rows(spark, d)).select("event_id", "tier", F.sha1("raw").alias("content"))


@register("join_hot_cold", f"with {DUPS} select hub_id, cast(day as varchar) as day, count(*) filter (tier = 'hot') as hot, count(*) filter (tier = 'cold' and not dup) as cold_only, count(conflict_of) as conflicts from marked group by 1, 2")
def join_hot_cold(spark, d):
    rows = tiers.duplicates_and_conflicts(A.tier_rows(spark, d))
    return rows.groupBy("hub_id", day().alias("day")).agg(F.count_if(F.col("tier") == "hot").alias("hot"), F.count_if((F.col("tier") == "cold") & ~F.col("dup")).alias("cold_only"), F.count("conflict_of").alias("conflicts"))


@register("set_days", f"with {A.TIER_ROWS} select hub_id, cast(day as varchar) as day, bool_or(tier = 'hot') as is_hot, bool_or(tier = 'cold') as is_cold from tiers group by 1, 2")
def set_days(spark, d):
    return tiers.days(A.tier_rows(spark, d)).withColumn("day", day())


@register("join_day_exists", f"with {A.TIER_ROWS} select distinct cast(cast(ts as date) as varchar) as day from events where cast(ts as date) in (select day from tiers where tier = 'cold')")
def join_day_exists(spark, d):
    cold = tiers.days(A.tier_rows(spark, d)).where("is_cold").select("day").distinct()
    return A.activity(spark, d).select("day").distinct().join(cold, "day", "left_semi").select(day().alias("day"))


MERGE = f"""{A.TIER_ROWS}, old as (select * from tiers where tier = 'cold'), arr as (select * from tiers where tier = 'hot'),
  fresh as (select * from arr a where not exists (select 1 from old o where o.hub_id = a.hub_id and o.day = a.day and o.file = a.file and o.raw = a.raw) qualify row_number() over (partition by hub_id, day, file, raw order by line_no) = 1),
  named as (select hub_id, day, file, event_id, raw from old union all select hub_id, day, file, event_id, raw from fresh),
  clash as (select distinct hub_id, day, file from (select hub_id, day, file, event_id from named group by all having count(distinct raw) > 1)),
  tops as (select hub_id, day, file, max(line_no) as top from old group by all),
  merged as (select f.*, c.hub_id is not null as clash, case when c.hub_id is not null then f.line_no else coalesce(top, 0) + row_number() over (partition by f.hub_id, f.day, f.file order by f.line_no) end as new_no
    from fresh f left join clash c on c.hub_id = f.hub_id and c.day = f.day and c.file = f.file left join tops t on t.hub_id = f.hub_id and t.day = f.day and t.file = f.file)"""


def arriving(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = A.tier_rows(spark, d)
    return rows.where("tier = 'cold'"), rows.where("tier = 'hot'")


@register("set_prefix_merge", f"with {MERGE} select event_id, line_no, 'archived' as state from old union all select event_id, new_no, case when clash then 'conflict' else 'appended' end from merged")
def set_prefix_merge(spark, d):
    return tiers.prefix_merge(*arriving(spark, d)).select("event_id", "line_no", "state")


@register("set_conflict_days", f"with {MERGE} select hub_id, cast(day as varchar) as day, file from clash")
def set_conflict_days(spark, d):
    return tiers.conflict_days(*arriving(spark, d)).withColumn("day", day())


@register("agg_fingerprint", """with h as (select source, sha256(doc_id || '|' || text) as h from documents), b as (select source, ('0x' || substr(h, 1, 8))::bigint % 64 as b, sha256(string_agg(h, '' order by h)) as h, count(*) as n from h group by all)
  select source, sha256(string_agg(h, '' order by b)) as fingerprint, cast(sum(n) as bigint) as rows from b group by 1""")
def agg_fingerprint(spark, d):
    x = DOC(spark, d, "documents").select("source", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256).alias("h"))
    marked = x.withColumn("b", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % 64)
    inner = marked.groupBy("source", "b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("b", "h")))
    return inner.groupBy("source").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["h"]), ""), 256).alias("fingerprint"), F.sum("n").alias("rows"))


def altered(rows: DataFrame) -> DataFrame:
    """The same lines with every 400th missing and every 401st changed."""
    return rows.where("line_no % 400 <> 5").withColumn("raw", F.when(F.col("line_no") % 401 == 7, F.concat("raw", F.lit("!"))).otherwise(F.col("raw")))


def cold(spark, d) -> DataFrame:
    return A.tier_rows(spark, d).where("tier = 'cold'")


MEMBERS = f"""{A.TIER_ROWS}, e as (select hub_id, day, file, count(*) as n, cast(sum(strlen(raw) + 1) as bigint) as bytes, string_agg(sha1(line_no || raw), '' order by line_no) as h from tiers where tier = 'cold' group by all),
  a as (select hub_id, day, file, count(*) as n, cast(sum(strlen(r) + 1) as bigint) as bytes, string_agg(sha1(line_no || r), '' order by line_no) as h from (select *, case when line_no % 401 = 7 then raw || '!' else raw end as r from tiers where tier = 'cold' and line_no % 400 <> 5) group by all),
  diff as (select coalesce(e.hub_id, a.hub_id) as hub_id, coalesce(e.day, a.day) as day, coalesce(e.file, a.file) as file, case when a.h is null then 'missing' when e.h is null then 'extra' when a.h <> e.h then 'changed' end as change, a.bytes, a.h as ah
    from e full outer join a on e.hub_id = a.hub_id and e.day = a.day and e.file = a.file)"""


@register("set_manifest_diff", f"with {MEMBERS} select hub_id, cast(day as varchar) as day, file, change from diff where change is not null")
def set_manifest_diff(spark, d):
    rows = cold(spark, d)
    return tiers.manifest_diff(tiers.manifest(rows), tiers.manifest(altered(rows))).withColumn("day", day())


@register("val_archive_verify", f"with {MEMBERS} select hub_id, strftime(day, '%Y-%m') as month, count(ah) as members, cast(coalesce(sum(bytes), 0) as bigint) as bytes, count(change) as differences, case when count(change) > 0 then 'corrupt' else 'ok' end as status from diff group by 1, 2")
def val_archive_verify(spark, d):
    rows = cold(spark, d)
    return tiers.verify(tiers.manifest(rows), altered(rows))


@register("agg_archive_index", f"with {MEMBERS} select hub_id, strftime(day, '%Y-%m') as month, cast(day as varchar) as day, count(*) as members, cast(sum(bytes) as bigint) as bytes from e group by 1, 2, 3")
def agg_archive_index(spark, d):
    return tiers.archive_index(tiers.manifest(cold(spark, d))).withColumn("day", day())


@register("val_delete_safe", f"with {MEMBERS} select hub_id, cast(day as varchar) as day, file from diff where change is null")
def val_delete_safe(spark, d):
    rows, keys = cold(spark, d), ["hub_id", "day", "file"]
    fields = ["line_no", "raw"]
    return tiers.unchanged(tiers.fingerprint(rows, keys, fields), tiers.fingerprint(altered(rows), keys, fields), keys).withColumn("day", day())


@register("agg_day_inventory", f"with {A.TIER_ROWS}, f as (select hub_id, day, file, tier, cast(sum(strlen(raw)) as bigint) as bytes from tiers group by all) select hub_id, cast(day as varchar) as day, file, tier, bytes from f qualify row_number() over (partition by hub_id, day, file order by case tier when 'hot' then 0 else 1 end) = 1")
def agg_day_inventory(spark, d):
    files = A.tier_rows(spark, d).groupBy("hub_id", "day", "file", "tier").agg(F.sum(F.octet_length("raw")).alias("bytes"))
    return tiers.day_inventory(files).select("hub_id", day().alias("day"), "file", "tier", "bytes")


@register("join_report_text", f"with {DUPS}, h as (select * from marked where tier = 'hot'), c as (select * from marked where tier = 'cold') select coalesce(h.event_id, c.event_id) as event_id, case when h.event_id is not null then 'hot' else 'cold' end as tier, coalesce(h.raw <> c.raw, false) as overlay from h full outer join c on h.event_id = c.event_id and h.hub_id = c.hub_id")
def join_report_text(spark, d):
    rows = A.tier_rows(spark, d).select("hub_id", "day", F.col("event_id").alias("file"), F.col("raw").alias("body"), "tier")
    out = tiers.report_text(rows.where("tier = 'hot'"), rows.where("tier = 'cold'"))
    return out.select(F.col("file").alias("event_id"), "tier", F.coalesce("overlay", F.lit(False)).alias("overlay"))


@register("sink_event_day", f"with {A.ACTIVITY} select cast(day as varchar) as day, count(distinct event_id) as events from activity group by 1")
def sink_event_day(spark, d):
    from ..streaming.jobs import append_days

    where = f"{shared_folder(spark)}/log-{uuid_of(d)}"
    rows = A.activity(spark, d).drop("tool_uses")
    append_days(rows.where("line_no % 2 = 0"), where)
    append_days(rows, where)  # a replay that overlaps
    return spark.read.parquet(where).groupBy(day().alias("day")).agg(F.count("*").alias("events"))


def shared_folder(spark: SparkSession) -> str:
    graph.cut(spark.range(1))
    return spark.sparkContext.getCheckpointDir()


def uuid_of(_: str) -> str:
    import uuid

    return uuid.uuid4().hex


@register("str_dedup", "select cast(event_id as varchar) as event_id from events group by 1")
def str_dedup(spark, d):
    rows = A.activity(spark, d).select("hub_id", "event_id", "ts")
    return rows.union(rows.where("cast(event_id as bigint) % 3 = 0")).dropDuplicates(["hub_id", "event_id"]).select("event_id")


@register("str_day_bucket", "select cast(cast(ts + interval 8 hour as date) as varchar) as day, count(*) as events from events group by 1")
def str_day_bucket(spark, d):
    local = F.to_date(F.from_utc_timestamp("ts", "Asia/Shanghai"))
    return DOC(spark, d, "events").groupBy(local.cast("string").alias("day")).agg(F.count("*").alias("events"))


# ---------------------------------------------------------------- evidence


def records(spark, d) -> DataFrame:
    return evidence.build_evidence(A.turns(spark, d))


RECORDS = rf"""{A.TURNS}, said as (select *, trim(regexp_replace(text, '\s+', ' ', 'g')) as one from turns where trim(text) <> ''),
  rows_ as (select hub_id, day, session_id, line_no, event_id, 'goals' as kind, 5 as most, case when length(one) <= 500 then one else substr(one, 1, 500) || '…' end as t from said where role = 'user'
    union all select hub_id, day, session_id, line_no, event_id, kind, most, t from (select *, case when length(one) <= 700 then one else substr(one, 1, 700) || '…' end as t from said where role = 'assistant'),
      (values ('actions', 12), ('results', 8), ('next_steps', 5)) k(kind, most)
      where kind = 'actions' and length(t) >= 60 or kind = 'results' and regexp_matches(lower(t), 'blocked|todo') or kind = 'next_steps' and contains(lower(t), 'todo')),
  ranked_ as (select *, row_number() over (partition by hub_id, day, session_id, kind order by line_no, event_id) - 1 as r, count(*) over (partition by hub_id, day, session_id, kind) as n from rows_),
  chosen_ as (select * from ranked_ where n <= most or list_contains(list_transform(range(most), lambda i: round_even(i * (n - 1) / (most - 1), 0)), r))"""


@register("agg_evidence", rf"""with {RECORDS}, texts as (select hub_id, day, session_id, kind, string_agg(t, chr(10) order by r) as body from chosen_ group by all),
  sides as (select hub_id, day, session_id, string_agg(event_id, ',' order by line_no, event_id) as sources, coalesce(array_to_string(list_sort(list_distinct(list(tool))), ','), '') as tools, min(ts) as started, max(ts) as ended from turns group by 1, 2, 3)
  select s.hub_id, cast(s.day as varchar) as day, s.session_id, coalesce(max(body) filter (kind = 'goals'), '') as goals, coalesce(max(body) filter (kind = 'actions'), '') as actions, coalesce(max(body) filter (kind = 'results'), '') as results,
    coalesce(max(body) filter (kind = 'next_steps'), '') as next_steps, any_value(sources) as sources, any_value(tools) as tools, strftime(any_value(started), '%Y-%m-%dT%H:%M:%S') as started_at, strftime(any_value(ended), '%Y-%m-%dT%H:%M:%S') as ended_at
  from sides s left join texts t on s.hub_id = t.hub_id and s.day = t.day and s.session_id = t.session_id group by 1, 2, 3""")
def agg_evidence(spark, d):
    text = lambda c, by="\n": F.array_join(c, by).alias(c)
    return records(spark, d).select("hub_id", day().alias("day"), "session_id", *(text(c) for c in ("goals", "actions", "results", "next_steps")), F.array_join("source_event_ids", ",").alias("sources"), text("tools", ","), "started_at", "ended_at")


@register("sink_evidence", f"with {A.TURNS} select count(*) as records from (select distinct hub_id, day, session_id from turns where day = date '2024-01-05')")
def sink_evidence(spark, d):
    return evidence.build_evidence(A.turns(spark, d).where("day = date '2024-01-05'")).agg(F.count("*").alias("records"))


@register("sink_evidence_backfill", f"with {A.TURNS} select cast(day as varchar) as day, count(distinct hub_id || session_id) as records from turns where day >= date '2024-01-10' group by 1")
def sink_evidence_backfill(spark, d):
    return evidence.build_evidence(A.turns(spark, d).where("day >= date '2024-01-10'")).groupBy(day().alias("day")).agg(F.count("*").alias("records"))


@register("sc_confidence", rf"""with {RECORDS} select s.hub_id, cast(s.day as varchar) as day, s.session_id, case when count(*) filter (kind = 'goals') > 0 and count(*) filter (kind = 'actions') > 0 then 0.65 else 0.45 end::double as confidence
  from (select distinct hub_id, day, session_id from turns) s left join chosen_ c on s.hub_id = c.hub_id and s.day = c.day and s.session_id = c.session_id group by 1, 2, 3""")
def sc_confidence(spark, d):
    return records(spark, d).select("hub_id", day().alias("day"), "session_id", F.col("confidence").cast("double").alias("confidence"))


@register("agg_sets", f"with {A.TURNS} select hub_id, session_id, string_agg(distinct tool, ',' order by tool) as tools from turns where tool is not null group by all")
def agg_sets(spark, d):
    return records(spark, d).where(F.size("tools") > 0).select("hub_id", "session_id", F.array_join("tools", ",").alias("tools"))


@register("win_latest_claim", f"""with {A.TURNS}, c as (select hub_id, session_id, ts, line_no, unnest(regexp_split_to_array(lower(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 700)), '[!?;]')) as clause, generate_subscripts(regexp_split_to_array(lower(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 700)), '[!?;]'), 1) as i from turns where role = 'assistant'),
  s as (select *, case when regexp_matches(clause, '\\b(?:blocked|failed|failure|timeout)\\b') then 'blocked' when regexp_matches(clause, '\\b(?:completed|passed|verified|delivered|fixed)\\b') then 'completed' when contains(clause, 'todo') then 'in_progress' end as st from c),
  l as (select hub_id, session_id, arg_max(st, (ts, line_no, i)) filter (st is not null) as st from s group by all)
  select t.hub_id, t.session_id, coalesce(l.st, 'in_progress') as status from (select distinct hub_id, session_id from turns) t left join l using (hub_id, session_id)""")
def win_latest_claim(spark, d):
    return records(spark, d).select("hub_id", "session_id", "status")


@register("agg_day_rollup", f"with {A.TURNS} select hub_id, cast(day as varchar) as day, count(distinct session_id) as tasks from turns group by 1, 2")
def agg_day_rollup(spark, d):
    return evidence.day_rollup(records(spark, d)).select("hub_id", day().alias("day"), "tasks")


@register("agg_status_counts", f"with {A.TURNS} select hub_id, cast(day as varchar) as day, count(*) as events, count(distinct session_id) as sessions, count(distinct session_id) as work_items from turns group by 1, 2")
def agg_status_counts(spark, d):
    return reports.status_counts(records(spark, d), A.turns(spark, d)).select("hub_id", day().alias("day"), "events", "sessions", "work_items")


@register("rep_evidence_text", f"with {A.TURNS} select hub_id, session_id, 'Session ' || session_id || ' (' || arg_min(agent, line_no) || ')' as head from turns group by hub_id, session_id")
def rep_evidence_text(spark, d):
    return evidence.evidence_text(records(spark, d)).select("hub_id", "session_id", F.split("body", "\n")[0].alias("head"))


@register("sc_evidence_id")
def sc_evidence_id(spark, d):
    return records(spark, d).select("hub_id", "session_id", "id")


@register("prj_conclusion")
def prj_conclusion(spark, d):
    return records(spark, d).select("hub_id", "session_id", evidence.conclusion(F.col("results"), F.col("actions"), F.col("status")).alias("conclusion"))


@register("rep_work_items")
def rep_work_items(spark, d):
    return reports.work_items(records(spark, d)).select("hub_id", day().alias("day"), "agent", "session_id", F.col("rank").cast("long").alias("rank"), F.array_join("lines", "\n").alias("body"))


# ---------------------------------------------------------------- reports


def packed(spark, d) -> DataFrame:
    return packing.pack(A.turns(spark, d))


@register("pack_fair")
def pack_fair(spark, d):
    return packed(spark, d).select("hub_id", day().alias("day"), "event_id", "cost")


@register("rep_ref_map")
def rep_ref_map(spark, d):
    return reports.ref_map(packed(spark, d)).select("hub_id", day().alias("day"), F.col("n").cast("long").alias("n"), "event_id")


@register("rep_pack")
def rep_pack(spark, d):
    numbered = reports.ref_map(packed(spark, d)).select("hub_id", "day", "n", "event_id").join(A.turns(spark, d), ["hub_id", "day", "event_id"])
    return reports.pack_lines(numbered).withColumn("day", day())


@register("agg_coverage", f"with {A.TURNS} select hub_id, cast(day as varchar) as day, count(*) as events, count(distinct agent || '/' || session_id) as sessions from turns group by 1, 2")
def agg_coverage(spark, d):
    return reports.coverage(packed(spark, d), A.turns(spark, d)).select("hub_id", day().alias("day"), "events", "sessions")


@register("rep_citation_pack", f"with {A.TURNS} select event_id, day || '#L' || line_no as ref from turns where role not in ('system', 'developer')")
def rep_citation_pack(spark, d):
    return reports.citation_pack(A.turns(spark, d)).select("event_id", F.get_json_object("line", "$.ref").alias("ref"))


@register("rep_profile_inputs", f"with {A.TURNS} select event_id, substr(text, 1, 600) as text from turns where role = 'user' and trim(text) <> ''")
def rep_profile_inputs(spark, d):
    return A.turns(spark, d).where((F.col("role") == "user") & (T.useful(F.col("text")) != "")).select("event_id", F.substring("text", 1, 600).alias("text"))


@register("join_report_gaps", "select distinct cast(cast(ts as date) as varchar) as day from events where cast(ts as date) < date '2024-01-29' and day(ts) not in (select distinct day(o_orderdate) from orders where o_orderkey % 997 = 0)")
def join_report_gaps(spark, d):
    done = A.orders(spark, d).where("o_orderkey % 997 = 0").select(F.lit("h0").alias("hub_id"), F.dayofmonth("o_orderdate").alias("dom")).distinct()
    written = done.select("hub_id", F.make_date(F.lit(2024), F.lit(1), "dom").alias("day"))
    days = A.activity(spark, d).select(F.lit("h0").alias("hub_id"), "day").distinct()
    return reports.report_gaps(days, written, F.lit("2024-01-29").cast("date")).select(day().alias("day"))


@register("join_prune_live", f"""with {A.ACTIVITY}, s as (select hub_id, session_id, max(ts) as last_ts from activity group by all)
  select hub_id, session_id from s where last_ts <= timestamp '2024-01-30 23:58:00' - interval 24 hour and cast(last_ts as date) < date '2024-01-30' and cast(session_id as integer) % 5 <> 0""")
def join_prune_live(spark, d):
    events = A.activity(spark, d)
    sessions = act.live_index(events)
    tasks = sessions.where("cast(session_id as int) % 5 = 0").select("hub_id", "session_id", F.lit("active").alias("status"))
    return retention.prunable(sessions, events, tasks, A.instant(A.NOW)).select("hub_id", "session_id")


@register("val_jsonl", """with l as (select source, doc_id, text from documents) select source, count(*) as bad_lines, min(doc_id) as first_bad_line from l where trim(text) <> '' group by 1""")
def val_jsonl(spark, d):
    lines = DOC(spark, d, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("line_no"), F.col("text").alias("raw"))
    return quality.bad_lines(lines).withColumnRenamed("source_file", "source")


# ---------------------------------------------------------------- graph and decisions


# Every order replaces another one of its block of 16 keys, so chains and loops stay short while the graph grows with the table.
EDGES = "edges as (select distinct o_orderkey as src, o_orderkey // 16 * 16 + (o_orderkey + 1 + o_custkey % 12) % 16 as dst from orders)"


def order_edges(spark, d) -> DataFrame:
    return A.orders(spark, d).selectExpr("'h0' as hub_id", "cast(o_orderkey as string) as src", "cast(o_orderkey div 16 * 16 + (o_orderkey + 1 + o_custkey % 12) % 16 as string) as dst")


@register("graph_cycle", f"with recursive {EDGES}, r as (select src as start, dst as node from edges union select r.start, e.dst from r join edges e on e.src = r.node) select cast(start as varchar) as node from r where start = node")
def graph_cycle(spark, d):
    return graph.cycle_nodes(order_edges(spark, d)).select("node")


@register("graph_reach", f"with recursive {EDGES}, r as (select src as start, dst as node from edges union select r.start, e.dst from r join edges e on e.src = r.node) select cast(start as varchar) as start, count(*) as reachable from r group by 1")
def graph_reach(spark, d):
    return graph.reach_counts(order_edges(spark, d)).select("start", "reachable")


MEMORIES = """memories as (select 'h' || (item_id % 3) as hub_id, 'memory_' || item_id as id, case when item_id % 7 = 0 then 'superseded' when item_id % 11 = 0 then 'archived' else 'active' end as status, case when item_id % 5 = 0 and item_id >= 3 then 'memory_' || (item_id - 3) end as old from benchmark),
  log as (select 'h' || (user_id % 400 % 3) as hub_id, 'memory_' || (user_id % 400) as memory_id, case event_id % 2 when 0 then 'accepted' else 'rejected' end as decision, ts, event_id from events)"""


def memory_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as memories and the event stream as decisions on them."""
    m = DOC(spark, d, "benchmark").selectExpr(
        "concat('h', item_id % 3) as hub_id", "concat('memory_', item_id) as id", "substring(text, 1, 20) as title", "text as content", "'fact' as type",
        "case when item_id % 7 = 0 then 'superseded' when item_id % 11 = 0 then 'archived' else 'active' end as status", "cast(0.7 as double) as confidence", "'2024-01-01' as created_at", "'2024-01-01' as updated_at",
        "case when item_id % 5 = 0 and item_id >= 3 then array(concat('memory_', item_id - 3)) else cast(array() as array<string>) end as supersedes", "array('s') as source_session_ids", "cast(array() as array<string>) as source_event_ids", "item_id as line_no",
    )
    e = DOC(spark, d, "events").selectExpr(
        "concat('h', user_id % 400 % 3) as hub_id", "concat('dec_', event_id) as id", "concat('memory_', user_id % 400) as memory_id", "case event_id % 2 when 0 then 'accepted' else 'rejected' end as decision", "'because' as reason",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") as ts", "array('s') as source_session_ids", "cast(array() as array<string>) as source_event_ids", "cast(array() as array<string>) as replacement_ids", "cast(null as string) as reverses",
        "named_struct('session_id', cast(user_id as string), 'event_id', cast(event_id as string)) as target", "event_id as line_no",
    )
    return m, e


@register("win_latest_decision", f"with {MEMORIES} select hub_id, memory_id, arg_max(decision, (ts, event_id)) as decision, count(*) as events from log group by all")
def win_latest_decision(spark, d):
    _, e = memory_tables(spark, d)
    last = decisions.latest_events(e).select("hub_id", "memory_id", "decision")
    return last.join(e.groupBy("hub_id", "memory_id").agg(F.count("*").alias("events")), ["hub_id", "memory_id"])


@register("asof_events", f"with {MEMORIES} select hub_id, memory_id, count(*) as events from log where ts < timestamp '2024-01-11 00:00:00' group by all")
def asof_events(spark, d):
    _, e = memory_tables(spark, d)
    return decisions.as_of(decisions.strict(e), ids.bare_date_end(F.lit("2024-01-10")) + F.expr("interval 1 microsecond")).groupBy("hub_id", "memory_id").agg(F.count("*").alias("events"))


@register("graph_edges_struct", f"with {MEMORIES} select hub_id, old as src, id as dst from memories where old is not null")
def graph_edges_struct(spark, d):
    return decisions.structural_edges(memory_tables(spark, d)[0])


STATES = f"""{MEMORIES}, l as (select hub_id, memory_id, arg_max(decision, (ts, event_id)) as decision from log group by all), ids as (select hub_id, id as memory_id from memories union select hub_id, memory_id from l),
  repl as (select distinct hub_id, old as memory_id from memories where old is not null),
  st as (select i.hub_id, i.memory_id, m.status, l.decision, m.id is null as missing, r.memory_id is not null as replaced,
    coalesce(l.decision, case when r.memory_id is not null or m.status = 'superseded' then 'superseded' else 'unmarked' end) as state
    from ids i left join memories m on m.hub_id = i.hub_id and m.id = i.memory_id left join l on l.hub_id = i.hub_id and l.memory_id = i.memory_id left join repl r on r.hub_id = i.hub_id and r.memory_id = i.memory_id)"""


@register("state_resolve", f"with {STATES} select hub_id, memory_id, state, not (state in ('rejected', 'superseded') or missing or coalesce(decision = 'accepted' and replaced, false) or coalesce(status in ('stale', 'archived'), false)) as recommended from st")
def state_resolve(spark, d):
    return decisions.states(*memory_tables(spark, d)).select("hub_id", "memory_id", "state", "recommended")


@register("state_list", f"with {STATES} select state, count(*) as memories from st group by 1")
def state_list(spark, d):
    return decisions.states(*memory_tables(spark, d)).groupBy("state").agg(F.count("*").alias("memories"))


@register("state_annotate", f"with {MEMORIES}, x as (select hub_id, user_id from (select 'h' || (user_id % 400 % 3) as hub_id, user_id, event_id from events)) select count(*) as marked from x")
def state_annotate(spark, d):
    m, e = memory_tables(spark, d)
    # the hub of an event is that of the memory it decides on, as in the log
    hub = F.concat(F.lit("h"), F.col("session_id").cast("long") % 400 % 3)
    docs = A.activity(spark, d).select(hub.alias("hub_id"), "session_id", "event_id").withColumn("memory_id", F.lit(None).cast("string"))
    return decisions.annotate(docs, m, e).agg(F.count("decision").alias("marked"))


@register("val_event_schema", f"with {MEMORIES} select cast(null as varchar) as problem, count(*) as events from log")
def val_event_schema(spark, d):
    return decisions.check_events(memory_tables(spark, d)[1]).groupBy("problem").agg(F.count("*").alias("events"))


@register("val_memory", "select cast(null as varchar) as problem, count(*) as memories from benchmark")
def val_memory(spark, d):
    m, _ = memory_tables(spark, d)
    return m.withColumn("problem", decisions.memory_problem()).groupBy("problem").agg(F.count("*").alias("memories"))


@register("val_memories_file", "select 0 as copies where false")
def val_memories_file(spark, d):
    return decisions.duplicated(memory_tables(spark, d)[0]).select(F.col("copies").cast("int").alias("copies"))


@register("flt_memory_active", f"with {MEMORIES} select hub_id, id from memories where status not in ('superseded', 'archived')")
def flt_memory_active(spark, d):
    return memory_tables(spark, d)[0].where("status not in ('superseded', 'stale', 'archived')").select("hub_id", "id")


@register("lim_memory_index", f"with {MEMORIES} select hub_id, id, row_number() over (partition by hub_id order by cast(substr(id, 8) as integer)) as rank from memories where status not in ('superseded', 'archived') qualify rank <= 10")
def lim_memory_index(spark, d):
    return reports.memory_index(memory_tables(spark, d)[0]).select("hub_id", "id", F.col("rank").cast("long").alias("rank"))
