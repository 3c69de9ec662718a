"""Ranked retrieval over a corpus for a whole table of queries, as one plan.

Corpus rows: hub_id, doc_id (unique, in corpus order), source, path, line_no, day,
instant, cwd, agent, session_id, event_id, memory_id, role, status, title, text,
files. Query rows: hub_id, query_id, text (the topic), phrase, cwd, agent, f_agent,
f_source, f_date, as_of, ref_now, days, exclude_session, lim, and the intent columns
kind, half_life, symmetric, target_day, other_agent.

Eligibility comes first (time, filters, excluded session), and all statistics are
taken over what is eligible. Queries with equal filters share an eligibility class;
a class is joined to the corpus by hub and day, never by a cross product.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import small_side
from . import stored_index as X
from .stored_index import NO_DAY, spread

# Weights of the score.
K1, B = 1.2, 0.75
WEAK = 0.25
COVERAGE_FLOOR = 0.5
PHRASE = 2.5
RECENCY_PLAIN, RECENCY_TIMED, RECENCY_DAYS = 0.5, 8.0, 30.0
SAME_CWD, OTHER_SESSION, SAME_AGENT = 3.0, 1.5, 1.0
DELIVERED, ARTIFACT, PLANNED = 7.0, 2.0, 0.7
TOPICAL = 0.5
ECHO = 0.2
SOURCE_WEIGHT = {"memory": 1.6, "evidence": 1.35, "report": 0.65, "session": 0.7, "profile": 1.0}
OTHER_SOURCE = 0.5
# Synonyms, each word with what it adds.
SYNONYMS = {
    "日记": ("diary", "daily"), "diary": ("日记", "daily"), "报告": ("report",), "report": ("报告",), "记忆": ("memory", "memories"), "memory": ("记忆",),
    "技能": ("skill", "skills"), "skill": ("技能",), "昨天": ("yesterday",), "yesterday": ("昨天",), "检索": ("search", "retrieval"), "search": ("检索",), "会话": ("session",), "session": ("会话",),
}
# Artifact patterns, word lists of delivery.
LINK = r"\[([^\]]{0,160})\]\((<[^>\n]+>|[^)\s]+)"
TICKED = r"`([^`\n]{2,160})`"
SECRET_PART = r"(?i)(token|secret|api[_-]?key|passwd|password|credential|cookie|authorization|sig=|key=)"
SECRET_NAME = r"(?i)^(?:auth\.json|\.?env(?:\..*)?|id_(?:rsa|dsa|ecdsa|ed25519)(?:\..*)?|\.?(?:netrc|npmrc|pypirc)|.+\.(?:pem|key|p12|pfx|keystore))$"
PROVENANCE = ("/sessions/", "/.dsh/", "/.claude/", "/.codex/", "/live/")
EXTENSION = (
    r"(?i)\.(?:md|markdown|txt|rst|pdf|html?|css|jsx?|tsx?|ts|mjs|cjs|py|sh|rb|go|rs|java|kt|swift|c|h|cpp|hpp|cs|php|pl|r|sql|json|ya?ml|toml|ini|cfg|xml|csv"
    r"|tsv|xlsx?|docx|pptx|png|jpe?g|gif|webp|svg|mp4|mov|wav|mp3|zip|tar|gz|sqlite3?|db|log|patch|diff|canvas|base|ipynb)$"
)
DONE = (
    r"(?i)已完成|已写好|写好了|已生成|已创建|已保存|已交付|已写入|已完成并|已落地|已更新|已提交|已经(?:写好|生成|创建|完成)|做完了|搞定了"
    r"|\bdone\b|\bcompleted\b|\bcreated\b|\bgenerated\b|\bwritten\b|\bfinalized\b|\bdelivered\b|\bupdated\b|\bsaved\b"
)
TO_COME = r"(?i)将会|我(?:会|将|先)|打算|计划|准备|下一步|接下来|我会|TODO|todo|\bwill\b|\bgoing\s+to\b|\bplan(?:ned|ning)?\b|\bnext\b"
NOT_DONE = (
    r"(?i)(?:尚未|还没|并未|未曾|未|没有)(?:完成|生成|创建|交付|保存|写好)"
    r"|\b(?:not|never|isn't|wasn't)\s+(?:yet\s+)?(?:completed|done|created|generated|delivered|saved)\b"
)
CLASS = ("hub_id", "as_of", "ref_day", "days", "f_agent", "f_source", "f_date", "exclude_session")


# ---- documents


def record_text(fields: dict[str, Column]) -> Column:
    """Indexed text of a record: fields in a fixed order; tool echoes are left out, items of lists one by one."""
    order = ("title", "content", "narrative", "text", "cwd", "agent", "model", "status", "goals", "actions", "results", "next_steps", "files", "tools")
    echo = lambda x: x.rlike(T.TOOL_ECHO)
    parts = [F.filter(fields[f], lambda x: ~echo(x)) if f in ("goals", "actions", "results", "next_steps", "files", "tools") else F.when(~echo(fields[f]), fields[f]) for f in order if f in fields]
    return F.concat_ws(" ", *parts)


def corpus(spark: SparkSession, **tables: DataFrame) -> DataFrame:
    """One corpus of the given tables, each already in corpus columns, by position: memories and profiles have no day."""
    out = None
    for name in ("memory", "evidence", "session", "report", "profile"):
        if name in tables:
            part = tables[name].withColumn("source", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# ---- tokens and statistics


def postings(docs: DataFrame) -> DataFrame:
    """hub_id, day, doc_id, term, tf, length. Counted where a document is read, so nothing is shuffled."""
    return X.posted(docs).where("term is not null").select("hub_id", F.nullif("day", F.lit(NO_DAY).cast("date")).alias("day"), "doc_id", "term", "tf", "length")


def document_lengths(docs: DataFrame) -> DataFrame:
    return X.posted(docs).where("term is null").select("hub_id", F.nullif("day", F.lit(NO_DAY).cast("date")).alias("day"), "doc_id", "length")


def query_terms(queries: DataFrame, synonyms: bool = True) -> DataFrame:
    """hub_id, query_id, term, weight (how often the query holds it, synonyms added), strong (no single CJK character)."""
    own = queries.select("hub_id", "query_id", F.explode(T.tokenize(F.col("text"))).alias("term"))
    if synonyms:
        spark = queries.sparkSession
        words = spark.createDataFrame([(w, s) for w, more in SYNONYMS.items() for s in more], "word string, adds string")
        hooks = words.select(F.explode(F.array_distinct(T.tokenize(F.col("word")))).alias("term"), "adds")
        own = own.union(own.join(F.broadcast(hooks), "term").select("hub_id", "query_id", F.col("adds").alias("term")))
    strong = (F.length("term") >= 2) | ~F.col("term").rlike("^" + T.CJK)
    return own.groupBy("hub_id", "query_id", "term").agg(F.count("*").alias("weight")).withColumn("strong", strong)


# ---- eligibility


def classes(queries: DataFrame) -> DataFrame:
    """``queries`` with class_id: a digest of everything that decides which documents count."""
    q = queries.withColumn("ref_day", F.to_date("ref_now"))
    key = F.sha1(F.to_json(F.struct(*CLASS), {"ignoreNullFields": "false"}))
    return q.withColumn("class_id", key)


def class_days(classed: DataFrame, last: DataFrame) -> DataFrame:
    """Each class with every day it may see: window start to the hub's last day, and the sentinel of undated rows.

    ``last`` has hub_id and __last. Every class sees ``NO_DAY``.
    """
    one = classed.select("class_id", *CLASS).distinct()
    start = F.date_sub("ref_day", F.greatest(F.col("days") - 1, F.lit(0)))
    stop = F.greatest(F.col("__last"), start)
    return one.join(last, "hub_id").withColumn("__day", F.explode(F.concat(F.sequence(start, stop), F.array(F.lit(NO_DAY).cast("date"))))).drop("__last")


def admitted(instant: Column, day: Column, agent: Column, source: Column, session: Column) -> Column:
    """Whether a class (its columns by name) may see a row of a day it lists.

    An instant must lie before the cutoff; a row with a day only must be of an earlier
    day; timeless rows stay.
    """
    same = lambda f, c: F.col(f).isNull() | F.coalesce(c == F.col(f), F.lit(False))
    in_time = F.col("as_of").isNull() | F.when(instant.isNotNull(), instant < F.col("as_of")).when(day.isNull(), True).otherwise(day < F.to_date("as_of"))
    on_day = F.col("f_date").isNull() | F.coalesce(day.cast("string") == F.col("f_date"), F.lit(False))
    other = F.col("exclude_session").isNull() | ~F.coalesce(session == F.col("exclude_session"), F.lit(False))
    return in_time & same("f_agent", agent) & same("f_source", source) & on_day & other


def admits() -> Column:
    """``admitted`` for rows of an index beside a class (the index's columns renamed by ``beside``)."""
    return admitted(F.col("d_instant"), F.nullif("__day", F.lit(NO_DAY).cast("date")), F.col("d_agent"), F.col("d_source"), F.col("d_session"))


def beside(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"day": "__day", "instant": "d_instant", "agent": "d_agent", "source": "d_source", "session_id": "d_session"})


def eligible(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """hub_id, class_id, doc_id of the documents that each class may see, joined on hub and day."""
    last = docs.groupBy("hub_id").agg(F.max("day").alias("__last"))
    d = beside(docs.select("hub_id", "doc_id", F.coalesce("day", F.lit(NO_DAY).cast("date")).alias("day"), "instant", "agent", "source", "session_id"))
    return d.join(class_days(classed, last), ["hub_id", "__day"]).where(admits()).select("hub_id", "class_id", "doc_id")


# ---- scoring parts


def phrase_hits(docs: DataFrame, queries: DataFrame, block: int = 50_000) -> DataFrame:
    """hub_id, query_id, doc_id of documents whose lower-cased text contains the query's phrase.

    The phrases (a bounded block at a time) go to the tasks as one automaton, and each
    text is read once per block: no pair of document and query is formed without a hit.
    """
    wanted = queries.where("phrase is not null and phrase <> ''").select("hub_id", "query_id", F.lower("phrase").alias("phrase")).distinct()
    n = max(1, -(-wanted.count() // block))
    out = None
    for i in range(n):
        part = wanted if n == 1 else wanted.where(F.pmod(F.xxhash64("hub_id", "query_id"), F.lit(n)) == i)
        found = _phrase_block(docs, [(r["hub_id"], r["query_id"], r["phrase"]) for r in part.toLocalIterator()], dict(queries.dtypes)["query_id"])
        out = found if out is None else out.union(found)
    return out


def _phrase_block(docs: DataFrame, rows: list[tuple], query_kind: str) -> DataFrame:
    kind, query_type = dict(docs.dtypes)["doc_id"], pa.string() if query_kind == "string" else pa.int64()
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, asked = ahocorasick.Automaton(), {}
        for hub, query, phrase in shared.value:
            asked.setdefault(phrase, []).append((hub, query))
            automaton.add_word(phrase, phrase)
        if asked:
            automaton.make_automaton()
        for b in batches:
            rows, queries = [], []
            for i, (hub, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2), strict=True)):
                for phrase in {p for _, p in automaton.iter((text.as_py() or "").lower())} if asked else ():
                    for query in (q for h, q in asked[phrase] if h == hub):
                        rows.append(i)
                        queries.append(query)
            hit = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([hit.column(0), pa.array(queries, query_type), hit.column(1)], names=["hub_id", "query_id", "doc_id"])

    return docs.select("hub_id", "doc_id", "text").mapInArrow(run, f"hub_id string, query_id {query_kind}, doc_id {kind}")


def bm25() -> Column:
    """Value of one matched term (tf, length, df, n, average)."""
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))


def class_statistics(index: X.Index, spans: DataFrame) -> DataFrame:
    """class_id, n, average (at least 1) over what each class may see, from the sums of days and never from pairs of class and document.

    Days wholly before or after a cutoff count by their sums. Only the day of the cutoff
    itself, and the session that a class leaves out, are looked up document by document.
    """
    cutoff, day = F.to_date("as_of"), F.nullif("__day", F.lit(NO_DAY).cast("date"))
    anyone = F.lit(None).cast("string")
    timeless = lambda: admitted(F.lit(None).cast("timestamp"), day, F.col("d_agent"), F.col("d_source"), anyone)
    before = F.col("as_of").isNull() | F.col("at").isNull() | (F.col("at") < cutoff)
    sums = index.sums.withColumnsRenamed({"day": "__day", "agent": "d_agent", "source": "d_source"})
    whole = sums.join(spans, ["hub_id", "__day"]).where(before).withColumn("as_of", F.lit(None).cast("timestamp")).where(timeless())
    parts = whole.select("class_id", "documents", "tokens")
    one = beside(index.postings.where("bucket = -1")).select("hub_id", "__day", "d_instant", "d_agent", "d_source", "d_session", "length")
    same_date = one.where("d_instant is not null").withColumn("at", F.to_date("d_instant")).join(spans.where("as_of is not null").withColumn("at", cutoff), ["hub_id", "__day", "at"])
    seen = same_date.where(admitted(F.col("d_instant"), day, F.col("d_agent"), F.col("d_source"), anyone))
    parts = parts.union(seen.select("class_id", F.lit(1).cast("long"), "length"))
    theirs = one.join(spans.where("exclude_session is not null").withColumn("d_session", F.col("exclude_session")), ["hub_id", "__day", "d_session"])
    left_out = theirs.where(admitted(F.col("d_instant"), day, F.col("d_agent"), F.col("d_source"), anyone))
    parts = parts.union(left_out.select("class_id", F.lit(-1).cast("long"), -F.col("length")))
    total = parts.groupBy("class_id").agg(F.sum("documents").alias("n"), F.sum("tokens").alias("tokens"))
    return total.where("n > 0").select("class_id", "n", F.greatest(F.lit(1.0), F.col("tokens") / F.col("n")).alias("average"))


def recency(instant: Column, day: Column, q: DataFrame | None = None) -> Column:
    """(score, age in minutes): half-life forward, half-life around noon of a day, or linear over 30 days."""
    now, half = F.col("ref_now"), F.greatest(F.lit(1.0), F.coalesce("half_life", F.lit(1440.0)))
    minutes = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / F.lit(60_000_000.0)
    noon = F.to_timestamp("target_day") + F.expr("interval 12 hours")
    around = F.when(F.col("symmetric"), F.abs(minutes(instant, noon))).otherwise(F.greatest(F.lit(0.0), minutes(now, instant)))  # only read where the instant is known
    by_day = F.abs(F.datediff(day, F.when(F.col("symmetric"), F.col("target_day")).otherwise(F.to_date(now)))) * 1440.0
    timed_age = F.when(instant.isNotNull(), around).otherwise(by_day)
    plain_age = F.when(instant.isNotNull(), F.greatest(F.lit(0.0), minutes(now, instant))).when(day.isNotNull(), F.greatest(F.lit(0), F.datediff(F.to_date(now), day)) * 1440.0)
    age = F.when(F.col("kind").isNotNull(), timed_age).otherwise(plain_age)
    score = F.when(age.isNull(), 0.0).when(F.col("kind").isNotNull(), RECENCY_TIMED * F.pow(F.lit(0.5), age / half)).otherwise(RECENCY_PLAIN * F.greatest(F.lit(0.0), 1 - age / 1440.0 / RECENCY_DAYS))
    return F.struct(score.alias("score"), age.alias("age_minutes"))


def artifacts(text: Column, files: Column, cwd: Column, home: str = "/hub", most: int = 12) -> Column:
    """array<struct<path, resolved, via, source_ref>>: linked, ticked and listed files, first of each resolved path."""
    links = F.transform(F.regexp_extract_all(T.blank_as_empty(text), F.lit(LINK), F.lit(2)), lambda p: F.struct(p.alias("raw"), F.lit("markdown_link").alias("via")))
    ticked = F.transform(F.filter(F.regexp_extract_all(T.blank_as_empty(text), F.lit(TICKED), F.lit(1)), lambda p: p.contains("/") | p.contains(".")), lambda p: F.struct(p.alias("raw"), F.lit("backtick_path").alias("via")))
    listed = F.transform(F.coalesce(files, F.array().cast("array<string>")), lambda p: F.struct(p.alias("raw"), F.lit("files_field").alias("via")))
    clean = lambda p: F.regexp_replace(F.trim(p), "^<+|>+$", "")
    bare = lambda p: F.split(F.split(clean(p), "#", 2)[0], r"\?", 2)[0]
    name = lambda p: F.element_at(F.split(F.replace(bare(p), F.lit("\\"), F.lit("/")), "/"), -1)
    good = lambda x: (
        bare(x["raw"]).rlike(EXTENSION) & ~clean(x["raw"]).rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://") & ~clean(x["raw"]).startswith("#") & ~clean(x["raw"]).rlike(SECRET_PART) & ~name(x["raw"]).rlike(SECRET_NAME)
    )
    whole = lambda p: F.when(p.startswith("/") | (F.coalesce(cwd, F.lit("")) == ""), p).otherwise(F.concat(F.regexp_replace(cwd, "/$", ""), F.lit("/"), p))

    def entry(x: Column) -> Column:
        path = whole(bare(x["raw"]))
        inside = path.startswith(home)
        for hint in PROVENANCE:
            inside = inside | path.contains(hint)
        return F.struct(bare(x["raw"]).alias("path"), path.alias("resolved"), x["via"].alias("via"), inside.alias("source_ref"))

    return F.slice(T.first_per(F.transform(F.filter(F.concat(links, ticked, listed), good), entry), lambda a: a["resolved"]), 1, most)


def names_artifact(found: Column) -> Column:
    """A link or ticked path of the author, or a list of at most three files."""
    own = F.exists(found, lambda a: ~a["source_ref"] & a["via"].isin("markdown_link", "backtick_path"))
    few = (F.size(found) <= 3) & F.exists(found, lambda a: ~a["source_ref"] & (a["via"] == "files_field"))
    return own | few


def delivery(status: Column, text: Column, role: Column) -> Column:
    """delivered, planned, mentioned or unknown, from the record's own words; negated completion is none."""
    t = T.blank_as_empty(text)
    said = F.regexp_replace(t, NOT_DONE, "").rlike(DONE)
    done = F.coalesce(F.lower(status).isin("completed", "done", "success", "succeeded"), F.lit(False))
    return F.when(done | said, "delivered").when(t.rlike(TO_COME), "planned").when(F.coalesce(role.isin("user", "system"), F.lit(False)), "mentioned").otherwise("unknown")


def is_echo(role: Column, source: Column, said: Column, question: Column) -> Column:
    """Whether a user's or system's row says just the question; ``said`` is the digest of its words, null without any."""
    return F.coalesce(role.isin("user", "system") & source.isin("session", "evidence") & (said == F.sha1(T.squeeze(question))), F.lit(False))


# ---- the whole search


QUERY_DEFAULTS = {
    "phrase": "string", "raw": "string", "cwd": "string", "agent": "string", "f_agent": "string", "f_source": "string", "f_date": "string", "as_of": "timestamp", "ref_now": "timestamp", "days": "int",
    "exclude_session": "string", "lim": "int", "kind": "string", "half_life": "double", "symmetric": "boolean", "target_day": "date", "other_agent": "boolean",
}
DOC_DEFAULTS = {
    "path": "string", "line_no": "long", "day": "date", "instant": "timestamp", "cwd": "string", "agent": "string", "session_id": "string", "event_id": "string", "memory_id": "string", "role": "string", "status": "string",
    "title": "string", "files": "array<string>", "body": "string", "decision": "struct<state:string,recommended:boolean,caution:string>", "source": "string",
}


def complete(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns))


def prepared(queries: DataFrame, limit: int = 8) -> DataFrame:
    """Queries with a topic, all optional columns, and their eligibility class."""
    q = complete(queries, QUERY_DEFAULTS).where("text is not null and trim(text) <> ''")
    q = q.withColumns({"ref_now": F.coalesce("ref_now", "as_of", F.current_timestamp()), "days": F.coalesce("days", F.lit(30)), "lim": F.coalesce("lim", F.lit(limit)), "phrase": F.coalesce("phrase", F.lower("text"))})
    return classes(q)


PLAIN = "as_of is null and f_agent is null and f_source is null and exclude_session is null"


def reached(index: X.Index, asked: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the terms asked for on the days asked for, and the document frequencies of those days.

    Both filters are values, so day and bucket partitions that no query needs are not read.
    """
    day = F.col("__day")
    lo, hi = spans.where(day != F.lit(NO_DAY).cast("date")).agg(F.min(day).cast("string"), F.max(day).cast("string")).first()
    buckets = [r[0] for r in asked.select(X.bucket(F.col("term"), index.buckets).alias("b")).distinct().collect()]  # at most ``index.buckets``
    on_days = (F.col("day") == F.lit(NO_DAY).cast("date")) | (F.col("day").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")) if lo is not None else F.lit(False))
    needed = lambda df: df.where(on_days & F.col("bucket").isin(buckets)) if buckets else df.where("false")
    return needed(index.postings), needed(index.terms)


def lexical(index: X.Index, q: DataFrame, phrases: DataFrame, synonyms: bool = True) -> DataFrame:
    """One row per candidate (hub_id, query_id, doc_id): lexical score, coverage, phrase bonus.

    A candidate hits a strong term or holds the phrase; a query without strong terms
    takes every eligible document that it meets at all. ``phrases`` are ``phrase_hits``.
    Queries meet postings on hub, day and term, with their filters as conditions of the
    join; no pair of class and document is formed without a common term.
    """
    terms = query_terms(q, synonyms)
    last = index.sums.groupBy("hub_id").agg(F.nullif(F.max("day"), F.lit(NO_DAY).cast("date")).alias("__last"))
    spans = class_days(q, last)
    found, frequencies = reached(index, terms, spans)
    found = beside(found).drop("bucket")
    wanted = terms.join(q.select("hub_id", "query_id", "class_id"), ["hub_id", "query_id"])
    asked = small_side(wanted.select("hub_id", "class_id", "term").distinct().join(spans, ["hub_id", "class_id"]))
    plain = frequencies.withColumnRenamed("day", "__day").join(asked.where(PLAIN + " and f_date is null"), ["hub_id", "__day", "term"]).select("class_id", "term", "df")
    other = found.join(asked.where(f"not ({PLAIN} and f_date is null)"), ["hub_id", "__day", "term"]).where(admits()).select("class_id", "term", F.lit(1).cast("long").alias("df"))
    df = plain.union(other).groupBy("class_id", "term").agg(F.sum("df").alias("df"))
    weighed = wanted.join(df, ["class_id", "term"]).join(class_statistics(index, spans), "class_id")
    hits = found.join(small_side(weighed.join(spans, ["hub_id", "class_id"])), ["hub_id", "__day", "term"]).where(admits())
    value = bm25() * F.col("weight")
    by_term = hits.groupBy("hub_id", "query_id", "doc_id").agg(
        F.sum(F.when(F.col("strong"), value).otherwise(0.0)).alias("strong_score"),
        F.sum(F.when(~F.col("strong"), value).otherwise(0.0)).alias("weak_score"),
        F.sum(F.col("strong").cast("long")).alias("strong_hits"),
    )
    own = beside(index.postings.where("bucket = -1")).select("hub_id", "doc_id", "__day", "d_instant", "d_agent", "d_source", "d_session")
    said = phrases.join(q.select("hub_id", "query_id", "class_id"), ["hub_id", "query_id"]).join(own, ["hub_id", "doc_id"]).join(spans, ["hub_id", "class_id", "__day"]).where(admits())
    said = said.select("hub_id", "query_id", "doc_id", F.lit(True).alias("has_phrase"))
    strong = terms.groupBy("hub_id", "query_id").agg(F.sum(F.col("strong").cast("long")).alias("n_strong"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = by_term.join(said, ["hub_id", "query_id", "doc_id"], "full_outer").join(strong, ["hub_id", "query_id"], "left")
    rows = rows.withColumn("n_strong", F.coalesce("n_strong", F.lit(0)))
    rows = rows.withColumn("coverage", F.when(F.col("n_strong") > 0, F.coalesce("strong_hits", F.lit(0)) / F.col("n_strong")).otherwise(0.0))
    rows = rows.withColumn("lexical", (zero("strong_score") + WEAK * zero("weak_score")) * F.when(F.col("n_strong") > 0, COVERAGE_FLOOR + (1 - COVERAGE_FLOOR) * F.col("coverage")).otherwise(1.0))
    rows = rows.withColumn("phrase_bonus", F.when(F.col("has_phrase"), PHRASE).otherwise(0.0))
    rows = rows.where((F.col("n_strong") == 0) | (zero("strong_score") > 0) | (F.col("phrase_bonus") > 0))
    return rows.select("hub_id", "query_id", "doc_id", "lexical", "coverage", "phrase_bonus", "n_strong")


INDEXED = ("path", "cwd", "agent", "session_id", "instant", "source", "memory_id", "role", "status", "title", "body", "files", "text")


def features(docs: DataFrame, home: str = "/hub") -> DataFrame:
    """What ranking needs of a document, worked out once: its own columns, artifacts, delivery, digests of its head and of its words."""
    d = complete(docs, DOC_DEFAULTS)
    head = F.substring(T.squeeze(F.coalesce(F.nullif("title", F.lit("")), F.col("body"), F.col("text"))), 1, 240)
    own = ("path", "cwd", "agent", "session_id", "instant", "source", "memory_id", "role")
    made = (artifacts(F.col("text"), F.col("files"), F.col("cwd"), home).alias("artifacts"), delivery(F.col("status"), F.col("text"), F.col("role")).alias("delivery"))
    return d.select("hub_id", "day", "doc_id", *own, *made, F.sha1(head).alias("head"), F.sha1(F.nullif(T.squeeze("text"), F.lit(""))).alias("said"))


TERMS = 200_000


def index_of(docs: DataFrame, home: str = "/hub", terms: DataFrame | None = None) -> X.Index:
    """An index of ``docs`` for one plan; with ``terms`` (term) of these alone, where they are ``TERMS`` at most."""
    d = spread(complete(docs, DOC_DEFAULTS))
    asked = [] if terms is None else terms.select("term").distinct().limit(TERMS + 1).collect()
    few = terms is not None and len(asked) <= TERMS
    return X.of_the_moment(d, features(d, home), only=frozenset(r["term"] for r in asked) if few else None)


def refresh_index(docs: DataFrame, root: str, home: str = "/hub", buckets: int = X.BUCKETS) -> DataFrame:
    """Bring the stored index in ``root`` up to ``docs``; see ``stored_index.refresh``."""
    d = complete(docs, DOC_DEFAULTS)
    return X.refresh(d, features(d, home), root, INDEXED, buckets)


def search(docs: DataFrame, queries: DataFrame, limit: int = 8, synonyms: bool = True, index: X.Index | None = None, home: str = "/hub") -> DataFrame:
    """Ranked hits (hub_id, query_id, rank, doc_id, score, ...) of every query.

    ``index`` is a stored index (``stored_index.opened``); without it one is made of
    ``docs`` for this plan. Ranking reads the index alone (and ``decision`` of ``docs``,
    where they have it); the other columns of ``docs`` are fetched for the hits. Queries
    without a topic have no hits.
    """
    docs = complete(docs, DOC_DEFAULTS)
    q = prepared(queries, limit)
    index = index_of(docs, home, query_terms(q, synonyms)) if index is None else index
    rows = lexical(index, q, phrase_hits(spread(docs), q), synonyms).join(q, ["hub_id", "query_id"])
    d = index.features.withColumnsRenamed({"cwd": "d_cwd", "agent": "d_agent", "session_id": "d_session", "said": "d_said"}).withColumn("day", F.nullif("day", F.lit(NO_DAY).cast("date")))
    rows = rows.join(d, ["hub_id", "doc_id"]).join(docs.where("decision is not null").select("hub_id", "doc_id", "decision"), ["hub_id", "doc_id"], "left")
    hits = rank(scored(rows)).join(docs.select("hub_id", "doc_id", "line_no", "event_id", "title", "files", "body", "status", F.col("text").alias("d_text")), ["hub_id", "doc_id"])
    strong = query_terms(q, synonyms).where("strong").groupBy("hub_id", "query_id").agg(F.array_sort(F.collect_set("term")).alias("strong_terms"))
    hits = hits.join(strong, ["hub_id", "query_id"], "left")
    return hits.withColumn("matched_terms", F.array_intersect(F.coalesce("strong_terms", F.array().cast("array<string>")), T.tokenize(F.col("d_text")))).drop("strong_terms")


def scoped(rows: DataFrame) -> DataFrame:
    """``rows`` of a document's and a query's columns with scope (cwd, cross_project, any) and what it adds (scope_bonus)."""
    same_cwd = F.coalesce(F.col("d_cwd") == F.col("cwd"), F.lit(False))
    other = F.coalesce(F.col("other_agent") & F.col("exclude_session").isNotNull() & (F.col("d_session") != F.col("exclude_session")) & (F.col("d_session") != ""), F.lit(False))
    extra = F.when(same_cwd, SAME_CWD).otherwise(0.0) + F.when(F.coalesce(F.col("d_agent") == F.col("agent"), F.lit(False)), SAME_AGENT).otherwise(0.0) + F.when(other, OTHER_SESSION).otherwise(0.0)
    return rows.withColumns({"scope": F.when(same_cwd, "cwd").when(F.col("cwd").isNotNull(), "cross_project").otherwise("any"), "scope_bonus": extra})


def scored(rows: DataFrame) -> DataFrame:
    """Scores of candidate rows that hold a document's and a query's columns."""
    rows = scoped(rows.withColumn("recency", recency(F.col("instant"), F.col("day"))))
    extra = F.col("scope_bonus")
    topical = (F.col("n_strong") == 0) | (F.col("coverage") >= TOPICAL) | (F.col("phrase_bonus") > 0)
    named = names_artifact(F.col("artifacts"))
    made = F.when(topical & named, ARTIFACT).otherwise(0.0) + F.when(topical & named & (F.col("delivery") == "delivered"), DELIVERED).otherwise(0.0)
    planned = F.when(topical & (F.col("delivery") == "planned"), PLANNED).otherwise(1.0)
    weight = F.coalesce(F.element_at(F.create_map(*(x for k, v in SOURCE_WEIGHT.items() for x in (F.lit(k), F.lit(v)))), F.col("source")), F.lit(OTHER_SOURCE))
    rows = rows.withColumn("echo", is_echo(F.col("role"), F.col("source"), F.col("d_said"), F.coalesce("raw", "text")))
    timed = F.when(F.col("kind").isNotNull(), 0.25 + 0.75 * F.least(F.lit(1.0), F.col("recency.score") / RECENCY_TIMED)).otherwise(1.0)
    total = (F.col("lexical") + F.col("phrase_bonus") + extra + F.col("recency.score") + made) * weight * planned * timed * F.when(F.col("echo"), ECHO).otherwise(1.0)
    explain = F.struct(
        F.round("lexical", 4).alias("lexical"), F.col("phrase_bonus").alias("phrase"), extra.alias("scope_agent"), F.round("recency.score", 4).alias("recency"), made.alias("artifact_delivery"),
        weight.alias("source_weight"), planned.alias("planned_factor"), F.when(F.col("echo"), ECHO).otherwise(1.0).alias("echo_factor"), F.round("recency.age_minutes", 1).alias("age_minutes"),
    )
    return rows.withColumn("score", F.round(total, 4)).withColumn("explain", explain).drop("scope_bonus")


def rank(rows: DataFrame) -> DataFrame:
    """First document of equal heads per path, then order and cut per query.

    Demoted decisions come last, meaningful hits of the asked directory first, then by
    score, time, session and corpus order.
    """
    key = F.when((F.col("source") == "memory") & F.col("memory_id").isNotNull(), F.concat(F.lit("id:"), F.col("memory_id"))).otherwise(F.col("head"))
    first = Window.partitionBy("hub_id", "query_id", F.coalesce("path", F.lit("")), key).orderBy("doc_id")
    rows = rows.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")
    historical = F.coalesce(~F.col("decision.recommended"), F.lit(False))
    local = (F.col("scope") == "cwd") & (F.col("coverage") >= 0.5) & ~F.col("echo")
    stamp = F.coalesce(F.col("day").cast("string"), F.col("instant").cast("string"), F.lit(""))
    order = Window.partitionBy("hub_id", "query_id").orderBy(historical, ~local, F.desc("score"), stamp, F.coalesce("d_session", F.lit("")), "doc_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("lim"))
    any_local = F.max(F.col("scope") == "cwd").over(Window.partitionBy("hub_id", "query_id"))
    return rows.withColumn("cwd_fallback", F.col("cwd").isNotNull() & ~any_local)


# ---- results


def compact(hits: DataFrame) -> DataFrame:
    """Result rows: one redacted line, confidence band, locator, up to three artifacts, size estimate."""
    line = F.substring(T.redact(T.squeeze(F.coalesce(F.nullif("title", F.lit("")), F.nullif("d_text", F.lit("")), F.lit("(no summary field)")))), 1, 240)
    place = F.when(F.col("line_no").isNotNull(), F.concat(F.col("path"), F.lit("#L"), F.col("line_no").cast("string"))).otherwise(F.col("path"))
    shown = F.slice(F.transform(F.filter("artifacts", lambda a: ~a["source_ref"]), lambda a: a["resolved"]), 1, 3)
    out = hits.select("hub_id", "query_id", "rank", "doc_id", "source", F.coalesce(F.col("day").cast("string"), F.lit("")).alias("period"), line.alias("line"), place.alias("locator"), shown.alias("artifacts"), "score", "coverage", "delivery", "decision", "scope")
    size = T.estimated_tokens(F.concat_ws(" ", "line", "locator", F.array_join("artifacts", " "), "period", "source"))
    return out.withColumn("tokens", size + 8)


def confidence_band(value: Column) -> Column:
    return F.when(value.isNull(), "unknown").when(value >= 0.7, "high").when(value >= 0.5, "med").otherwise("low")


def fit_budget(rows: DataFrame, budget: int, header: int = 48) -> DataFrame:
    """Hits kept in rank order while the estimated size fits; one that does not fit is passed over, smaller ones may follow.

    A query's hits are at most its limit, so one row gathers them.
    """
    all_hits = F.array_sort(F.collect_list(F.struct("rank", "tokens", "doc_id")))
    start = F.struct(F.lit(header).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda acc, h: F.when(acc["used"] + h["tokens"] <= budget, F.struct((acc["used"] + h["tokens"]).alias("used"), F.concat(acc["kept"], F.array(h["rank"].cast("long"))).alias("kept"))).otherwise(acc)
    packed = rows.groupBy("hub_id", "query_id").agg(F.aggregate(all_hits, start, step).alias("p"), F.count("*").alias("hits"))
    return packed.select("hub_id", "query_id", F.col("p.kept").alias("kept"), F.col("p.used").alias("used"), (F.col("hits") - F.size("p.kept")).alias("dropped"))


def sufficiency(top: DataFrame) -> DataFrame:
    """sufficient or thin for each query's first row (coverage, delivery, artifacts, decision, artifact_request)."""
    any_artifact = F.size("artifacts") > 0
    reason = (
        F.when(F.coalesce(~F.col("decision.recommended"), F.lit(False)), "decision withdrawn or replaced")
        .when(F.col("delivery") == "planned", "a plan, not a deliverable")
        .when(F.coalesce("artifact_request", F.lit(False)) & ~any_artifact, "no exact artifact")
        .when(F.col("coverage") >= F.when((F.col("delivery") == "delivered") & any_artifact, 0.5).otherwise(0.65), None)
        .otherwise("weak topic match")
    )
    return top.withColumn("reason", reason).withColumn("sufficiency", F.when(F.col("reason").isNull(), "sufficient").otherwise("thin"))


def payload(hits: DataFrame, requests: DataFrame, budget: int = 1200) -> DataFrame:
    """Per query: kept hits, what was dropped, sufficiency of the first kept hit, open requests of the hub."""
    from ..operators.reports import pending

    small = compact(hits)
    packed = fit_budget(small, budget)
    first = small.join(packed.select("hub_id", "query_id", F.try_element_at("kept", F.lit(1)).alias("__first")), ["hub_id", "query_id"]).where(F.col("rank") == F.col("__first"))
    judged = sufficiency(first.withColumn("artifact_request", F.lit(False))).select("hub_id", "query_id", "sufficiency", "reason")
    waiting = pending(requests).groupBy("hub_id").agg(F.max("total").alias("pending_total"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "kind", "period", "status")))).alias("pending"))
    return packed.join(judged, ["hub_id", "query_id"], "left").join(waiting, "hub_id", "left").withColumn("sufficiency", F.coalesce("sufficiency", F.lit("thin")))


def bounded_exchange(rows: DataFrame, budget: int, overhead: int = 60) -> DataFrame:
    """Rows of ``turns.exchange`` that fit: the anchor first, then its question, then neighbours in order; texts redacted, then cut.

    ``refused`` where not even the anchor fits.
    """
    keep = min(600, max(80, (budget - 350) // 3))
    text = T.redact(T.blank_as_empty(F.col("text")))
    shown = rows.where(F.col("is_anchor") | (F.col("role").isin("user", "assistant") & (F.trim("text") != "")))
    place = F.when(F.col("is_anchor"), 0).when(F.col("is_question"), 1).otherwise(2)
    shown = shown.withColumn("place", place).withColumn("shown", F.substring(text, 1, keep)).withColumn("clipped", F.length(text) > keep)
    shown = shown.withColumn("tokens", T.estimated_tokens(F.col("shown")) + overhead)
    one = F.array_sort(F.collect_list(F.struct("place", "rn", "tokens", "event_id", "clipped")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))
    step = lambda acc, h: F.when(acc["used"] + h["tokens"] <= budget - 200, F.struct((acc["used"] + h["tokens"]).alias("used"), F.concat(acc["kept"], F.array(h["event_id"])).alias("kept"))).otherwise(acc)
    out = shown.groupBy("hub_id", "session_id", "anchor").agg(F.aggregate(one, start, step).alias("p"), F.count("*").alias("candidates"))
    return out.select("hub_id", "session_id", "anchor", F.col("p.kept").alias("kept"), F.col("p.used").alias("used"), "candidates", (~F.array_contains("p.kept", F.col("anchor"))).alias("refused"))


def accepted(hits: DataFrame, labelled: DataFrame) -> DataFrame:
    """Labelled queries (hub_id, query_id, want_path, want_artifact) with their rank-1 hit and whether it is the wanted one."""
    top = hits.where("rank = 1").select("hub_id", "query_id", "path", F.transform("artifacts", lambda a: a["path"]).alias("paths"))
    out = labelled.join(top, ["hub_id", "query_id"], "left")
    right = F.coalesce(F.col("path") == F.col("want_path"), F.lit(False)) & (F.col("want_artifact").isNull() | F.coalesce(F.array_contains("paths", F.col("want_artifact")), F.lit(False)))
    return out.withColumn("correct", right)


def parity(one: DataFrame, other: DataFrame, columns: tuple[str, ...] = ("hub_id", "query_id", "rank", "doc_id", "score")) -> DataFrame:
    """Rows that only one of two plans gives; empty where an index and a scan agree."""
    a, b = one.select(*columns), other.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("first")).union(b.exceptAll(a).withColumn("side", F.lit("second")))


def index_status(index: DataFrame) -> DataFrame:
    return index.groupBy("hub_id", "day").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("postings"), F.sum("tf").alias("tokens"))
