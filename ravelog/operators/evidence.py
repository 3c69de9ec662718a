"""One source-linked work record per session, from its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from .numbering import numbered

EVERY_CLAIM = tuple(w for words in T.CLAIM.values() for w in words)


# How many texts of each kind a record keeps, at evenly spaced ranks.
KEPT = {"goal": 5, "action": 12, "result": 8, "step": 5}
MOST_FILES = 80


def evenly(rank: Column, n: Column, limit: Column) -> Column:
    """Whether row ``rank`` (from 1) of ``n`` is one of ``limit`` evenly spaced ones, first and last included (half rounds to even)."""
    at = F.transform(F.sequence(F.lit(0), limit - 1), lambda i: F.bround(i * (n - 1) / (limit - 1).cast("double")) + 1)
    return (n <= limit) | F.array_contains(at, rank.cast("double"))


def build_evidence(events: DataFrame, by: tuple[str, ...] = ("hub_id", "day", "session_id")) -> DataFrame:
    """Goals, actions, results, next steps, status, tools, files and sources of each session and day.

    Texts are chosen by rank before any is gathered, so a session of any size gives at most
    30 clipped texts and 80 files; only the ids of its events are listed whole. Statuses are
    claims of the source, never verified: the latest deciding clause in order of the raw
    timestamp wins. Rows without an id get one from their fields.
    """
    useful = T.useful(F.col("text"))
    said = F.when((F.col("role") == "assistant") & (useful != ""), T.clip(useful, 700))
    row = events.select(
        *by,
        F.struct("line_no", "event_id").alias("at"),
        F.coalesce("ts_raw", F.lit("")).alias("stamp"),
        F.when((F.col("role") == "user") & (useful != ""), T.clip(useful, 500)).alias("goal"),
        said.alias("said"),
        "agent", "model", "cwd", "ts_raw", "source_file",
        F.coalesce(F.when(F.col("event_id") != "", F.col("event_id")), ids.fallback_event_id(F.col("session_id"), F.col("ts_raw"), F.col("role"), F.col("text"), F.col("line_no"))).alias("id"),
        F.transform(F.coalesce("tool_uses", F.array()), lambda t: t["name"]).alias("tool_names"),
        F.flatten(F.transform(F.coalesce("tool_uses", F.array()), lambda t: T.file_tokens(t["input_summary"]))).alias("tool_files"),
    )
    keys = list(by)
    low = F.lower("said")
    uses = {"goal": F.col("goal").isNotNull(), "action": F.length("said") >= 60, "result": T.contains_any(low, EVERY_CLAIM), "step": T.contains_any(low, T.CLAIM["in_progress"])}
    limits = F.create_map(*(F.lit(x) for pair in KEPT.items() for x in pair))
    kinds = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in uses.items())), lambda k: k.isNotNull())
    texts = numbered(row.select(*by, "at", F.coalesce("goal", "said").alias("text"), F.explode(kinds).alias("kind")), [*by, "kind"], [F.col("at")], "rank")
    sizes = texts.groupBy(*by, "kind").agg(F.max("rank").alias("n"))
    chosen = texts.join(sizes, [*by, "kind"]).where(evenly(F.col("rank"), F.col("n"), F.element_at(limits, F.col("kind"))))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "text")))), lambda x: x["text"])
    lists = chosen.groupBy(*by).agg(of("goal").alias("goals"), of("action").alias("actions"), of("result").alias("results"), of("step").alias("next_steps"))
    shown = chosen.where("kind = 'goal'").select(*by, F.explode(T.file_tokens(F.col("text"))).alias("file"))
    files = shown.union(row.select(*by, F.explode(T.file_tokens(F.col("said"))))).union(row.select(*by, F.explode("tool_files"))).distinct()
    first = Window.partitionBy(*by).orderBy("file")
    files = files.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= MOST_FILES).groupBy(*by).agg(F.array_sort(F.collect_list("file")).alias("files"))
    claims = row.where("said is not null").select(*by, "stamp", "at", T.last_claim(F.col("said")).alias("claim")).where("claim is not null")
    status = claims.groupBy(*by).agg(F.max_by("claim", F.struct("stamp", "at")).alias("status"))
    grouped = row.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("source_event_ids"),
        F.min_by("agent", "at").alias("agent"), F.min_by("model", "at").alias("model"), F.min_by("cwd", "at").alias("cwd"), F.min_by("source_file", "at").alias("source_file"),
        F.min("ts_raw").alias("started_at"), F.max("ts_raw").alias("ended_at"),
    )
    tools = row.select(*by, F.explode("tool_names").alias("tool")).where("tool <> ''").groupBy(*by).agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    out = grouped
    for part in (lists, files, status, tools):
        out = out.join(part, keys, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("goals", "actions", "results", "next_steps", "files", "tools")}).withColumn("status", F.coalesce("status", F.lit("in_progress")))
    period = F.col("day").cast("string") if "day" in by else F.lit(None).cast("string")
    return out.select(
        ids.evidence_id(period, F.col("session_id"), F.col("source_event_ids")).alias("id"), *by,
        "agent", "model", "cwd", "started_at", "ended_at", "goals", "actions", "results", "next_steps", "status",
        F.lit("latest_source_claim_unverified").alias("status_basis"), F.lit(False).alias("semantic_verified"),
        "tools", "files", "source_event_ids", "source_file",
        F.when((F.size("goals") > 0) & (F.size("actions") > 0), 0.65).otherwise(0.45).alias("confidence"),
    )


def evidence_text(evidence: DataFrame) -> DataFrame:
    """Each record as labelled lines."""
    part = lambda label, c, sep=" | ": F.concat(F.lit(label + ": "), F.array_join(c, sep))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Session "), F.col("session_id"), F.lit(" ("), F.col("agent"), F.lit(")")),
        F.concat(F.lit("Status: "), F.col("status")),
        part("Goals", "goals"), part("Actions", "actions"), part("Results", "results"), part("Next", "next_steps"), part("Files", "files", ", "), part("Sources", "source_event_ids", ", "),
    )
    return evidence.withColumn("body", lines)


def day_rollup(evidence: DataFrame) -> DataFrame:
    """Per day: tasks and counts of statuses, first goals and results, up to two next steps of each record."""
    at = F.struct("started_at", "session_id")
    return evidence.groupBy("hub_id", "day").agg(
        F.count("*").alias("tasks"),
        *(F.count_if(F.col("status") == s).alias(s) for s in ("completed", "in_progress", "blocked")),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.size("goals") > 0, F.struct(at.alias("at"), T.clip(F.col("goals")[0], 80, 79).alias("v"))))), lambda x: x["v"]), 1, 3).alias("goals"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.size("results") > 0, F.struct(at.alias("at"), T.clip(F.col("results")[0], 160, 159).alias("v"))))), lambda x: x["v"]), 1, 1).alias("conclusions"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.slice("next_steps", 1, 2).alias("v")))), lambda x: x["v"])).alias("open_loops"),
    )


def clean_files(files: F.Column) -> F.Column:
    """File names without short, numeric and bare-variable tokens; the first of each spelling, at most 12."""
    t = F.transform(files, lambda x: F.trim(x))
    kept = F.filter(t, lambda f: (F.length(f) >= 4) & ~f.rlike(r"^[\d./]+$") & ~(f.rlike(r"^(~|\$|HOME)") & ~f.contains("/")))
    return F.slice(T.first_per(kept, F.lower), 1, 12)


# Words that make a result a confirmed one, and the sentences around conclusions.
CONFIRMING = ("已完成", "已经完成", "已经修复", "已经补回", "已经成功", "已经通过", "已验证", "成功", "通过", "修复", "补回", "配置好了", "生效", "结论是", "原因是")
DONE_WITHOUT_PROOF = "证据显示该事项已完成主要处理，但没有提取到独立的最终验证结论："
STUCK = "该事项未形成完成结论，当前被证据中的失败或阻塞信息卡住。"
LAST_ACTION = "尚未形成完成结论；当前已记录的最后动作是："
NOTHING = "没有识别到足够的实际动作，无法确认该事项已完成。"


def conclusion(results: F.Column, actions: F.Column, status: F.Column) -> F.Column:
    """One bounded conclusion for a work record."""
    said, done = F.filter(F.transform(results, lambda x: F.trim(x)), lambda x: x != ""), F.filter(F.transform(actions, lambda x: F.trim(x)), lambda x: x != "")
    sure = F.filter(said, lambda r: T.contains_any(r, CONFIRMING))
    last = lambda a, n: T.clip(F.element_at(a, -1), n)
    return (
        F.when(F.size(sure) > 0, last(sure, 900)).when(F.size(said) > 0, last(said, 900))
        .when((status == "completed") & (F.size(done) > 0), F.concat(F.lit(DONE_WITHOUT_PROOF), last(done, 500)))
        .when(status == "blocked", F.lit(STUCK)).when(F.size(done) > 0, F.concat(F.lit(LAST_ACTION), last(done, 500))).otherwise(F.lit(NOTHING))
    )
