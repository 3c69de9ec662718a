"""Rollups over events: contribution, activity by directory, live sessions, days.

All functions take and return DataFrames and group within ``hub_id``, so one busy
hub is never mixed with another. Every sum is a partial aggregate before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def contribution(events: DataFrame) -> DataFrame:
    """Output tokens of each agent:model in a session and its share of the session (4 places)."""
    who = F.concat_ws(":", F.coalesce("agent", F.lit("?")), F.coalesce("model", F.lit("?")))
    base = events.select("hub_id", F.coalesce("session_id", F.lit("unknown")).alias("session_id"), who.alias("agent_model"), F.coalesce("tokens_out", F.lit(0)).alias("tokens"), "line_no", "cwd")
    sums = base.groupBy("hub_id", "session_id", "agent_model").agg(
        F.sum("tokens").alias("tokens"), F.min(F.when(F.col("cwd") != "", F.struct("line_no", "cwd"))).alias("at")
    )
    session = Window.partitionBy("hub_id", "session_id")
    total = F.sum("tokens").over(session)
    return sums.select(
        "hub_id", "session_id", "agent_model", "tokens", total.alias("total_tokens"),
        F.when(total > 0, F.round(F.col("tokens") / total, 4)).alias("share"),
        F.coalesce(F.min("at").over(session)["cwd"], F.lit("")).alias("cwd"),
    )


def contribution_by_month(events: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """Day sums of tokens rolled up to months; ``legacy`` (hub_id, day, agent, tokens) serves days without events."""
    days = events.groupBy("hub_id", "day", "agent").agg(F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens"))
    if legacy is not None:
        missing = legacy.join(days.select("hub_id", "day").distinct(), ["hub_id", "day"], "left_anti")
        days = days.unionByName(missing.select("hub_id", "day", "agent", "tokens"))
    month = F.date_format("day", "yyyy-MM").alias("month")
    return days.groupBy("hub_id", month, "agent").agg(F.sum("tokens").alias("tokens"), F.count_distinct("day").alias("days"))


def activity(events: DataFrame) -> DataFrame:
    """Per directory: sessions, messages, tokens, prompts, first and last instant."""
    prompt = (F.col("role") == "user") & (F.trim("text") != "") & ~F.ltrim("text").rlike(r"^\[(tool_result|tool_output)\]")
    return events.groupBy("hub_id", F.when(F.coalesce("cwd", F.lit("")) == "", "(unknown cwd)").otherwise(F.col("cwd")).alias("cwd")).agg(
        F.count_distinct("session_id").alias("sessions"),
        F.count("*").alias("messages"),
        F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens"),
        F.count_if(prompt).alias("prompts"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def agent_share(events: DataFrame) -> DataFrame:
    """Percent of a directory's tokens per agent:model, one place; messages per agent:model."""
    who = F.concat_ws(":", F.coalesce("agent", F.lit("?")), F.coalesce("model", F.lit("?"))).alias("agent_model")
    sums = events.groupBy("hub_id", "cwd", who).agg(F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens"), F.count("*").alias("messages"))
    total = F.sum("tokens").over(Window.partitionBy("hub_id", "cwd"))
    return sums.withColumn("percent", F.when(total > 0, F.round(100.0 * F.col("tokens") / total, 1)))


def top_tools(events: DataFrame, limit: int = 6) -> DataFrame:
    """Most used tools of a directory; equal counts keep first-seen order."""
    used = events.select("hub_id", "cwd", F.struct("ts", "session_id", "line_no").alias("at"), F.posexplode("tool_uses").alias("pos", "tool"))
    counted = used.groupBy("hub_id", "cwd", F.coalesce("tool.name", F.lit("?")).alias("tool")).agg(F.count("*").alias("uses"), F.min(F.struct("at", "pos")).alias("seen"))
    order = Window.partitionBy("hub_id", "cwd").orderBy(F.desc("uses"), "seen", "tool")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("seen")


def recent_prompts(events: DataFrame, limit: int = 3) -> DataFrame:
    """First user prompts of each directory, one line of at most 120 characters."""
    prompts = events.where((F.col("role") == "user") & (F.trim("text") != "") & ~F.ltrim("text").rlike(r"^\[(tool_result|tool_output)\]"))
    order = Window.partitionBy("hub_id", "cwd").orderBy("ts", "session_id", "line_no")
    one = F.replace(F.trim("text"), F.lit("\n"), F.lit(" "))
    cut = F.when(F.length(one) > 120, F.concat(F.substring(one, 1, 120), F.lit("…"))).otherwise(one)
    return prompts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("hub_id", "cwd", "rank", "session_id", cut.alias("prompt"))


def live_index(events: DataFrame) -> DataFrame:
    """One row per session: first and last instant, last non-empty model and directory, count, intent, last user text."""
    at = F.struct("ts", "line_no")
    said = F.when(F.col("role") == "user", T.intent(F.col("text")))
    marked = events.withColumn("said", F.when(said != "", said))
    last = lambda c, keep: F.max_by(c, F.when(keep, at))
    return marked.groupBy("hub_id", "session_id").agg(
        F.max_by("agent", at).alias("agent"),
        last("model", F.col("model") != "").alias("model"),
        last("cwd", F.col("cwd") != "").alias("cwd"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_activity"),
        F.count("*").alias("message_count"),
        F.min_by("said", F.when(F.col("said").isNotNull(), at)).alias("intent"),
        F.max_by("said", F.when(F.col("said").isNotNull(), at)).alias("last_user"),
    )


def session_status(last_activity, now) -> F.Column:
    """active under 5 minutes of silence, idle under 30, then stale."""
    silent = F.unix_micros(now) - F.unix_micros(last_activity)
    return F.when(silent < 300_000_000, "active").when(silent < 1_800_000_000, "idle").otherwise("stale")


def recent_turns(events: DataFrame, limit: int = 20) -> DataFrame:
    """The last ``limit`` events of each session, newest rank 1."""
    order = Window.partitionBy("hub_id", "session_id").orderBy(F.desc("ts"), F.desc("line_no"))
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def live_snapshot(events: DataFrame, limit: int = 20, clip: int = 800) -> DataFrame:
    """Last turns of a session as one text; tool rows are hidden, texts cut."""
    shown = recent_turns(events, limit).where("role in ('user', 'assistant') and trim(text) <> ''")
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.substring("text", 1, clip))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), line.alias("line"))))  # at most ``limit`` rows a session
    return shown.groupBy("hub_id", "session_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("turns"))


def conversation_header(events: DataFrame) -> DataFrame:
    """Shown sessions and user and assistant messages of a day; exact duplicates and empty or tool rows do not count."""
    shown = events.where("role in ('user', 'assistant') and trim(text) <> ''").dropDuplicates(["hub_id", "day", "session_id", "event_id", "role", "text"])
    return shown.groupBy("hub_id", "day").agg(
        F.count_distinct("session_id").alias("sessions"), F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages")
    )


def conversations(events: DataFrame, clip: int = 400) -> DataFrame:
    """Readable transcript of each day and session; a session's shown turns of one day meet in one row."""
    shown = events.where("role in ('user', 'assistant') and trim(text) <> ''").dropDuplicates(["hub_id", "day", "session_id", "event_id", "role", "text"])
    line = F.concat(F.lit("**"), F.col("role"), F.lit("**: "), T.clip(F.col("text"), clip))
    rows = F.array_sort(F.collect_list(F.struct("ts", "line_no", line.alias("line"))))
    return shown.groupBy("hub_id", "day", "session_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("messages"))


def agent_sections(events: DataFrame, limit: int = 80) -> DataFrame:
    """Per agent and day: sessions, models, span, and its ``limit`` weightiest lines in original order."""
    ranked = with_priority(events.where("role not in ('system', 'developer')"))
    order = Window.partitionBy("hub_id", "day", "agent").orderBy(F.desc("priority"), "ts", "session_id", "line_no")
    lines = ranked.where("priority > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    line = F.concat(F.lit("- ["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.col("role"), F.lit(": "), T.clip(F.col("text"), 420))
    rows = F.array_sort(F.collect_list(F.struct("ts", "session_id", "line_no", line.alias("line"))))  # at most ``limit`` rows
    chosen = lines.groupBy("hub_id", "day", "agent").agg(F.transform(rows, lambda x: x["line"]).alias("lines"))
    heads = events.groupBy("hub_id", "day", "agent").agg(
        F.count_distinct("session_id").alias("sessions"), F.array_sort(F.collect_set("model")).alias("models"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return heads.join(chosen, ["hub_id", "day", "agent"], "left")


def with_priority(events: DataFrame) -> DataFrame:
    """Column ``priority``: 4 long assistant texts, 3 user texts, 2 tool uses, 1 the rest, 0 noise."""
    text = F.trim(T.blank_as_empty(F.col("text")))
    tools = F.coalesce(F.size("tool_uses"), F.lit(0)) > 0
    level = (
        F.when((T.useful(F.col("text")) == "") & ~tools, 0)
        .when((F.col("role") == "assistant") & (F.length(text) >= 80), 4)
        .when((F.col("role") == "user") & (text != ""), 3)
        .when(tools, 2)
        .otherwise(1)
    )
    return events.withColumn("priority", level)
