"""Profile rules and task declarations: deduplication, upserts, listings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Stamp before a rule, source suffix after it.
STAMP = r"^\s*[-*]\s*\[[^\]]*\]\s*"
SOURCES = r"\s*\((?:(?:session|sha1|sources):).*\)\s*$"


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def entry_text(line: Column) -> Column:
    t = F.regexp_replace(F.trim(line), STAMP, "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "^- ", ""), SOURCES, ""))


def profile_key(text: Column) -> Column:
    """Rules that differ in width, case, white space and final punctuation only share a key; inner operators count."""
    return F.regexp_replace(F.regexp_replace(folded(text), r"(?U)\s+", ""), "[。.!！;；]+$", "")


def dedupe(entries: DataFrame) -> DataFrame:
    """Rules (hub_id, filename, seq, ts, text, session_id): latest wording of each key with all sources in first-seen order."""
    rows = entries.withColumn("key", profile_key(F.col("text"))).where("key <> ''")
    seen = F.array_sort(F.collect_list(F.struct("seq", "session_id")))
    out = rows.groupBy("hub_id", "filename", "key").agg(F.max("seq").alias("seq"), F.max_by("text", "seq").alias("text"), F.max_by("ts", "seq").alias("ts"), F.array_distinct(F.transform(seen, lambda x: x["session_id"])).alias("sources"), F.count("*").alias("wordings"))
    return out.withColumn("sources", F.filter("sources", lambda s: s.isNotNull()))


def append(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Stored and arriving rules together, deduplicated; arriving ones come later."""
    top = stored.groupBy("hub_id", "filename").agg(F.max("seq").alias("__top"))
    later = arriving.join(top, ["hub_id", "filename"], "left").withColumn("seq", F.col("seq") + F.coalesce("__top", F.lit(0))).drop("__top")
    return dedupe(stored.unionByName(later))


def recent_rules(entries: DataFrame, limit: int = 5) -> DataFrame:
    order = Window.partitionBy("hub_id", "filename").orderBy(F.desc("seq"))
    return dedupe(entries).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("hub_id", "filename", "rank", entry_text(F.col("text")).alias("text"))


def current_tasks(declarations: DataFrame) -> DataFrame:
    """Latest declaration of each agent (hub_id, agent, task, status, updated_at, seq, ...); a null task clears the agent."""
    order = Window.partitionBy("hub_id", "agent").orderBy(F.desc("updated_at"), F.desc("seq"))
    return declarations.withColumn("__n", F.row_number().over(order)).where("__n = 1 and task is not null").drop("__n")


def task_list(declarations: DataFrame, now: Column) -> DataFrame:
    tasks = current_tasks(declarations)
    return tasks.withColumn("age_minutes", F.floor((F.unix_timestamp(now) - F.unix_timestamp("updated_at")) / 60)).orderBy("hub_id", F.desc("updated_at"), "agent")
