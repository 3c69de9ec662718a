"""Window operators inside sessions and days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .activity import with_priority
from .numbering import numbered

SESSION = ("hub_id", "session_id")


def representative(rows: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """``limit`` rows of each group at evenly spaced ranks (half rounds to even); at most one row for limit 1: the last."""
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).withColumn("__n", n)
    if limit <= 1:
        keep = F.col("__rank") == F.col("__n") - 1
    else:
        at = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(float(limit - 1))).cast("int"))
        keep = (F.col("__n") <= limit) | F.array_contains(at, F.col("__rank"))
    return ranked.where(keep).drop("__rank", "__n")


def anchors(events: DataFrame, long_text: int = 80) -> DataFrame:
    """Per day, agent and session: the first real user goal and the last long assistant text."""
    at = F.struct("ts", "line_no", "event_id")
    goal = (F.col("role") == "user") & (T.useful(F.col("text")) != "")
    outcome = (F.col("role") == "assistant") & (F.length(F.trim("text")) >= long_text)
    return events.groupBy("hub_id", "day", "agent", "session_id").agg(F.min(F.when(goal, at))["event_id"].alias("goal_event"), F.max(F.when(outcome, at))["event_id"].alias("outcome_event"))


def exchange(events: DataFrame, anchors: DataFrame, after: int = 3) -> DataFrame:
    """Rows around each anchor (hub_id, session_id, event_id): the user row before it up to ``after`` rows past it.

    Sessions are numbered once, and only those that are asked for are shuffled. An anchor
    names its row numbers and meets these alone, however long its session is.
    """
    order = Window.partitionBy(*SESSION).orderBy("ts", "line_no")
    numbered = events.join(anchors.select(*SESSION).distinct(), list(SESSION), "left_semi").withColumn("rn", F.row_number().over(order))
    asked = F.last(F.when(F.col("role") == "user", F.col("rn")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = numbered.withColumn("asked", F.coalesce(asked, "rn"))
    named = anchors.select(*SESSION, F.col("event_id").alias("anchor"))
    wanted = numbered.join(named, [numbered.hub_id == named.hub_id, numbered.session_id == named.session_id, numbered.event_id == named.anchor]).select(
        numbered.hub_id, numbered.session_id, "anchor", F.col("asked").alias("start"), F.col("rn").alias("target")
    )
    return (
        numbered.join(wanted.withColumn("rn", F.explode(F.sequence("start", F.col("target") + after))), [*SESSION, "rn"])
        .select(*SESSION, "anchor", "event_id", "role", "text", "ts", "line_no", (F.col("rn") == F.col("target")).alias("is_anchor"), (F.col("rn") == F.col("start")).alias("is_question"), "rn")
    )


def round_robin(events: DataFrame) -> DataFrame:
    """Order in which one row per session and pass is taken: best priority first, sessions by first appearance."""
    base = with_priority(events.where("role not in ('system', 'developer')"))
    first = F.min(F.struct("ts", "line_no", "session_id")).over(Window.partitionBy("hub_id", "day", "agent", "session_id"))
    base = base.withColumn("__first", first)
    queue = Window.partitionBy("hub_id", "day", "agent", "session_id").orderBy(F.desc("priority"), "ts", "line_no")
    base = base.withColumn("pass", F.row_number().over(queue))
    order = [F.col("pass"), F.col("__first"), F.col("agent"), F.col("session_id")]
    return numbered(base, ["hub_id", "day"], order, "turn_order").drop("__first")


def fill_forward(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each column's last non-null value so far in its group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
