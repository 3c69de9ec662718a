"""Live sessions: status, protection, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .activity import session_status

# States of a task that no longer protect its session.
CLOSED = ("done", "completed", "archived")


def with_status(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.withColumn("status", session_status(F.col("last_activity"), now))


def protected(tasks: DataFrame) -> DataFrame:
    return tasks.where(~F.coalesce(F.col("status"), F.lit("")).isin(*CLOSED) & (F.col("session_id") != "")).select("hub_id", "session_id").distinct()


def prunable(sessions: DataFrame, logged: DataFrame, tasks: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Stale sessions past retention, not of today, logged in a day and not held by an open task.

    ``logged`` has hub_id, session_id and day of the event log.
    """
    stale = with_status(sessions, now).where(
        (F.col("status") == "stale") & (F.unix_timestamp(now) - F.unix_timestamp("last_activity") >= hours * 3600) & (F.to_date("last_activity") < F.to_date(now))
    )
    days = logged.select("hub_id", "session_id", F.col("day").alias("__day")).distinct()
    kept = stale.withColumn("__day", F.to_date("last_activity")).join(days, ["hub_id", "session_id", "__day"], "left_semi")
    return kept.join(protected(tasks), ["hub_id", "session_id"], "left_anti").drop("__day")


def by_activity(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("last_activity"), "hub_id", "session_id")
