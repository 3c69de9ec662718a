"""Validation tables: undecodable lines, claims, issues, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bad_lines(lines: DataFrame) -> DataFrame:
    """Per file: undecodable lines and the first of them (rows: source_file, line_no, raw)."""
    good = F.try_parse_json("raw").isNotNull() & F.trim("raw").startswith("{")
    bad = lines.where((F.trim("raw") != "") & ~F.coalesce(good, F.lit(False)))
    return bad.groupBy("source_file").agg(F.count("*").alias("bad_lines"), F.min("line_no").alias("first_bad_line"))


def claims_audit(requests: DataFrame) -> DataFrame:
    """Per hub: unreadable, pending, claimed, expired and done requests (rows with ``lease``)."""
    return requests.groupBy("hub_id").agg(
        F.count_if(F.col("status").isNull()).alias("unreadable"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("lease") == "active").alias("active"),
        F.count_if(F.col("lease") == "expired").alias("expired"),
        F.count_if(F.col("status") == "done").alias("done"),
    )


def issues(bad: DataFrame, archive: DataFrame) -> DataFrame:
    """Read and integrity problems as rows (hub_id, place, issue); any of them blocks a bounded read."""
    a = bad.select("hub_id", F.col("source_file").alias("place"), F.concat(F.col("bad_lines").cast("string"), F.lit(" undecodable lines")).alias("issue"))
    b = archive.where("status = 'corrupt'").select("hub_id", F.col("month").alias("place"), F.lit("archive integrity").alias("issue"))
    return a.union(b)


def without_issues(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of hubs that have no open issue."""
    return rows.join(found.select("hub_id").distinct(), "hub_id", "left_anti")


def freshness(progress: DataFrame, now: Column, late_seconds: int = 120) -> DataFrame:
    """Per query of the health table (name, timestamp, input_rows, error): last heartbeat, lag and state."""
    last = progress.groupBy("name").agg(F.max("timestamp").alias("heartbeat"), F.sum("input_rows").alias("input_rows"), F.max_by("error", "timestamp").alias("last_error"))
    lag = F.unix_timestamp(now) - F.unix_timestamp("heartbeat")
    return last.withColumn("lag_seconds", lag).withColumn("state", F.when(F.col("last_error").isNotNull(), "failed").when(F.col("lag_seconds") > late_seconds, "late").otherwise("ok"))
