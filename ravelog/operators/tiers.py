"""Recent and compacted tiers: duplicates, conflicts, merges, fingerprints, verification.

Rows have hub_id, day, file, line_no, event_id, raw (the stored line) and tier
('hot' or 'cold'). Identity is event id plus a digest of the line, so equal ids with
other content are conflicts and never merged silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

FILE = ("hub_id", "day", "file")


def duplicates_and_conflicts(rows: DataFrame) -> DataFrame:
    """Columns ``dup`` (the same id and content came earlier) and ``conflict_of`` (locator of the id's first copy, on the first row of each later content).

    Hot rows come first, then lines in order. Windows are keyed by event id or content
    digest, never by a whole day.
    """
    digest = F.sha1("raw")
    rows = rows.withColumn("__digest", digest).withColumn("__tier", F.when(F.col("tier") == "hot", 0).otherwise(1))
    locator = F.concat_ws("#L", F.concat_ws("/", "tier", F.col("day").cast("string"), "file"), F.col("line_no").cast("string"))
    has_id = F.coalesce(F.col("event_id") != "", F.lit(False))
    rows = rows.withColumn("locator", locator).withColumn("__id", F.when(has_id, F.col("event_id")).otherwise(F.concat(F.lit("content:"), F.col("__digest"))))
    by_id = Window.partitionBy(*FILE, "__id").orderBy("__tier", "line_no")
    same = Window.partitionBy(*FILE, "__id", "__digest").orderBy("__tier", "line_no")
    nth = F.row_number().over(same)
    first_digest, first_place = F.first("__digest").over(by_id), F.first("locator").over(by_id)
    rows = rows.withColumn("dup", nth > 1).withColumn("conflict_of", F.when(has_id & (nth == 1) & (first_digest != F.col("__digest")), first_place))
    return rows.drop("__digest", "__tier", "__id")


def merged(rows: DataFrame) -> DataFrame:
    """Hot rows, then cold rows that are no duplicates; conflicts stay."""
    return duplicates_and_conflicts(rows).where(~F.col("dup"))


def days(rows: DataFrame) -> DataFrame:
    """All known days of both tiers and where they are."""
    return rows.groupBy("hub_id", "day").agg(F.max(F.col("tier") == "hot").alias("is_hot"), F.max(F.col("tier") == "cold").alias("is_cold"))


def prefix_merge(archived: DataFrame, arriving: DataFrame) -> DataFrame:
    """Archived rows with their line numbers, then new rows; columns as given plus ``state``.

    A new line that is archived already is skipped. A day in which an id has two
    contents (archived and new, or two new ones) is refused: its new rows come back with
    state 'conflict' and its archived rows stay whole. Line numbers are data: archived
    ones never change and new ones follow the largest.
    """
    have = archived.select(*FILE, "event_id", F.sha1("raw").alias("__digest"))
    fresh = arriving.withColumn("__digest", F.sha1("raw"))
    once = Window.partitionBy(*FILE, "__digest").orderBy("line_no")
    fresh = fresh.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    fresh = fresh.join(have.select(*FILE, "__digest").distinct(), [*FILE, "__digest"], "left_anti")
    named = have.union(fresh.select(*FILE, "event_id", "__digest")).where("event_id <> ''")
    clash = named.groupBy(*FILE, "event_id").agg(F.count_distinct("__digest").alias("n")).where("n > 1").select(*FILE).distinct().withColumn("__clash", F.lit(True))
    top = archived.groupBy(*FILE).agg(F.max("line_no").alias("__top"))
    fresh = numbered(fresh.join(clash, list(FILE), "left").join(top, list(FILE), "left"), list(FILE), [F.col("line_no"), F.col("__digest")], "__nth")
    fresh = fresh.withColumn("line_no", F.when(F.col("__clash"), F.col("line_no")).otherwise(F.coalesce("__top", F.lit(0)) + F.col("__nth")))
    fresh = fresh.withColumn("state", F.when(F.col("__clash"), "conflict").otherwise("appended")).drop("__digest", "__clash", "__top", "__nth")
    return archived.withColumn("state", F.lit("archived")).unionByName(fresh)


def conflict_days(archived: DataFrame, arriving: DataFrame) -> DataFrame:
    """Days and files that a merge would refuse."""
    return prefix_merge(archived, arriving).where("state = 'conflict'").select(*FILE).distinct()


def fingerprint(rows: DataFrame, keys: list[str], fields: list[str], buckets: int = 64) -> DataFrame:
    """Order-insensitive digest of each group's rows, built in two steps so that no list holds a whole group.

    Row digests are gathered per hash bucket, bucket digests per group. ``buckets``
    grows with the largest group and is part of the digest's definition.
    """
    row = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    marked = rows.select(*keys, row.alias("h")).withColumn("b", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % buckets)
    inner = marked.groupBy(*keys, "b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    return inner.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"), F.sum("n").alias("rows"))


def manifest(rows: DataFrame) -> DataFrame:
    """Per month, day and file: rows, bytes and content digest."""
    sizes = rows.groupBy(*FILE).agg(F.sum(F.octet_length("raw") + 1).alias("bytes"))
    prints = fingerprint(rows, list(FILE), ["line_no", "raw"]).withColumnRenamed("rows", "row_count")
    return prints.join(sizes, list(FILE)).withColumn("month", F.date_format("day", "yyyy-MM"))


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Members that are missing, extra or changed."""
    e, a = (df.select(*FILE, F.struct("row_count", "bytes", "fingerprint").alias(n)) for df, n in ((expected, "e"), (actual, "a")))
    both = e.join(a, list(FILE), "full_outer")
    change = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("a") != F.col("e"), "changed")
    return both.withColumn("change", change).where("change is not null").select(*FILE, "change")


def verify(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """Per month: ok, corrupt, or derived where nothing was stored to compare with."""
    actual = manifest(rows)
    month = F.date_format("day", "yyyy-MM").alias("month")
    bad = manifest_diff(expected, actual).groupBy("hub_id", month).agg(F.count("*").alias("differences"))
    known = expected.select("hub_id", month).distinct().withColumn("stored", F.lit(True))
    seen = actual.groupBy("hub_id", "month").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"))
    out = seen.join(known, ["hub_id", "month"], "full_outer").join(bad, ["hub_id", "month"], "left")
    status = F.when(F.col("stored").isNull(), "derived").when(F.col("differences") > 0, "corrupt").otherwise("ok")
    return out.select("hub_id", "month", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("differences", F.lit(0)).alias("differences"), status.alias("status"))


def archive_index(manifest_rows: DataFrame) -> DataFrame:
    """Per month and day: members and bytes."""
    return manifest_rows.groupBy("hub_id", "month", "day").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"))


def day_inventory(files: DataFrame) -> DataFrame:
    """Files (hub_id, day, file, tier, bytes) of a day over both tiers; a hot name hides the cold one."""
    order = Window.partitionBy(*FILE).orderBy(F.when(F.col("tier") == "hot", 0).otherwise(1))
    return files.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def report_text(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Body of each report (hub_id, day, file, body): hot wins; ``overlay`` where a different cold body lies under it."""
    h, c = hot.select(*FILE, F.col("body").alias("h")), cold.select(*FILE, F.col("body").alias("c"))
    both = h.join(c, list(FILE), "full_outer")
    overlay = F.col("h").isNotNull() & F.col("c").isNotNull() & (F.col("h") != F.col("c"))
    return both.select(*FILE, F.coalesce("h", "c").alias("body"), F.when(F.col("h").isNotNull(), "hot").otherwise("cold").alias("tier"), overlay.alias("overlay"), F.when(overlay, F.col("c")).alias("cold_body"))


def archivable(months: DataFrame, today: Column, grace_days: int = 7) -> DataFrame:
    """Months (hub_id, month 'yyyy-MM') that ended more than ``grace_days`` ago and are not the current one."""
    end = F.last_day(F.to_date(F.concat("month", F.lit("-01"))))
    return months.where((F.col("month") < F.date_format(today, "yyyy-MM")) & (F.date_add(end, grace_days) < today))


def unchanged(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose fingerprint did not change between packing and deletion; only these may be dropped."""
    return before.join(after.select(*keys, F.col("fingerprint").alias("__now")), keys).where("fingerprint = __now").select(*keys)


# Remarks on archives that were checked, or could not be.
ARCHIVE_FLAGS = {"ok": "", "not_checked": "", "unverified": " (unverified)", "no_index": " (no index)", "corrupt": " (CORRUPT — quarantined)"}


def archived_months(archives: DataFrame, limit: int = 12) -> DataFrame:
    """The newest ``limit`` archives of each hub (hub_id, month, days, status) with a remark and their file. The limit is the feature."""
    newest = Window.partitionBy("hub_id").orderBy(F.desc("month"))
    remark = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ARCHIVE_FLAGS.items() for x in pair)), F.col("status")), F.lit(" ?"))
    ref = F.concat(F.lit("archive/"), F.substring("month", 1, 4), F.lit("/"), F.col("month"), F.lit(".tar.gz"))
    return archives.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= limit).select("hub_id", "month", "days", "status", remark.alias("flag"), ref.alias("ref"))


def month_status(hot: DataFrame, eligible: DataFrame, pending: DataFrame, archives: DataFrame, today: Column) -> DataFrame:
    """One row per month of either tier: where it is, why it is still recent, and its days that wait for a report.

    hot and pending have hub_id and day; eligible and archives have hub_id and month.
    """
    month = F.date_format("day", "yyyy-MM")
    recent = hot.groupBy("hub_id", month.alias("month")).agg(F.count_distinct("day").alias("days"))
    open_days = pending.groupBy("hub_id", month.alias("month")).agg(F.array_join(F.array_sort(F.collect_set(F.col("day").cast("string"))), ",").alias("pending"))  # at most 31
    rows = recent.join(archives.select("hub_id", "month", F.lit(True).alias("archived")), ["hub_id", "month"], "full").join(open_days, ["hub_id", "month"], "left")
    rows = rows.join(eligible.select("hub_id", "month").distinct().withColumn("__may", F.lit(True)), ["hub_id", "month"], "left")
    reason = F.when(F.col("days").isNull(), "archived").when(F.col("month") == F.date_format(today, "yyyy-MM"), "current").when(F.col("__may"), "eligible").otherwise("grace window")
    return rows.select("hub_id", "month", F.coalesce("days", F.lit(0)).alias("days"), F.coalesce("archived", F.lit(False)).alias("archived"), reason.alias("reason"), F.coalesce("pending", F.lit("")).alias("pending"))
