"""Column functions for identities, instants and locators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """Tolerant ISO instant: offsets and Z, else the leading date at midnight of the session's zone, else null."""
    t = F.trim(text)
    whole = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(t))
    return F.coalesce(whole, F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")))


def bare_date_end(text: Column) -> Column:
    """Cutoff instant of a text; a bare date means the last microsecond of its day."""
    t = F.trim(text)
    end = F.to_timestamp(F.try_to_date(t)) + F.expr("interval 1 day") - F.expr("interval 1 microsecond")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), end).otherwise(instant(t))


def line_event_id(path: Column, offset: Column, line: Column) -> Column:
    """Identity of a transcript line: SHA-256 of path, byte offset and bytes."""
    return F.sha2(F.concat(F.encode(F.concat_ws(":", path, offset.cast("string"), F.lit("")), "utf-8"), F.encode(line, "utf-8")), 256)


def snapshot_event_id(agent: Column, session_id: Column, role: Column, text: Column, ts: Column) -> Column:
    """Identity of a whole-file event, a digest of its fields as JSON in name order."""
    fields = F.struct(agent.alias("agent"), session_id.alias("session_id"), role.alias("role"), text.alias("text"), ts.alias("ts"))
    return F.concat(F.lit("snapshot:"), F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256))


def fallback_event_id(session_id: Column, ts: Column, role: Column, text: Column, line_no: Column) -> Column:
    """20 hex digits for rows without an id; the stored line number stands for the position."""
    return F.substring(F.sha1(F.to_json(F.struct(line_no.alias("line_no"), role.alias("role"), session_id.alias("session_id"), text.alias("text"), ts.alias("ts")), {"ignoreNullFields": "false"})), 1, 20)


def evidence_id(period: Column, session_id: Column, event_ids: Column) -> Column:
    key = F.concat_ws(":", F.coalesce(period, F.lit("")), session_id, F.array_join(event_ids, ","))
    return F.concat(F.lit("evidence_"), F.substring(F.sha1(key), 1, 20))


def memory_id(title: Column, content: Column) -> Column:
    return F.concat(F.lit("memory_"), F.substring(F.sha1(F.concat_ws("\n", title, content)), 1, 16))


def content_key(*fields: Column) -> Column:
    """Digest of a record's fields in a fixed order; null and empty differ."""
    return F.sha1(F.to_json(F.struct(*(f.alias(f"f{i:03d}") for i, f in enumerate(fields))), {"ignoreNullFields": "false"}))


def locator(path: Column, line_no: Column, member: Column | None = None) -> Column:
    """path#Ln, or archive!member#Ln for a row of the month tier."""
    where = path if member is None else F.concat_ws("!", path, member)
    return F.concat(where, F.when(line_no.isNotNull(), F.concat(F.lit("#L"), line_no.cast("string"))).otherwise(""))


def session_of_path(path: Column) -> Column:
    """Last five dash-separated parts of the file stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "-")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 4, F.lit(1)), F.lit(5)), "-")


def agent_label(originator: Column) -> Column:
    o = F.lower(F.coalesce(originator, F.lit("")))
    return F.when(o.contains("desktop"), "codex-desktop").when(o.contains("vscode"), "codex-vscode").otherwise("codex")


def month_end(month: Column) -> Column:
    return F.last_day(F.to_date(F.concat(month, F.lit("-01"))))


def month_days(month: Column) -> Column:
    start = F.to_date(F.concat(month, F.lit("-01")))
    return F.sequence(start, F.last_day(start))


def first_instant(*fields: Column) -> Column:
    """First of a record's time fields that parses."""
    return F.coalesce(*(instant(f) for f in fields))


def metadata_score(cwd: Column, agent: Column, wanted_cwd: Column, wanted_agent: Column) -> Column:
    """1.5 for a record's directory and 1 for its agent, where they are asked for and the same."""
    same = lambda asked, own: F.coalesce((asked != "") & (asked == own), F.lit(False))
    return F.when(same(wanted_cwd, cwd), 1.5).otherwise(0.0) + F.when(same(wanted_agent, agent), 1.0).otherwise(0.0)
