"""Append-only decision log: validation, as-of state, supersede graph, annotation.

Tables: memories (hub_id, id, status, created_at, supersedes, line_no, ...) and
decision_events (hub_id, id, memory_id, decision, reason, ts, source_session_ids,
source_event_ids, replacement_ids, reverses, target STRUCT<session_id, event_id>, line_no).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..sources import versions
from .graph import cut, cycle_nodes, gathered, key, small_side, trimmed, written

# Enumerations of the log and of memories.
DECISIONS = ("accepted", "rejected", "superseded")
INACTIVE = ("superseded", "stale", "archived")
MEMORY_TYPES = ("constraint", "preference", "architecture", "workflow", "lesson", "fact")
MEMORY_STATUSES = ("active", "superseded", "stale", "archived")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def filled(c: Column) -> Column:
    """Number of non-empty strings of an array; null counts as none."""
    return F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False))))


def holes(c: Column) -> Column:
    return F.coalesce(F.exists(c, lambda x: x.isNull() | (x == "")), F.lit(False))


def event_problem(e: DataFrame) -> Column:
    """First reason why a stored event is malformed; null for a good one."""
    repl = filled(F.col("replacement_ids"))
    return (
        F.when(blank(F.col("id")), "id")
        .when(blank(F.col("memory_id")), "memory_id")
        .when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "decision")
        .when(ids.instant(F.col("ts")).isNull(), "ts")
        .when(blank(F.col("reason")), "reason")
        .when(holes(F.col("source_session_ids")) | holes(F.col("source_event_ids")), "sources")
        .when(filled(F.col("source_session_ids")) + filled(F.col("source_event_ids")) == 0, "no_source")
        .when(holes(F.col("replacement_ids")), "replacements")
        .when((F.col("decision") == "superseded") & ((repl == 0) | F.coalesce(F.array_contains("replacement_ids", F.col("memory_id")), F.lit(False))), "replacements")
        .when((F.col("decision") != "superseded") & (repl > 0), "replacements")
        .when(F.col("target").isNotNull() & (F.col("target.session_id").isNull() | F.col("target.event_id").isNull()), "target")
    )


def check_events(events: DataFrame) -> DataFrame:
    return events.withColumn("problem", event_problem(events))


def strict(events: DataFrame) -> DataFrame:
    """The events, failing the job if any is malformed: a broken revocation must not be skipped."""
    checked = check_events(events)
    safe = F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("malformed decision event at line"), F.col("line_no").cast("string"), F.col("problem"))).cast("boolean"))
    return checked.where(safe).drop("problem")


def as_of(events: DataFrame, cutoff: Column | None) -> DataFrame:
    """Events strictly before a cutoff instant; all of them without one."""
    return events if cutoff is None else events.where(ids.instant(F.col("ts")) < cutoff)


def memory_problem() -> Column:
    return (
        F.when(blank(F.col("title")) | blank(F.col("content")), "title_or_content")
        .when(~F.coalesce(F.col("type"), F.lit("fact")).isin(*MEMORY_TYPES), "type")
        .when(~F.coalesce(F.col("status"), F.lit("active")).isin(*MEMORY_STATUSES), "status")
        .when(~F.coalesce(F.col("confidence"), F.lit(0.7)).between(0, 1), "confidence")
        .when(filled(F.col("source_session_ids")) + filled(F.col("source_event_ids")) == 0, "no_source")
    )


def new_memories(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Valid memories that are not stored yet, one per id (first line); invalid ones carry ``problem``."""
    named = raw.withColumn("problem", memory_problem()).withColumn("id", F.coalesce(F.when(F.col("id") != "", F.col("id")), ids.memory_id(F.trim("title"), F.trim("content"))))
    first = Window.partitionBy("hub_id", "id", F.col("problem").isNull()).orderBy("line_no")
    fresh = named.withColumn("__n", F.row_number().over(first)).where("problem is not null or __n = 1").drop("__n")
    known = stored.select("hub_id", "id").distinct().withColumn("__known", F.lit(True))
    return fresh.join(known, ["hub_id", "id"], "left").where("problem is not null or __known is null").drop("__known")


def duplicated(memories: DataFrame) -> DataFrame:
    return memories.where("id is not null and id <> ''").groupBy("hub_id", "id").agg(F.count("*").alias("copies")).where("copies > 1")


def latest_memories(memories: DataFrame) -> DataFrame:
    last = Window.partitionBy("hub_id", "id").orderBy(F.desc("line_no"))
    return memories.where("id is not null and id <> ''").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def latest_events(events: DataFrame) -> DataFrame:
    """Latest event of each memory by instant, then line."""
    last = Window.partitionBy("hub_id", "memory_id").orderBy(F.desc(ids.instant(F.col("ts"))), F.desc("line_no"))
    return events.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def structural_edges(memories: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """replaced -> replacement from ``supersedes``; with a cutoff only replacements created before it."""
    rows = memories.where("id is not null and id <> ''")
    if cutoff is not None:
        rows = rows.where(ids.instant(F.col("created_at")) < cutoff)
    return rows.select("hub_id", F.explode("supersedes").alias("src"), F.col("id").alias("dst")).distinct()


def decision_edges(latest: DataFrame, memories: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """replaced -> replacement of memories whose latest event supersedes them."""
    edges = latest.where("decision = 'superseded'").select("hub_id", F.col("memory_id").alias("src"), F.explode("replacement_ids").alias("dst"))
    if cutoff is not None:
        made = latest_memories(memories).select("hub_id", F.col("id").alias("dst"), ids.instant(F.col("created_at")).alias("__made"))
        edges = edges.join(made, ["hub_id", "dst"], "left").where(F.col("__made").isNull() | (F.col("__made") < cutoff))
    return edges.select("hub_id", "src", "dst").distinct()


def edges_of(memories: DataFrame, events: DataFrame, cutoff: Column | None = None) -> DataFrame:
    return structural_edges(memories, cutoff).union(decision_edges(latest_events(as_of(events, cutoff)), memories, cutoff)).distinct()


# Cautions shown with a state.
UNKNOWN = "unknown memory id"
AMBIGUOUS = "ambiguous: duplicated memory id"
CYCLE = "cycle in supersede graph"
CONFLICT = "conflict: accepted but supersede edges still exist"
REJECTED = "historical: rejected — retained as caution, not recommended"


def states(memories: DataFrame, events: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Effective state of every memory and every id that the log names."""
    events = as_of(events, cutoff)
    last = latest_events(events)
    edges = edges_of(memories, events, cutoff)
    of = lambda key, value, name: edges.groupBy("hub_id", F.col(key).alias("memory_id")).agg(F.array_sort(F.collect_set(value)).alias(name))
    cycles = cycle_nodes(edges).select("hub_id", F.col("node").alias("memory_id"), F.lit(True).alias("cycle"))
    record = latest_memories(memories).select("hub_id", F.col("id").alias("memory_id"), F.col("status").alias("record_status"), F.lit(True).alias("__known"))
    twice = duplicated(memories).select("hub_id", F.col("id").alias("memory_id"), F.lit(True).alias("ambiguous"))
    event = last.select("hub_id", "memory_id", "decision", "reason", F.col("ts").alias("effective_at"), F.col("id").alias("event_id"), "source_session_ids", "source_event_ids")
    none = F.array().cast("array<string>")
    key = ["hub_id", "memory_id"]
    out = record.join(event, key, "full_outer")
    for more in (of("src", "dst", "replaced_by"), of("dst", "src", "replaces"), cycles, twice):
        out = out.join(more, key, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = out.withColumns({"replaced_by": F.coalesce("replaced_by", none), "replaces": F.coalesce("replaces", none), "cycle": yes("cycle"), "ambiguous": yes("ambiguous"), "missing_record": F.col("__known").isNull()})
    replaced = F.size("replaced_by") > 0
    out = out.withColumn("conflict", F.coalesce((F.col("decision") == "accepted") & replaced, F.lit(False)))
    out = out.withColumn("state", F.coalesce("decision", F.when(replaced | (F.col("record_status") == "superseded"), "superseded").otherwise("unmarked")))
    caution = (
        F.when(F.col("missing_record"), UNKNOWN).when(F.col("ambiguous"), AMBIGUOUS).when(F.col("cycle"), CYCLE).when(F.col("conflict"), CONFLICT)
        .when(F.col("state") == "rejected", REJECTED)
        .when((F.col("state") == "superseded") & replaced, F.concat(F.lit("superseded: replaced by "), F.array_join("replaced_by", ", ")))
        .when(F.col("state") == "superseded", "superseded")
        .when(F.col("record_status").isin(*INACTIVE), F.concat(F.lit("legacy record status: "), F.col("record_status")))
    )
    stopped = F.col("state").isin("rejected", "superseded") | F.col("cycle") | F.col("ambiguous") | F.col("missing_record") | F.col("conflict") | F.coalesce(F.col("record_status").isin("stale", "archived"), F.lit(False))
    out = out.withColumn("caution", caution).withColumn("recommended", ~stopped)
    return out.withColumn("rank_hint", F.when(F.col("recommended"), "neutral").otherwise("demote")).drop("__known")


def target_marks(events: DataFrame) -> DataFrame:
    """Latest mark on each exact (session, event) target."""
    last = Window.partitionBy("hub_id", "target.session_id", "target.event_id").orderBy(F.desc(ids.instant(F.col("ts"))), F.desc("line_no"))
    rows = events.where("target.session_id <> '' and target.event_id <> ''").withColumn("__n", F.row_number().over(last)).where("__n = 1")
    return rows.select("hub_id", F.col("target.session_id").alias("session_id"), F.col("target.event_id").alias("event_id"), F.col("decision").alias("state"), F.col("memory_id").alias("marked_memory"), "reason")


def annotate(docs: DataFrame, memories: DataFrame, events: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """``docs`` (hub_id, memory_id, session_id, event_id, ...) with decision STRUCT<state, recommended, caution>, null without one.

    A memory id wins; an id that looks like one but is unknown is demoted; else the
    latest mark on the exact session and event counts. Nothing is dropped.
    """
    compact = lambda state, ok, caution: F.struct(state.alias("state"), ok.alias("recommended"), caution.alias("caution"))
    s = states(memories, events, cutoff).select("hub_id", "memory_id", compact(F.col("state"), F.col("recommended"), F.col("caution")).alias("__by_memory"))
    marks = target_marks(as_of(events, cutoff))
    good = ~F.col("state").isin("rejected", "superseded")
    caution = F.when(~good, F.concat(F.lit("historical: "), F.col("state"), F.lit(" — retained as caution, not recommended")))
    m = marks.select("hub_id", "session_id", "event_id", compact(F.col("state"), good, caution).alias("__by_target"))
    unknown = F.when(F.col("memory_id").startswith("memory_"), compact(F.lit("unknown"), F.lit(False), F.lit(UNKNOWN)))
    out = docs.join(s, ["hub_id", "memory_id"], "left").join(m, ["hub_id", "session_id", "event_id"], "left")
    return out.withColumn("decision", F.coalesce("__by_memory", unknown, F.when(F.col("memory_id").isNull() | ~F.col("memory_id").startswith("memory_"), F.col("__by_target")))).drop("__by_memory", "__by_target")


def check_marks(marks: DataFrame, memories: DataFrame, events: DataFrame) -> DataFrame:
    """Candidate marks with ``problem``: shape, unknown or doubled targets, self or cyclic replacement, unknown ``reverses``.

    Marks are taken in the order of ``line_no``: one that was accepted before counts as
    the latest event of its memory for those after it.
    """
    rows = written(marks.withColumn("__mark", F.monotonically_increasing_id()))  # numbered once: later branches read the written rows
    shape = (
        F.when(blank(F.col("memory_id")), "memory_id required")
        .when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "decision")
        .when(blank(F.col("reason")), "reason required")
        .when(filled(F.col("source_session_ids")) + filled(F.col("source_event_ids")) == 0, "source required")
        .when((F.col("decision") == "superseded") & (filled(F.col("replacement_ids")) == 0), "replacement required")
        .when((F.col("decision") != "superseded") & (filled(F.col("replacement_ids")) > 0), "replacement only for superseded")
        .when(F.coalesce(F.array_contains("replacement_ids", F.col("memory_id")), F.lit(False)), "self supersession")
        .when(F.col("ts").isNotNull() & ids.instant(F.col("ts")).isNull(), "ts")
    )
    good = rows.where(shape.isNull())
    # what a mark names, looked up in one join; the largest code of a mark is its problem
    known = memories.where("id is not null and id <> ''").groupBy("hub_id", F.col("id").alias("name")).agg((F.count("*") > 1).alias("twice"))
    target = F.array(F.struct(F.col("memory_id").alias("name"), F.lit(True).alias("target")))
    named = F.transform(F.coalesce("replacement_ids", F.array().cast("array<string>")), lambda x: F.struct(x.alias("name"), F.lit(False).alias("target")))
    needed = good.select("hub_id", "__mark", "memory_id", F.explode(F.concat(target, named)).alias("n")).select("hub_id", "__mark", "memory_id", "n.*")
    code = F.when(F.col("twice"), F.when(F.col("target"), 5).otherwise(3)).when(F.col("twice").isNull(), F.when(F.col("target"), 4).otherwise(2))
    failed = needed.join(known, ["hub_id", "name"], "left").withColumn("code", code).where("code is not null").select("hub_id", "__mark", "memory_id", "code")
    back = good.where("reverses is not null").join(events.select("hub_id", F.col("id").alias("reverses")).distinct(), ["hub_id", "reverses"], "left_anti")
    failed = failed.union(back.select("hub_id", "__mark", "memory_id", F.lit(1)))
    failed = written(failed.groupBy("__mark").agg(F.first("hub_id").alias("hub_id"), F.first("memory_id").alias("memory_id"), F.max("code").alias("code")))
    loops = closing_marks(good, memories, events, failed)
    found = small_side(failed.select("__mark", "code").union(loops.select("__mark", F.lit(0))))
    says = F.when(F.col("code") == 0, "cycle")
    for n, problem in enumerate(("unknown reverses", "unknown replacement", "ambiguous replacement", "unknown target", "ambiguous target"), 1):
        says = says.when(F.col("code") == n, problem)
    return rows.join(found, "__mark", "left").select(*marks.columns, F.coalesce(shape, says).alias("problem"))


ITEM = ("hub_id", "line", "mark", "memory", "what", "to")


def closing_marks(marks: DataFrame, memories: DataFrame, events: DataFrame, failed: DataFrame) -> DataFrame:
    """``__mark`` of the marks that close a loop of replacements with what holds when their turn comes.

    ``failed`` (__mark, hub_id, memory_id) are marks that don't count. An edge of the log
    holds until the next accepted mark on its memory. Marks and edges that hang together by
    a memory are gathered, and the task that holds them takes the marks in turn; larger
    groups are decided in ``rounds``.
    """
    none = F.array().cast("array<string>")
    item = lambda df, what, memory, to, line=F.lit(None), mark=F.lit(None): df.select("hub_id", line.cast("long").alias("line"), mark.cast("long").alias("mark"), F.col(memory).alias("memory"), F.lit(what).alias("what"), to.alias("to"))
    to = F.coalesce("replacement_ids", none)
    turn = {"line": F.col("line_no"), "mark": F.col("__mark")}
    items = item(marks.where("decision = 'superseded'"), "replace", "memory_id", to, **turn).union(item(marks.where("decision <> 'superseded'"), "free", "memory_id", none, **turn))
    items = items.union(item(failed, "failed", "memory_id", none, mark=F.col("__mark")))
    items = items.union(item(structural_edges(memories), "fixed", "src", F.array("dst")))
    items = items.union(item(latest_events(events).where("decision = 'superseded'"), "old", "memory_id", to))
    ends = lambda x: F.concat(F.array(key(x["hub_id"], x["memory"])), F.transform(x["to"], lambda y: key(x["hub_id"], y)))
    groups, rest = gathered(items, ends)
    refused = groups.mapInArrow(_refused, "__mark long")
    if rest is None:
        return refused
    taken = rest.where("what in ('replace', 'free')").join(rest.where("what = 'failed'").select("mark"), "mark", "left_anti")
    rows = taken.select("hub_id", F.col("mark").alias("__mark"), F.col("line").alias("line_no"), F.col("memory").alias("memory_id"), F.when(F.col("what") == "replace", "superseded").otherwise("free").alias("decision"), F.col("to").alias("replacement_ids"))
    fixed = rest.where("what = 'fixed'").select("hub_id", F.col("memory").alias("src"), F.explode("to").alias("dst"))
    return refused.union(rounds(rows, fixed, rest.where("what = 'old'").select("hub_id", F.col("memory").alias("memory_id"), "to")))


def _refused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks that close a loop, each group of items taken in the order of line and mark."""
    for batch in batches:
        items = batch.column(0)
        offsets = np.r_[0, np.cumsum(items.value_lengths().to_numpy())].tolist()
        own = items.flatten()
        rows = list(zip(*(own.field(i).to_pylist() for i in range(len(ITEM))), strict=True))
        out = []
        for low, high in zip(offsets, offsets[1:], strict=False):
            fixed, latest, failed, marks = defaultdict(list), {}, set(), []
            for hub, line, mark, memory, what, to in rows[low:high]:
                if what == "fixed":
                    fixed[hub, memory] += to
                elif what == "old":
                    latest[hub, memory] = to
                elif what == "failed":
                    failed.add(mark)
                else:
                    marks.append((line is not None, line or 0, mark, hub, memory, to))
            for *_, mark, hub, memory, to in sorted(marks, key=lambda m: m[:3]):
                if mark in failed:
                    continue
                seen, left = set(), list(to)
                while left and memory not in seen:
                    if (node := left.pop()) not in seen:
                        seen.add(node)
                        left += fixed.get((hub, node), ())
                        left += latest.get((hub, node), ())
                if memory in seen:
                    out.append(mark)
                else:
                    latest[hub, memory] = to
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["__mark"])


def rounds(marks: DataFrame, fixed: DataFrame, old: DataFrame) -> DataFrame:
    """``closing_marks`` by joins: marks (hub_id, __mark, line_no, memory_id, decision, replacement_ids), fixed edges, and what earlier marks replace (hub_id, memory_id, to).

    Rounds decide all marks at once where they can: one that closes no loop even if every
    open mark before it is accepted (and revokes nothing) is accepted, one that closes a loop
    even if no open mark before it adds an edge (and each revokes) is refused. The first open mark of every
    loop is always decided, so rounds go on until none is open; two do where loops do not
    hang together.
    """
    turn = F.struct(F.col("line_no").cast("long").alias("line"), F.col("__mark").alias("n"))
    rows = cut(marks.select("hub_id", "__mark", turn.alias("turn"), "memory_id", "decision", "replacement_ids"))
    none = F.array().cast("array<string>")
    start, end = (F.struct(F.lit(x).cast("long").alias("line"), F.lit(x).cast("long").alias("n")) for x in (-(1 << 62), 1 << 62))
    fixed = fixed.select("hub_id", "src", "dst", start.alias("since"), end.alias("until"))
    old = old.select("hub_id", "memory_id", start.alias("since"), "to")
    state = cut(rows.select("__mark", F.lit("open").alias("state")))
    while not state.where("state = 'open'").isEmpty():
        now = rows.join(state, "__mark")
        decided = {}
        for hopeful in (True, False):
            adds = now.where("state in ('open', 'accepted')" if hopeful else "state = 'accepted'")
            ends = now.where("state = 'accepted'" if hopeful else "state in ('open', 'accepted')").select("hub_id", "memory_id", F.col("turn").alias("at"), F.lit(False).alias("edge"), none.alias("to"))
            own = adds.where("decision = 'superseded'").select("hub_id", "memory_id", F.col("turn").alias("since"), F.coalesce("replacement_ids", none).alias("to"))
            spans = old.union(own).select("hub_id", "memory_id", F.col("since").alias("at"), F.lit(True).alias("edge"), "to").union(ends)
            # an edge ends with the next mark on its memory; in this order a mark's edges come before its own end
            order = Window.partitionBy("hub_id", "memory_id").orderBy(F.desc("at"), F.desc("edge"))
            spans = spans.withColumn("next", F.min(F.when(~F.col("edge"), F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("edge")
            edges = spans.select("hub_id", F.col("memory_id").alias("src"), F.explode("to").alias("dst"), F.col("at").alias("since"), F.coalesce("next", end).alias("until"))
            open_ = now.where("state = 'open' and decision = 'superseded'").select("hub_id", "__mark", "turn", F.col("memory_id").alias("home"), F.explode("replacement_ids").alias("node"))
            decided[hopeful] = returning(open_, cut(fixed.union(edges)))
        maybe, surely = (decided[h].select("__mark", F.lit(True).alias(n)) for h, n in ((True, "__maybe"), (False, "__surely")))
        new = F.when(F.col("state") != "open", F.col("state")).when(F.col("__maybe").isNull(), "accepted").when(F.col("__surely"), "refused").otherwise("open")
        state = cut(state.join(maybe, "__mark", "left").join(surely, "__mark", "left").select("__mark", new.alias("state")))
    return state.where("state = 'refused'").select("__mark")


def returning(open_: DataFrame, edges: DataFrame) -> DataFrame:
    """``__mark`` of the rows (hub_id, __mark, turn, home, node) from whose node a way leads to ``home`` over edges that hold at ``turn``."""
    both = cut(trimmed(edges.select("hub_id", "src", "dst").union(open_.select("hub_id", F.col("home").alias("src"), F.col("node").alias("dst"))).distinct()))
    core = cut(edges.join(both, ["hub_id", "src", "dst"], "left_semi"))
    seen = frontier = cut(open_.join(both.select("hub_id", F.col("src").alias("node")).distinct(), ["hub_id", "node"], "left_semi").distinct())
    while not frontier.isEmpty():
        step = frontier.where("node <> home").withColumnRenamed("node", "src").join(core, ["hub_id", "src"])
        found = step.where((F.col("since") < F.col("turn")) & (F.col("turn") <= F.col("until"))).select(*open_.columns[:4], F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, ["__mark", "node"], "left_anti").select(*seen.columns))
        seen = cut(seen.union(frontier))
    return seen.where("node = home").select("__mark").distinct()


EVENT = "hub_id string, id string, memory_id string, decision string, reason string, ts string, source_session_ids array<string>, source_event_ids array<string>, replacement_ids array<string>, reverses string, target struct<session_id:string,event_id:string>, line_no long"


def stored_events(spark: SparkSession, root: str, without: str | None = None) -> DataFrame:
    """The decision log in ``root``; ``without`` leaves one batch out."""
    if not versions.exists(spark, f"{root}/decision_events"):
        return spark.createDataFrame([], EVENT)
    rows = spark.read.schema(EVENT + ", batch string").parquet(f"{root}/decision_events")
    return (rows if without is None else rows.where(F.col("batch") != without)).drop("batch")


def record_marks(marks: DataFrame, memories: DataFrame, root: str, batch: str) -> DataFrame:
    """Check a batch of marks in order and append the accepted ones, with ids, to the log in ``root``; returns all with ``problem`` and ``id``.

    ``batch`` names the batch: run again after a stop, it replaces what it wrote and is
    checked against the log as it was before it. Marks without an instant get the time
    of the run.
    """
    spark = marks.sparkSession
    before = written(stored_events(spark, root, batch))
    checked = written(check_marks(marks, memories, before))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    named = written(mark_ids(checked.where("problem is null"), before))
    out = named.withColumn("ts", F.coalesce("ts", stamp)).withColumn("batch", F.lit(batch))
    out.select(*(c.split()[0] for c in EVENT.split(", ")), "batch").hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/decision_events")
    return named.unionByName(checked.where("problem is not null"), allowMissingColumns=True)


def mark_ids(marks: DataFrame, events: DataFrame) -> DataFrame:
    """Accepted marks with ids: digest of the fields, numbered where the digest is taken."""
    fields = ("memory_id", "decision", "reason", "source_session_ids", "source_event_ids", "replacement_ids", "reverses", "target", "ts")
    digest = F.substring(F.sha1(F.to_json(F.struct(*fields))), 1, 16)
    rows = marks.withColumn("__digest", digest)
    taken = events.select("hub_id", F.regexp_extract("id", "^dec_([0-9a-f]{16})", 1).alias("__digest")).groupBy("hub_id", "__digest").agg(F.count("*").alias("__taken"))
    order = Window.partitionBy("hub_id", "__digest").orderBy("memory_id", "ts", "line_no")
    nth = F.row_number().over(order) + F.coalesce("__taken", F.lit(0))
    rows = rows.join(taken, ["hub_id", "__digest"], "left").withColumn("__nth", nth)
    return rows.withColumn("id", F.concat(F.lit("dec_"), F.col("__digest"), F.when(F.col("__nth") > 1, F.concat(F.lit("_"), F.col("__nth").cast("string"))).otherwise(""))).drop("__digest", "__taken", "__nth")
