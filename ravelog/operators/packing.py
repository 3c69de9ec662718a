"""Balanced rows of each day under limits of rows, rows an agent, and size.

A day's rows stand in one order: the anchors of every session, then the first row of
every session that is left, then the second, and so on. A row is taken if it fits what is
left and passed over if not; a pass that takes nothing ends the day. Both parts run in the
same two steps: the stretch of the order in which everything allowed fits, by running
sums over at most ``total`` rows a day, and then one taken row a day and round. Every row
costs ``LEAST`` or more and the first misfit leaves less than the largest row costs, so
rounds are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .activity import with_priority
from .graph import cut
from .turns import anchors as anchor_events

LEAST = 80
DAY = ["hub_id", "day"]
SESSION = [*DAY, "agent", "session_id"]
PACKED = ("hub_id", "day", "agent", "session_id", "event_id", "line_no", "ts", "cost")


def row_cost(text: Column, tools: Column) -> Column:
    names = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(tools, F.array()), lambda t: t["name"]), lambda n: n.isNotNull() & (n != "")))), ", ")
    return (F.least(F.length(T.squeeze(text)), F.lit(400)) + F.coalesce(F.length(names), F.lit(0)) + LEAST).cast("long")


def queued(rows: DataFrame) -> DataFrame:
    """``rows`` with pass (place in their session's queue) and seq (place in the day's order)."""
    queue = Window.partitionBy(*SESSION).orderBy("place")
    marked = rows.withColumn("pass", F.row_number().over(queue))
    return marked.withColumn("seq", F.struct("pass", "first", "agent", "session_id"))


class Limits:
    """What a day may still take: ``state`` has DAY, taken, spent, last (pass of the last row taken) and agents (rows by agent)."""

    def __init__(self, per_agent: int, total: int, budget: int):
        self.per_agent, self.total, self.budget = per_agent, total, budget

    def none_taken(self, rows: DataFrame) -> DataFrame:
        empty = F.expr("cast(map() as map<string, bigint>)")
        return rows.select(*DAY).distinct().select(*DAY, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("spent"), F.lit(0).alias("last"), empty.alias("agents"))

    def of_agent(self) -> Column:
        return F.coalesce(F.try_element_at("agents", F.col("agent")), F.lit(0))

    def after(self, state: DataFrame, taken: DataFrame) -> DataFrame:
        """``state`` once ``taken`` rows are counted."""
        by_agent = taken.groupBy(*DAY, "agent").agg(F.count("*").alias("n"), F.sum("cost").alias("c"), F.max("pass").alias("p"))
        new = by_agent.groupBy(*DAY).agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.max("p").alias("p"), F.map_from_entries(F.collect_list(F.struct("agent", "n"))).alias("more"))
        merged = F.when(F.col("more").isNull(), F.col("agents")).otherwise(F.map_zip_with("agents", "more", lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))
        zero = lambda c: F.coalesce(c, F.lit(0))
        out = state.drop("at").join(new, DAY, "left")
        return out.select(*DAY, (F.col("taken") + zero("n")).alias("taken"), (F.col("spent") + zero("c")).alias("spent"), F.greatest("last", zero("p")).alias("last"), merged.alias("agents"))

    def stretch(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        """The first rows of each day that limits of number allow, at most ``total``, with ``fits``: no row up to here exceeds the budget."""
        order = lambda *keys: Window.partitionBy(*keys).orderBy("seq")
        near = rows.withColumn("nth", F.row_number().over(order(*DAY, "agent"))).where(F.col("nth") <= self.per_agent)
        near = near.join(state, DAY).where(F.col("nth") + self.of_agent() <= self.per_agent)
        near = near.withColumn("nth", F.row_number().over(order(*DAY))).where(F.col("nth") <= self.total).where(F.col("nth") + F.col("taken") <= self.total)
        return near.withColumn("fits", F.col("spent") + F.sum("cost").over(order(*DAY)) <= self.budget).select(*rows.columns, "fits")

    def chosen(self, rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows taken in their order, what is left of each day's limits)."""
        first = cut(self.stretch(rows, state))
        taken = first.where("fits").drop("fits")
        misfit = first.where("not fits").groupBy(*DAY).agg(F.min("seq").alias("at"))
        state = cut(self.after(state, taken))
        open_ = cut(state.join(misfit, DAY))
        while not open_.isEmpty():
            fitting = (F.col("seq") > F.col("at")) & (F.col("cost") + F.col("spent") <= self.budget) & (self.of_agent() < self.per_agent) & (F.col("taken") < self.total) & (F.col("pass") <= F.col("last") + 1)
            lean = open_.where(F.col("spent") + LEAST <= self.budget)
            next_ = rows.join(lean, DAY).where(fitting).groupBy(*DAY).agg(F.min_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")
            next_ = cut(next_)
            taken = taken.union(next_.select(*taken.columns))
            state = cut(self.after(state, next_))
            open_ = cut(state.join(next_.select(*DAY, F.col("seq").alias("at")), DAY))
        return taken, state


def pack(events: DataFrame, per_agent: int = 40, total: int = 80, budget: int = 32_000) -> DataFrame:
    """Balanced rows of each day (``PACKED``): every session's anchors first, then one row a session and pass by priority.

    Duplicates (``dup``, where the events have it), system and developer rows take no
    part. An anchor that did not fit stands in its session's queue again. A session is
    looked at once a pass, so rows behind its first ``total`` + 3 by priority can't be taken.
    """
    rows = events.where("role not in ('system', 'developer')")
    rows = rows.where(~F.coalesce("dup", F.lit(False))) if "dup" in rows.columns else rows
    first = F.min(F.struct("ts", "line_no")).over(Window.partitionBy(*SESSION))
    queue = Window.partitionBy(*SESSION).orderBy(F.desc("priority"), "ts", "session_id", "line_no")
    rows = with_priority(rows).withColumn("first", first).withColumn("place", F.row_number().over(queue)).withColumn("cost", row_cost(F.col("text"), F.col("tool_uses")))
    pairs = F.array(F.struct(F.col("goal_event").alias("event_id"), F.lit(0).alias("anchor")), F.struct(F.col("outcome_event").alias("event_id"), F.lit(1).alias("anchor")))
    marks = anchor_events(rows).select(*SESSION, F.inline(pairs)).where("event_id is not null").groupBy(*SESSION, "event_id").agg(F.min("anchor").alias("anchor"))
    near = rows.join(marks, [*SESSION, "event_id"], "left").where((F.col("place") <= total + 3) | F.col("anchor").isNotNull())
    near = cut(near.select(*PACKED, "first", "place", "anchor"))
    limits = Limits(per_agent, total, budget)
    anchors = near.where("anchor is not null").withColumn("pass", F.lit(0)).withColumn("seq", F.struct("first", "agent", "session_id", "anchor"))
    early, state = limits.chosen(anchors, cut(limits.none_taken(near)))
    rest = queued(near.join(early.select(*SESSION, "event_id", "line_no"), [*SESSION, "event_id", "line_no"], "left_anti"))
    late, _ = limits.chosen(cut(rest), state)
    return early.select(*PACKED).union(late.select(*PACKED))
