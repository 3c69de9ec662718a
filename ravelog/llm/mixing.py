"""Mixing sources to target weights by Efraimidis-Spirakis keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, small_side

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1: word lengths near six code points and longer texts weigh more."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.when(size > 0, (1 - F.exp(-size / 50)) / (1 + F.abs(F.log(mean / 6)))).otherwise(F.lit(1e-6))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target of a table (source, source_size), one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share all sizes;
    a target stops at ``most`` times its source's size and the rest is shared again
    by weight. Sorted by the level at which they stop, the stopped sources are a
    prefix, so one pass finds the common level.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("stop", F.col("cap") / F.col("w"))
    order = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before, after, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    t = t.withColumn("common", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(all_rows)["level"])
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("common") * F.col("w"), F.col("cap"))).alias("target"))


LEVELS = ((1 << 10, 1), (1 << 10, 1 << 12))  # buckets a unit of ln(key), then parts of such a bucket
SALTS = 64


def by_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``plan``, which has one row for each source (``of``).

    A plan of proven size is broadcast; a larger one is repeated ``SALTS`` times and met
    under (source, salt), so no source is a task of its own.
    """
    same = rows["source"].eqNullSafe(plan["of"])
    size = plan.agg(F.coalesce(F.sum(F.lit(128) + F.coalesce(F.octet_length("of"), F.lit(0))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(plan), same).drop("of")
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("own_salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, dealt["source"].eqNullSafe(salted["of"]) & (dealt["own_salt"] == salted["salt"])).drop("of", "salt", "own_salt")


def narrowed(rows: DataFrame, plan: DataFrame, per_unit: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """One step towards the key at which each source's budget ends.

    Returns the open rows (of the bucket in which it ends) and the plan with that bucket
    (``last``) and what the rows before it take (``start``).
    """
    scaled = F.col("x") * per_unit
    bucket = F.floor(scaled) if parts == 1 else F.floor((scaled - F.floor(scaled)) * parts)
    rows = rows.withColumn("bucket", bucket.cast("long"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)))
    p, s = plan.alias("p"), starts.alias("s")
    begins = F.col("p.start") + F.col("s.before")
    ends = p.join(s, F.col("p.of").eqNullSafe(F.col("s.source")) & (begins < F.col("p.rest")) & (begins + F.col("s.bucket_size") >= F.col("p.rest")), "left")
    kept = [F.col(f"p.{c}").alias(c) for c in plan.columns if c != "start"]
    plan = cut(ends.select(*kept, F.coalesce(begins, F.col("p.start")).alias("start"), F.col("s.bucket").alias("last")))
    return rows, plan


def mix(docs: DataFrame, seed: int = 42, levels: tuple[tuple[int, int], ...] = LEVELS, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    A document gets the key -ln(u) / w of Efraimidis and Spirakis, u from a hash of
    its id, source and text, w its quality weight. A source whose target is over its
    size is taken whole as often as fits; the rest of the target is filled in key
    order, and the document at the budget is cut to it. Prefix sums run over buckets of
    ln(key), whose spread is the same for every weight, then over parts of the one bucket
    in which the budget ends, then over the rows of one part: no source is a task of its own.

    Null texts have size 0 and are never taken; null sources form one source. Repeated
    rows count each; those at the budget share what is left evenly, so reruns agree. Other
    columns are ignored. An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    unit = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source", text), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), text.alias("text"), unit.alias("unit"))
    rows = cut(rows.select("doc_id", "source", "size", (-F.log("unit") / quality_weight(F.col("text"), F.col("size"))).alias("key")).withColumn("x", F.log("key")))
    budget = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = budget.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = cut(budget.withColumnRenamed("source", "of").withColumn("start", F.lit(0).cast("long")))
    answer = lambda df, part: df.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
    names, closed = rows.columns, []
    for per_unit, parts in levels:
        rows, plan = narrowed(rows, plan, per_unit, parts)
        met = by_source(rows, plan)
        # Null where the budget is used up, or nothing is asked for: all buckets stay closed then.
        before = F.when(F.col("last").isNull(), F.col("start") < F.col("rest")).otherwise(F.col("bucket") < F.col("last"))
        closed.append(answer(met.where(F.col("last").isNull() | (F.col("bucket") != F.col("last"))), F.when(before, F.col("size")).otherwise(0)))
        rows, plan = met.where("bucket = last").select(*names), plan.drop("last")
    # Equal rows share a key; what the budget leaves of them is dealt evenly.
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    alike = rows.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n"))
    alike = by_source(alike, plan).withColumn("room", F.col("rest") - F.col("start") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0)))
    share = F.greatest(F.lit(0), F.least(F.col("n") * F.col("size"), F.col("room")))
    alike = cut(alike.select("source", "key", "doc_id", "size", "n", share.alias("share")).where("share > 0"))
    numbered = numbered_copies(rows, alike)
    part = F.when(F.col("share").isNull(), 0).otherwise(F.floor(F.col("share") / F.col("n")) + (F.col("copy") < F.col("share") % F.col("n")).cast("long"))
    out = answer(by_source(numbered, plan), part)
    for df in closed:
        out = out.union(df)
    return out


def numbered_copies(rows: DataFrame, alike: DataFrame) -> DataFrame:
    """``rows`` with n and share of their equals in ``alike`` (null without one) and ``copy``, a number of each among them.

    Copies are numbered within their partition and partitions are offset by their counts,
    so a row repeated very often is still dealt over all tasks. Which copy gets which
    number is of no matter, as they are equal.
    """
    key = ["source", "key", "doc_id", "size"]
    placed = cut(rows.withColumn("pid", F.spark_partition_id()))
    counts = placed.groupBy(*key, "pid").agg(F.count("*").alias("here"))
    upto = Window.partitionBy(*key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("here").over(upto), F.lit(0))).drop("here")
    named = [F.col(c).alias(f"o_{c}") for c in [*key, "pid"]]
    same = lambda left, prefix, names: reduce(and_, (left[c].eqNullSafe(F.col(f"{prefix}{c}")) for c in names))
    inner = placed.withColumn("in_pid", F.row_number().over(Window.partitionBy(*key, "pid").orderBy(F.lit(0))) - 1)
    offset = offsets.select(*named, "offset")
    out = inner.join(offset, same(inner, "o_", [*key, "pid"])).select(*key, (F.col("in_pid") + F.col("offset")).alias("copy"))
    shares = alike.select(*(F.col(c).alias(f"a_{c}") for c in key), "n", "share")
    return out.join(small_side(shares), same(out, "a_", key), "left").select(*key, "copy", "n", "share")
