"""Token index of a corpus, stored by day and term bucket and refreshed by changed days.

Folder layout (Parquet): ``postings`` by day and bucket, ``terms`` (document frequency
in each day) by day and bucket, ``features`` (what ranking needs of a document, worked out
once) by day, ``sums`` (documents and tokens by day, agent and source) by day, and
``days``, the list of valid days with their signatures, one folder for each version. A
refresh overwrites the partitions of changed days and publishes the list last: a run that
stops between leaves the old signatures, so the next one rebuilds the same days. Readers
see only listed days, so a day that left the corpus needs no deletion.

Undated rows lie in day ``NO_DAY``. Bucket -1 of ``postings`` has one row for each
document (term null) with its length and what filters ask for.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.compaction import signed
from ..operators.graph import shared_folder
from ..sources import versions

NO_DAY = "0001-01-01"
BUCKETS = 16
META = ("instant", "agent", "source", "session_id")
KINDS = {"instant": "timestamp", "agent": "string", "source": "string", "session_id": "string", "day": "date", "text": "string"}
BATCH = 200_000
SEGMENT = re.compile(T.SEGMENT)
EDGES = "._:/-"


def words(text: str) -> Iterator[str]:
    """What ``T.tokenize`` gives for one text: word runs with singulars, CJK characters and bigrams."""
    for s in SEGMENT.findall(text):
        if "一" <= s[0] <= "鿿":
            yield from s
            yield from map("".join, zip(s, s[1:], strict=False))
        elif len(w := s.strip(EDGES).lower()) >= 2:
            yield w
            if len(w) > 3 and w[-1] == "s" and w[-2] != "s":
                yield w[:-1]


def literal(days: list) -> list[Column]:
    """Dates as literals; the first years can't cross as Python dates."""
    return [F.lit(str(d)).cast("date") for d in days]


def filled(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return docs.select("*", *(F.lit(None).cast(KINDS[c]).alias(c) for c in names if c not in docs.columns))


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt over all cores where they come in fewer splits than that: working on a text costs more than moving it."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= 2 * cores else docs.repartition(2 * cores)


def posted(docs: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """hub_id, day, doc_id, filter columns, term, tf, length: a row for each term of a document and one with a null term.

    A document's terms are counted where it is read, so nothing is shuffled. ``only`` are
    the terms that get rows (all of them without it); lengths count every term.
    """
    asked = None if only is None else docs.sparkSession.sparkContext.broadcast(only)
    texts = filled(docs, ("day", "text", *META)).select("hub_id", F.coalesce("day", F.lit(NO_DAY).cast("date")).alias("day"), "doc_id", *META, "text")
    own = texts.columns[:-1]
    schema = texts.drop("text").schema.add("term", "string").add("tf", "long").add("length", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if asked is None else asked.value
        for b in batches:
            rows, terms, tf, length = [], [], [], []
            for i, text in enumerate(b.column(len(own))):
                counts = Counter(words(text.as_py() or ""))
                total = counts.total()
                if wanted is not None:
                    counts = {t: counts[t] for t in counts.keys() & wanted}
                rows += [i] * (len(counts) + 1)
                terms += [None, *counts]
                tf += [0, *counts.values()]
                length += [total] * (len(counts) + 1)
                if len(rows) > BATCH:
                    yield batch(b, rows, terms, tf, length)
                    rows, terms, tf, length = [], [], [], []
            yield batch(b, rows, terms, tf, length)

    def batch(b: pa.RecordBatch, rows: list[int], terms: list, tf: list[int], length: list[int]) -> pa.RecordBatch:
        docs = b.select(own).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*docs.columns, pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(length, pa.int64())], names=[*own, "term", "tf", "length"])

    return texts.mapInArrow(run, schema)


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int"))


def term_counts(postings: DataFrame) -> DataFrame:
    """hub_id, day, bucket, term, df."""
    return postings.where("term is not null").groupBy("hub_id", "day", "bucket", "term").agg(F.count("*").alias("df"))


def day_sums(postings: DataFrame) -> DataFrame:
    """hub_id, day, at (the day that decides about cutoffs), agent, source, documents, tokens."""
    one = postings.where("bucket = -1 and doc_id is not null")
    at = F.coalesce(F.to_date("instant"), F.nullif("day", F.lit(NO_DAY).cast("date")))
    return one.groupBy("hub_id", "day", at.alias("at"), "agent", "source").agg(F.count("*").alias("documents"), F.sum("length").alias("tokens"))


@dataclass
class Index:
    """Tables of an index, stored or of the moment; ``features`` has a row for each document."""

    postings: DataFrame
    features: DataFrame
    terms: DataFrame
    sums: DataFrame
    buckets: int = BUCKETS


def kept(df: DataFrame, place: str) -> DataFrame:
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def of_the_moment(docs: DataFrame, features: DataFrame, buckets: int = BUCKETS, only: frozenset[str] | None = None) -> Index:
    """An index of ``docs`` for one plan, in the shared folder; each text is tokenised once. ``only`` are the terms that the plan asks for."""
    place = f"{shared_folder(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    p = kept(posted(docs, only).withColumn("bucket", bucket(F.col("term"), buckets)), f"{place}/postings")
    return Index(p, features, kept(term_counts(p), f"{place}/terms"), kept(day_sums(p), f"{place}/sums"), buckets)


# ---- the stored index


LISTED = "day date, signature string, documents long, postings long, tokens long"


def listed(spark: SparkSession, root: str) -> DataFrame:
    """The valid days of the index: day, signature, documents, postings, tokens; empty where nothing was published."""
    return versions.latest(spark, f"{root}/days", LISTED)


def signatures(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """day, signature of the columns that the index is made of."""
    return signed(docs.withColumn("day", F.coalesce("day", F.lit(NO_DAY).cast("date"))), ["day"], ["hub_id", "doc_id", *fields]).select("day", "signature")


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """day, state: kept, changed, new or removed."""
    both = now.select("day", F.col("signature").alias("now")).join(before.select("day", F.col("signature").alias("before")), "day", "full_outer")
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("before"), "kept").otherwise("changed")
    return both.select("day", state.alias("state"))


def overwrite(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that ``df`` has rows of; large ones are split over tasks and files, small ones share a task."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def refresh(docs: DataFrame, features: DataFrame, root: str, fields: tuple[str, ...], buckets: int = BUCKETS) -> DataFrame:
    """Bring the index in ``root`` up to ``docs``; returns day, state, documents, postings, tokens for each day it knew or knows.

    ``features`` has hub_id, day and doc_id beside what ranking needs; ``fields`` are the
    columns of ``docs`` that both are made of. Only days whose rows differ from the stored
    signature are tokenised, and the parts of a day that became empty are emptied.
    """
    spark = docs.sparkSession
    before, now = listed(spark, root), signatures(docs, fields)
    plan = [(r["day"], r["state"]) for r in changes(now, before).collect()]  # one row for each day of the corpus
    states = spark.createDataFrame([(str(day), state) for day, state in plan], "day string, state string").withColumn("day", F.col("day").cast("date"))
    due = [day for day, state in plan if state in ("new", "changed")]
    if due:
        mine = lambda df: df.where(F.coalesce("day", F.lit(NO_DAY).cast("date")).isin(literal(due)))
        rows = posted(mine(docs)).withColumn("bucket", bucket(F.col("term"), buckets))
        # a row without a document in every partition, so that one that has become empty is overwritten as well
        marks = spark.createDataFrame([(str(d), b) for d in due for b in range(-1, buckets)], "day string, bucket int").withColumn("day", F.col("day").cast("date"))
        overwrite(rows.unionByName(marks, allowMissingColumns=True), f"{root}/postings", "day", "bucket")
        fresh = stored(spark, f"{root}/postings", due).where("doc_id is not null")
        overwrite(term_counts(fresh).unionByName(marks.where("bucket >= 0"), allowMissingColumns=True), f"{root}/terms", "day", "bucket")
        overwrite(day_sums(fresh), f"{root}/sums", "day")
        overwrite(mine(features).withColumn("day", F.coalesce("day", F.lit(NO_DAY).cast("date"))), f"{root}/features", "day")
        sizes = fresh.groupBy("day").agg(F.count_if(F.col("term").isNull()).alias("documents"), F.count("term").alias("postings"), F.sum("tf").alias("tokens"))
    else:
        sizes = before.select("day", "documents", "postings", "tokens").limit(0)
    old = before.join(states.where("state = 'kept'"), "day", "left_semi")
    out = old.unionByName(now.join(sizes, "day"))
    versions.publish(out.select(*(c.split()[0] for c in LISTED.split(", "))), f"{root}/days")
    done = listed(spark, root).drop("signature")
    return states.join(done, "day", "left").select("day", "state", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "postings", "tokens")))


def stored(spark: SparkSession, path: str, days: list) -> DataFrame:
    """Partitions of a stored table; the list of days prunes the listing."""
    df = spark.read.parquet(path)
    return df.withColumn("day", F.col("day").cast("date")).where(F.col("day").isin(literal(days)))


def opened(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Index | None:
    """The index in ``root`` as it was last published; None where nothing was."""
    days = [r["day"] for r in listed(spark, root).select("day").collect()]  # one row for each day of the corpus
    if not days:
        return None
    table = {name: stored(spark, f"{root}/{name}", days) for name in ("postings", "features", "terms", "sums")}
    return Index(table["postings"].where("doc_id is not null"), table["features"], table["terms"].where("term is not null"), table["sums"], buckets)
