"""Reachability and cycles in the replacement graph (edges src -> dst within a hub), and rows gathered by connected groups."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = ("hub_id", "src", "dst")


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session (a folder of our own only where none is named)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: like ``cut``, in far less room."""
    place = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


NARROW_ROWS = 200_000


def small_side(df: DataFrame) -> DataFrame:
    """``df``, of narrow rows, written and marked for broadcast if it has ``NARROW_ROWS`` at most; else Spark chooses the join."""
    done = cut(df)
    return F.broadcast(done) if done.count() <= NARROW_ROWS else done


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows (hub_id, start, node): every node that each start (hub_id, start) reaches by one edge or more.

    Frontier joins; each round looks only at pairs that are new, and the pairs seen
    are cut so that lineage stays short.
    """
    step = cut(edges.select("hub_id", F.col("src").alias("at"), F.col("dst").alias("node")).distinct())
    seen = frontier = cut(starts.select("hub_id", "start", F.col("start").alias("at")).join(step, ["hub_id", "at"]).select("hub_id", "start", "node").distinct())
    while not frontier.isEmpty():
        found = frontier.withColumnRenamed("node", "at").join(step, ["hub_id", "at"]).select("hub_id", "start", "node").distinct()
        frontier = cut(found.join(seen, ["hub_id", "start", "node"], "left_anti"))
        seen = cut(seen.union(frontier))
    return seen


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: ends without a way in or out are dropped until none is left."""
    left = cut(edges.select(*EDGE).where("src is not null and dst is not null").distinct())
    size = left.count()
    while True:  # until nothing is dropped
        outs, ins = left.select("hub_id", F.col("src").alias("n")).distinct(), left.select("hub_id", F.col("dst").alias("n")).distinct()
        both = cut(outs.intersect(ins))
        kept = left.join(both.withColumnRenamed("n", "src"), ["hub_id", "src"], "left_semi").join(both.withColumnRenamed("n", "dst"), ["hub_id", "dst"], "left_semi")
        left = cut(kept.select(*EDGE))
        now = left.count()
        if now == size:
            break
        size = now
    return left


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes (hub_id, node) that reach themselves. The closure runs on the trimmed remainder only."""
    core = trimmed(edges)
    starts = core.select("hub_id", F.col("src").alias("start")).distinct()
    return reach(core, starts).where("start = node").select("hub_id", "node").distinct()


def would_close(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (hub_id, src, dst) whose edge would close a loop: dst is src or reaches it."""
    starts = candidates.select("hub_id", F.col("dst").alias("start")).distinct()
    ways = reach(edges, starts).select("hub_id", F.col("start").alias("dst"), F.col("node").alias("src"))
    return candidates.join(ways, ["hub_id", "src", "dst"], "left_semi").union(candidates.where("src = dst")).distinct()



# ---- rows gathered by connected groups


EDGES_A_TASK = 200_000


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node each can reach by them: roots are hooked onto smaller ones, paths halved."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        least = np.minimum(root[x], root[y])
        for end in (x, y):
            np.minimum.at(root, root[end], least)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return nodes, nodes[root]


def stars(edges: DataFrame, roots: bool = False, share: int = EDGES_A_TASK) -> DataFrame:
    """Edges (a, b) that reach as far as ``edges``: each task turns ``share`` of its own at a time into (node, smallest one reached), with ``roots`` their own roots too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= share:
                yield star(held)
                held, n = [], 0
        if n:
            yield star(held)

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, root = components(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
        keep = (nodes != root) | roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def connected(edges: DataFrame, share: int = EDGES_A_TASK) -> DataFrame:
    """Rows (node, root): the smallest node each node of ``edges`` (a, b) can reach.

    Each task first contracts its own edges to stars. What fits one task's share
    (``share``) then ends there; more than that takes large-star and small-star
    rounds (Kiveris et al., 2014) until it fits or nothing moves.
    Every step of a round is a partial ``min`` and a join, so a node with very many
    neighbours is pre-aggregated and its join can be split by AQE. A round uses as
    many tasks as its edges need. Nodes without an edge are not returned; an empty
    input gives an empty result.
    """
    pairs = cut(stars(edges.where("a <> b"), share=share))
    seen = None
    while True:  # each round at least halves the longest paths and none is left out, so this ends
        mark = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(20, 0)))")).first()
        if mark[0] < share:
            return stars(pairs.coalesce(1), roots=True, share=share).select(F.col("a").alias("node"), F.col("b").alias("root"))
        if tuple(mark) == seen:
            break
        seen, tasks = tuple(mark), 1 + mark[0] // share
        few = pairs.coalesce(tasks)
        both = few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        large = large.union(least.where("a <> m").coalesce(tasks))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).union(down.coalesce(tasks))
        pairs = cut(small.where("a <> b").distinct().coalesce(tasks))
    roots = pairs.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


GROUP = 2_000


def gathered(rows: DataFrame, nodes: Callable[[Column], Column], most: int = GROUP, share: int = EDGES_A_TASK) -> tuple[DataFrame, DataFrame | None]:
    """(groups, rest): ``items``, an array of all rows that hang together by common nodes, and the rows of groups of over ``most`` rows (None without any).

    ``nodes`` gives the nodes of a row (a struct of the columns) as an array of longs; hashes
    will do, since a common hash only puts two groups together. Each task first gathers
    ``share`` rows as they come. Where no node of such a group is in another, it is whole and
    is not moved again; the others are joined along their common nodes.
    """
    row = F.struct(*rows.columns)
    kind = rows.select(row.alias("item")).schema["item"].dataType.simpleString()
    pieces = written(rows.select(nodes(row).alias("nodes"), row.alias("item")).mapInArrow(lambda batches: _pieces(batches, share), f"piece long, items array<{kind}>"))
    own = pieces.select("piece", F.explode(F.array_distinct(F.flatten(F.transform("items", nodes)))).alias("node"))
    split = small_side(own.groupBy("node").agg(F.min("piece").alias("first"), F.max("piece").alias("last")).where("first < last").select("node", "first"))
    links = cut(own.join(split, "node").where("first < piece").select(F.col("first").alias("a"), F.col("piece").alias("b")).distinct())
    teams = small_side(connected(links, share).withColumnsRenamed({"node": "piece", "root": "team"}))
    alone = pieces.join(teams, "piece", "left_anti").select("items")
    few = F.size("items") <= most
    parts = pieces.join(teams, "piece").select("team", "items")
    sizes = parts.groupBy("team").agg(F.sum(F.size("items")).alias("n"))
    fit = small_side(sizes.where(F.col("n") <= most).select("team"))
    joined = parts.join(fit, "team").groupBy("team").agg(F.flatten(F.collect_list("items")).alias("items")).select("items")
    large = alone.where(~few).union(parts.join(fit, "team", "left_anti").select("items"))
    rest = None if large.isEmpty() else written(large.select(F.explode("items").alias("item")).select("item.*"))
    return alone.where(few).union(joined), rest


def _pieces(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """piece, items: the groups of ``share`` rows (nodes, item) at a time; a piece has a number that no other has."""
    context, made, held, n = TaskContext.get(), 0, [], 0

    def piece() -> pa.RecordBatch:
        nonlocal made
        table = pa.Table.from_batches(held).combine_chunks()
        lists, items = (table.column(i).combine_chunks() if table.num_rows else None for i in (0, 1))
        node, at = lists.flatten().to_numpy(), np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy())
        home = np.arange(table.num_rows)
        if len(node):  # rows are nodes as well, numbered below; each is tied to its nodes
            names, number = np.unique(node, return_inverse=True)
            ends, root = components(at, table.num_rows + number)
            ours = ends < table.num_rows
            home[ends[ours]] = root[ours]
        order = np.argsort(home, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(home[order]) != 0])
        offsets = pa.array(np.r_[starts, len(order)].astype(np.int32))
        numbers = pa.array((context.partitionId() << 33) + made + np.arange(len(starts)))
        made += len(starts)
        return pa.RecordBatch.from_arrays([numbers, pa.ListArray.from_arrays(offsets, items.take(pa.array(order)))], names=["piece", "items"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= share:
            yield from cut_up(piece())
            held, n = [], 0
    if n:
        yield from cut_up(piece())


def cut_up(batch: pa.RecordBatch, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, most):
        yield batch.slice(i, most)


def key(hub: Column, name: Column) -> Column:
    """The node of a name for ``gathered``."""
    return F.xxhash64(hub, name)


def reach_counts(edges: DataFrame, most: int = GROUP) -> DataFrame:
    """hub_id, start, reachable: how many nodes each node with a way out reaches by one edge or more.

    A group of connected edges is closed by the task that holds it, so its pairs are
    counted and never written; groups of over ``most`` edges are closed by ``reach``.
    """
    own = edges.select(*EDGE).where("hub_id is not null and src is not null")
    ends = lambda e: F.array_compact(F.array(key(e["hub_id"], e["src"]), F.when(e["dst"].isNotNull(), key(e["hub_id"], e["dst"]))))
    groups, rest = gathered(own, ends, most)
    kind = {f.name: f.dataType.simpleString() for f in own.schema}
    counts = groups.mapInArrow(_closed, f"hub_id {kind['hub_id']}, start {kind['src']}, reachable long")
    if rest is None:
        return counts
    ways = reach(rest, rest.select("hub_id", F.col("src").alias("start")).distinct())
    return counts.union(ways.groupBy("hub_id", "start").agg(F.count("*").alias("reachable")))


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column(0)
        offsets = np.r_[0, np.cumsum(items.value_lengths().to_numpy())].tolist()
        edges = items.flatten()
        hubs, srcs, dsts = (edges.field(i) for i in range(3))
        rows = list(zip(hubs.to_pylist(), srcs.to_pylist(), dsts.to_pylist(), strict=True))
        hub, start, reachable = [], [], []
        for low, high in zip(offsets, offsets[1:], strict=False):
            nexts = defaultdict(set)
            for h, a, b in rows[low:high]:
                nexts[h, a].add(b)
            for h, a in nexts:
                seen, left = set(), list(nexts[h, a])
                while left:
                    if (node := left.pop()) not in seen:
                        seen.add(node)
                        left += nexts.get((h, node), ())
                hub.append(h)
                start.append(a)
                reachable.append(len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(hub, hubs.type), pa.array(start, srcs.type), pa.array(reachable, pa.int64())], names=["hub_id", "start", "reachable"])
