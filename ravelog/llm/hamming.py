"""Groups of fingerprints within a Hamming distance, without all pairs of a bucket.

Blocks of a 64-bit fingerprint: two fingerprints with at most ``distance``
differing bits agree on at least ``blocks - distance`` whole blocks, so every
such pair meets under one of the C(blocks, agree) keys (pigeonhole principle).

Three rounds find the connected groups:

1. each member of a bucket is compared with the bucket's leader only, which
   joins dense groups of near copies with as many rows as members;
2. where a comparison costs a look at the texts, members that are not in their
   leader's group yet are compared with ``LEADERS`` further members of their
   bucket, which joins most groups of which one leader saw only a part;
3. members that are still apart are compared with the rest of their bucket.
   Pairs inside one group are never formed, so a group of thousands of near
   copies costs no quadratic output, and no link between two groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected, cut, small_side


def block_keys(fp: Column, blocks: int, agree: int) -> list[Column]:
    """One key for each choice of ``agree`` of ``blocks`` blocks: its number, then the blocks' bits."""
    bounds = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        key, width = F.lit(0).cast("long"), 0
        for i in chosen:
            size = bounds[i + 1] - bounds[i]
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(fp, bounds[i]).bitwiseAND(F.lit((1 << size) - 1)))
            width += size
        keys.append(key.bitwiseOR(F.lit(number << width)))
    return keys


def pivots(n: int) -> list[int]:
    """Reference fingerprints by a fixed rule (golden-ratio steps, mixed)."""
    out = []
    for i in range(1, n + 1):
        x = i * 0x9E3779B97F4A7C15 % (1 << 64)
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
        x ^= x >> 31
        out.append(x - (1 << 64) if x >= 1 << 63 else x)
    return out


def with_pivot_table(df: DataFrame, n: int, fp: str | Column, name: str) -> DataFrame:
    """Columns {name}0..{name}{n-1}: Hamming distance of ``fp`` to each reference fingerprint."""
    fp = F.col(fp) if isinstance(fp, str) else fp
    return df.select("*", *(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte").alias(f"{name}{i}") for i, p in enumerate(pivots(n))))


def pivots_allow(left: str, right: str, n: int, distance: int) -> Column:
    """Triangle inequality: no coordinate of the pivot tables differs by more than ``distance``."""
    keep = F.lit(True)
    for i in range(n):
        keep = keep & (F.abs(F.col(f"{left}{i}") - F.col(f"{right}{i}")) <= distance)
    return keep


def key_blocks(n: int, distance: int) -> int:
    """Blocks to cut: as few as give keys that tell ``n`` fingerprints apart (up to eight of unrelated ones to a bucket)."""
    blocks = distance + 2
    while (blocks - distance) * 64 // blocks + 3 < n.bit_length() and blocks < 2 * distance + 2:
        blocks += 1
    return blocks


LEADERS = 8


def more_leaders(rows: DataFrame) -> DataFrame:
    """Rows (key, id): up to ``LEADERS`` members of each bucket, each the smallest id under a mask of the bucket's own."""
    masks = [F.xxhash64("key", F.lit(i)) for i in range(LEADERS)]
    drawn = rows.groupBy("key").agg(*(F.min(F.col("id").bitwiseXOR(m)).alias(f"drawn{i}") for i, m in enumerate(masks)))
    return drawn.select("key", F.explode(F.array_distinct(F.array(*(F.col(f"drawn{i}").bitwiseXOR(m) for i, m in enumerate(masks))))).alias("id"))


def near_groups(
    nodes: DataFrame,
    distance: int,
    blocks: int,
    agree: int,
    n_pivots: int,
    prepare: Callable[[DataFrame], Callable[..., DataFrame]] | None = None,
    keyed: bool = False,
    ratio: float = 0.0,
    limit: Callable[[Column, Column], Column] = lambda x, y: F.lit(1.0 * (1 << 40)),
) -> DataFrame:
    """Rows (node, root) for the nodes (id, fp), both long, that have a link.

    A link is a pair that meets under a block key, lies within ``distance`` bits and is
    confirmed, where ``prepare`` is given: it takes the ids that meet another one and gives
    a function that takes edges (a, b) and adds lo and hi, bounds of a distance that obeys
    the triangle inequality, and near, whether it is a link; its second argument is False
    where only near is of use. ids are unique. With
    ``agree <= blocks - distance`` no pair within the distance is missed. Pairs that meet
    are discarded by the pivot tables first, and their bits are counted after.

    With ``keyed`` the nodes bring an array ``keys`` under which they meet, instead of
    blocks of fp, and a ``width``; pairs whose widths' ratio is under ``ratio`` are no links,
    nor are those whose distances to their bucket's leader differ by more than
    ``limit(width, other width)``.
    """
    if not keyed:
        nodes = nodes.select("id", "fp", F.array(*block_keys(F.col("fp"), blocks, agree)).alias("keys"), F.lit(0).alias("width"))
    keys = nodes.select(F.explode("keys").alias("key"), "id", "fp")
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    # Each bucket draws its own leader, the smallest id under a mask of its own, so a node that one leader is too far from
    # meets others elsewhere. With two members, sums of bits give the second one.
    drawn = F.col("id").bitwiseXOR(F.col("key"))
    found = [F.count("*").alias("n"), F.min(drawn).alias("drawn"), F.bit_xor("id").alias("both"), F.bit_xor("fp").alias("differ")]
    buckets = keys.groupBy("key").agg(*found, *([F.min_by("fp", drawn).alias("head_fp")] if n_pivots else []))
    # Most buckets have one member, and most of the others two that happen to meet; neither goes further.
    close = (F.col("n") == 2) & (F.bit_count("differ") <= distance)
    if n_pivots:
        buckets = with_pivot_table(with_pivot_table(buckets, n_pivots, "head_fp", "x"), n_pivots, F.col("head_fp").bitwiseXOR(F.col("differ")), "y")
        close = close & pivots_allow("x", "y", n_pivots, distance)
    head = F.col("drawn").bitwiseXOR(F.col("key"))
    buckets = cut(buckets.where((F.col("n") > 2) | close).select("key", "n", head.alias("head"), F.col("both").bitwiseXOR(head).alias("other")))
    many = small_side(buckets.where("n > 2").select("key", "head"), F.lit(16))
    rows = cut(with_pivot_table(keys.join(many, "key").select("key", "id", "fp", "head"), n_pivots, "fp", "x"))

    heads = rows.where("id = head").select("key", F.col("fp").alias("head_fp"))
    led = with_pivot_table(rows.where("id <> head").join(heads, "key"), n_pivots, "head_fp", "y").where(pivots_allow("x", "y", n_pivots, distance) & (apart("fp", "head_fp") <= distance))
    pairs = buckets.where("n = 2").select(F.greatest("head", "other").alias("a"), F.least("head", "other").alias("b"))
    edges = led.select(F.col("id").alias("a"), F.col("head").alias("b")).union(pairs).distinct()
    confirm = None
    if prepare:
        confirm = prepare(rows.select("id").union(pairs.select("a")).union(pairs.select("b")).distinct())
        edges = cut(confirm(edges))
    first = cut(connected(edges.where("near").select("a", "b") if prepare else edges))

    wide = rows.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("team", F.coalesce("root", "id")).drop("root")
    wide = wide.join(first.select(F.col("node").alias("head"), F.col("root").alias("head_root")), "head", "left")
    table = [f"x{i}" for i in range(n_pivots)]
    wide = wide.select("key", "id", "fp", "team", F.coalesce("head_root", "head").alias("head_team"), "head", *table)
    # Buckets of one team are closed; members of the others bring their keys, to meet each other once only.
    still_open = cut(wide.where("team <> head_team").select("key").distinct())
    wide = wide.join(small_side(still_open, F.lit(16)), "key")
    wide = wide.join(nodes.select("id", "keys", "width"), "id")
    if prepare:
        to_head = edges.select(F.col("a").alias("id"), F.col("b").alias("head"), "lo", "hi")
        wide = wide.join(to_head, ["id", "head"], "left")
    else:
        wide = wide.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
    wide = cut(wide)
    place = F.array_position(F.col("keys"), F.col("key")).cast("int") - 1
    may_link = (
        (F.col("key") == F.col("o_key"))
        & (F.col("team") != F.col("o_team"))
        & (F.least("width", "o_width") >= ratio * F.greatest("width", "o_width"))
        & pivots_allow("x", "y", n_pivots, distance)
        & (apart("fp", "o_fp") <= distance)
        & F.coalesce(F.greatest(F.col("lo") - F.col("o_hi"), F.col("o_lo") - F.col("hi")) <= limit(F.col("width"), F.col("o_width")), F.lit(True))
    )
    once = ~F.arrays_overlap(F.slice("keys", F.lit(1), place), F.slice("o_keys", F.lit(1), place))
    pair = [F.greatest("id", "o_id").alias("a"), F.least("id", "o_id").alias("b")]

    def other(rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(c).alias(f"o_{c}") for c in ("key", "id", "fp", "team", "keys", "width", "lo", "hi")), *(F.col(c).alias(f"y{i}") for i, c in enumerate(table)))

    links = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if confirm:
        leaders = cut(other(wide.join(more_leaders(wide), ["key", "id"])))
        led = wide.where("team <> head_team").join(small_side(leaders, F.lit(160)), may_link)
        led = led.groupBy(*pair).agg(F.first("team").alias("team"), F.first("o_team").alias("o_team"))
        led = cut(led.join(edges.select("a", "b"), ["a", "b"], "left_anti"))
        joined = cut(led.join(confirm(led.select("a", "b"), False).where("near"), ["a", "b"]).select(F.col("team").alias("a"), F.col("o_team").alias("b")).distinct())
        teams = cut(connected(joined))
        for c in ("team", "head_team"):
            wide = wide.join(small_side(teams.select(F.col("node").alias(c), "root"), F.lit(16)), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        wide, links = cut(wide), links.union(joined)
    # Rows of one key have one head: two members that are both apart from it are paired from one side only.
    one_side = (F.col("o_team") == F.col("head_team")) | (F.col("id") > F.col("o_id"))
    more = wide.where("team <> head_team").join(other(wide), may_link & once & one_side).select(*pair).distinct()
    if confirm:
        more = confirm(more.join(led.select("a", "b"), ["a", "b"], "left_anti"), False).where("near").select("a", "b")
    return connected(more.union(links))
