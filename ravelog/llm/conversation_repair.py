"""Repair of conversation structure by depth-first branch-and-bound.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Rows are kept,
given another role or deleted, and empty rows are inserted; the cheapest way is wanted,
and among equally cheap ones the one whose edit initials (D, I, K, R) are ASCII-least.

The search walks prefixes of edits in ASCII order with an explicit stack, so whatever it
meets first is the smaller text. A prefix is dropped if its cost and a lower bound on the
rest exceed the incumbent, or if its node (rows read, what the role sequence waits for)
was reached before at no higher cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Fixed values of the contract: costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = "\x20\x09-\x0d"
LEGAL = {"su", "ua", "au"}

# What the role sequence has so far: nothing, a system row, a user row, a whole exchange.
START, SYSTEM, USER, DONE = range(4)
NAMES = {START: "^", SYSTEM: "s", USER: "u", DONE: "a"}
WANTS = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", DONE), DONE: ("u", USER)}
ROLES = {"u": "user", "a": "assistant"}
GOOD, BLANK, DUPLICATE, CUT = range(4)
FLAWS = ("blank", "duplicate", "truncated")


def broken(left: str, right: str) -> bool:
    """Whether no well-formed sequence has these initials side by side; ``^`` starts a conversation, ``$`` ends it."""
    if left == "^":
        return right not in "su$"
    return left != "a" if right == "$" else left + right not in LEGAL


def bounds(rows: list[tuple[str, int]]) -> tuple[list[int], list[int], list[str]]:
    """For each suffix: a lower bound on its cost, the broken pairs in a row it begins with, its first initial that may stay.

    Rows that have to go cost a deletion each, truncated ones a point at least. Of the
    rest, every broken pair of neighbours needs an edit at it; an edit costs two points
    beyond these and touches two pairs next to each other at most, so a run of k broken
    pairs costs ``2 * ceil(k / 2)``, and no edit serves two runs.
    """
    least, run, first = [0], [0], ["$"]
    for initial, flaw in reversed(rows):
        if flaw in (BLANK, DUPLICATE):
            least.append(least[-1] + DELETE)
            run.append(run[-1])
            first.append(first[-1])
        else:
            pair = broken(initial, first[-1])
            more = 2 if pair and run[-1] % 2 == 0 else 0
            least.append(least[-1] + (TRUNCATED if flaw == CUT else 0) + more)
            run.append(run[-1] + 1 if pair else 0)
            first.append(initial)
    return least[::-1], run[::-1], first[::-1]


def moves(rows: list[tuple[str, int]], i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits that are possible at a node in ASCII order: letter, cost, rows read after it, state after it."""
    role, after = WANTS[state]
    if i < len(rows):
        initial, flaw = rows[i]
        extra = TRUNCATED if flaw == CUT else 0
        yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, after
        if flaw not in (BLANK, DUPLICATE):
            if initial == role:
                yield "K", KEEP + extra, i + 1, after
            elif initial == "s" and state == START:
                yield "K", KEEP + extra, i + 1, SYSTEM
            yield "R", REROLE + extra, i + 1, after
    else:
        yield "I", INSERT, i, after


def repair(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit): the least edits for ``rows`` of (role initial, flaw).

    The incumbent starts as the cost of always taking the edit that looks cheapest, whose
    text is then searched for like any other. The table has an entry for each node, the
    stack one for each open prefix: memory is proportional to the rows.
    """
    n = len(rows)
    least, run, first = bounds(rows)

    def bound(i: int, state: int) -> int:
        more = 2 if run[i] % 2 == 0 and broken(NAMES[state], first[i]) else 0
        return least[i] + more

    def over(i: int, state: int) -> bool:
        return i == n and state in (START, DONE)

    i, state, incumbent = 0, START, 0
    while not over(i, state):
        # a row that leaves its place is worth more than one more insertion that looks as cheap
        cost, _, j, after = min(((c + bound(j, s), -j, j, s) for _, c, j, s in moves(rows, i, state)), key=lambda x: x[:2])
        incumbent += cost - bound(j, after)
        i, state = j, after
    audit: str | None = None
    reached = [[incumbent + 1] * 4 for _ in range(n + 1)]
    path: list[str] = []
    stack = [("", 0, 0, START, 0)]
    while stack:
        letter, cost, i, state, depth = stack.pop()
        if cost >= reached[i][state] or cost + bound(i, state) > (incumbent if audit is None else incumbent - 1):
            continue
        reached[i][state] = cost
        if letter:
            path[depth - 1 :] = letter
        if over(i, state):
            # later prefixes of the same cost are larger in ASCII, and longer ones cost more
            incumbent, audit = cost, "".join(path[:depth])
            continue
        stack += reversed([(m, cost + c, j, s, depth + 1) for m, c, j, s in moves(rows, i, state)])
    return incumbent, audit or ""


def lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of each row after the edits ``audit``."""
    state = START
    for letter in audit:
        role, after = WANTS[state]
        if letter == "I":
            yield f"{ROLES[role]}:"
            state = after
            continue
        own, text = next(rows)
        if letter == "K":
            yield f"{own}:{text}"
            state = SYSTEM if own[:1] == "s" else after
        elif letter == "R":
            yield f"{ROLES[role]}:{text}"
            state = after


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows after damage by ``crc32('conv_id:turn') % 20``; a dropped row stays as ``gone``.

    Nulls are one space, in the key as well. A repeated row is there twice.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("said", ".!?", "")).otherwise(F.col("said"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("said"), kind.alias("kind"))
    once = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return once.select("conv_id", "turn", "role", "text", "gone", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def flaw(text: Column) -> Column:
    """What a row's own text is: 1 blank, 3 truncated, else 0."""
    return F.when(~text.rlike(f"[^{SPACE}]"), BLANK).when(~text.rlike(f"[.!?][{SPACE}]*\\z"), CUT).otherwise(GOOD)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Reader:
    """What the report needs of a conversation: digests of its rows, two small numbers a row, and the turns' extent."""

    def __init__(self):
        self.seen: set[bytes] = set()
        self.rows: list[tuple[str, int]] = []
        self.low = self.high = self.last = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, kind: int) -> None:
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
        if kind != BLANK and digest in self.seen:
            kind = DUPLICATE
        self.seen.add(digest)
        self.rows.append((role[:1], kind))
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def report(self, conv: int | None) -> tuple:
        flaws = [sum(kind == k for _, kind in self.rows) for k in (BLANK, DUPLICATE, CUT)]
        illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(self.rows, self.rows[1:], strict=False))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (conv, gaps, *flaws, illegal, *repair(self.rows))


def dealt(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "text")


def audits(rows: DataFrame) -> DataFrame:
    """A row of ``REPORT`` for each conversation of ``rows`` (those of ``damaged``), read as a stream in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        for b in batches:
            out = []
            for conv, turn, role, text, gone, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != key:
                    if now is not None:
                        out.append(now.report(key))
                    now, key = Reader(), conv
                if not gone:
                    now.add(turn, role, text, kind)
            if out:
                yield table_of(out, REPORT)
        if now is not None:
            yield table_of([now.report(key)], REPORT)

    return dealt(rows).select("conv_id", "turn", "role", "text", "gone", flaw(F.col("text")).alias("kind")).mapInArrow(run, REPORT)


def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, seq, line: the rows of each conversation after its edits, in order; one row with a null line for an empty result.

    The audit comes as a row before its conversation's own rows, so a task reads both as
    one stream and holds an audit and a batch of rows at a time.
    """
    marks = reports.select("conv_id", F.lit(None).cast("long").alias("turn"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("own"))
    own = rows.where(~F.col("gone")).select("conv_id", "turn", F.lit(None).cast("string").alias("audit"), "role", "text", F.lit(1).alias("own"))
    return dealt(marks.union(own), "own").select("conv_id", "audit", "role", "text")


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
    """(conversation, repaired line) in order; an empty conversation gives none."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    source = rows()
    for conv, audit, _, _ in source:
        if audit is not None:
            own = ((role, text) for _, _, role, text in source)
            for line in lines(audit, own):
                yield conv, line


SHA = "conv_id long, repaired_sha256 string"


def digests(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of every conversation that repair leaves a row in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, out = None, None, []
        for conv, line in stream(batches):
            if now is None or conv != key:
                if now is not None:
                    out.append((key, now.hexdigest()))
                now, key = hashlib.sha256(line.encode()), conv
            else:
                now.update(b"\n" + line.encode())
            if len(out) >= 10_000:
                yield table_of(out, SHA)
                out = []
        if now is not None:
            yield table_of([*out, (key, now.hexdigest())], SHA)

    return repaired(rows, reports).mapInArrow(run, SHA)


def repaired_rows(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, seq, line: the repaired conversations themselves, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        out, key, seq = [], object(), 0
        for conv, line in stream(batches):
            seq = seq + 1 if conv == key else 0
            key = conv
            out.append((conv, seq, line))
            if len(out) >= 10_000:
                yield table_of(out, "conv_id long, seq long, line string")
                out = []
        if out:
            yield table_of(out, "conv_id long, seq long, line string")

    return repaired(rows, reports).mapInArrow(run, "conv_id long, seq long, line string")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """``REPORT`` and repaired_sha256 for every conv_id of ``rows`` (columns as ``damaged`` gives them).

    Rows are read by turn (nulls first), then role and text. A role's initial is its first
    code point; an empty role has none and can only be given another role or deleted. Rows
    with a null conv_id form one conversation. Conversations without a row that is not
    ``gone`` have zeros, an empty audit and the digest of the empty text. An empty table
    gives an empty result. Each conversation is one stream in one task, since its digest is
    sequential; memory is some 100 bytes a row of the longest one and a batch of texts.
    """
    reports = cut(audits(rows))
    empty = hashlib.sha256().hexdigest()
    both = reports.join(digests(rows, reports).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))
