"""Benchmark decontamination by winnowed k-gram fingerprints."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, written

# A-Z to lower case, other ASCII outside 0-9 and a-z to spaces; other bytes stay.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)
CACHE = 400_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * STEP + ids[i : i + n]
    return out ^ (out >> np.uint64(31))


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each sliding window (all of a shorter run)."""
    if len(grams) <= window:
        return np.arange(len(grams)) if len(grams) < window else np.array([int(grams.argmin())])
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(view)) + view.argmin(axis=1))


class Index:
    """Fingerprints and windows of one bounded shard of benchmark items.

    A window has ``span`` consecutive words of an item. With k-grams of ``k`` words
    and ``span - k + 1`` grams to a sliding window, a text that holds a window of the
    item holds a fingerprint of it at the same place: both minima come from the
    same grams. Windows are kept as sorted hashes with their places in the shard's
    text, some 30 bytes each, and compared as text where hashes agree.
    """

    def __init__(self, items: list[tuple[int, str]], span: int, k: int):
        self.span, self.k, self.cache = span, k, {}
        self.texts: list[bytes] = []
        prints, by_size = [], defaultdict(list)
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            size = min(span, len(words))
            ids = self.hashes(words)
            starts = gram_hashes(ids, size)
            ends = np.cumsum([len(w) + 1 for w in words])  # one past each word and its space
            first, last = np.append(0, ends[:-1])[: len(starts)], ends[size - 1 :] - 1
            by_size[size].append((starts, np.full(len(starts), item, np.int64), np.full(len(starts), len(self.texts), np.int32), first.astype(np.int32), last.astype(np.int32)))
            self.texts.append(b" ".join(words))
            small = gram_hashes(ids, k)
            prints.append(small[winnow(small, span - k + 1)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)
        self.windows = {}
        for size, parts in by_size.items():
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            self.windows[size] = [c[order] for c in columns]
        self.cache.clear()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = xxhash.xxh64_intdigest(w)
        return np.array([cache[w] for w in words], dtype=np.uint64)

    def items_at(self, size: int, gram: np.uint64, window: bytes) -> set[int]:
        """The items that hold a window of ``size`` words: those of its hash whose text is the same."""
        starts, item, text, first, last = self.windows[size]
        a, b = np.searchsorted(starts, gram, side="left"), np.searchsorted(starts, gram, side="right")
        return {int(item[i]) for i in range(a, b) if self.texts[text[i]][first[i] : last[i]] == window}

    def hits(self, words: list[bytes]) -> tuple[list[int], set[int]]:
        """Hit word positions as sorted [start, end, ...] runs and the items that occur."""
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        if not words:
            return [], found
        ids = self.hashes(words)
        for n, (starts, *_) in sorted(self.windows.items()):
            if len(ids) < n:
                continue
            grams = gram_hashes(ids, n)
            if n == self.span:  # winnowed fingerprints name the places worth extending
                small = gram_hashes(ids, self.k)
                at = winnow(small, n - self.k + 1)
                at = at[member(small[at], self.prints)]
                if not len(at):
                    continue
                at = np.unique((at[:, None] - np.arange(n - self.k + 1)).ravel())
                at = at[(at >= 0) & (at < len(grams))]
                at = at[member(grams[at], starts)]
            else:
                at = np.nonzero(member(grams, starts))[0]
            for i in at.tolist():
                if items := self.items_at(n, grams[i], b" ".join(words[i : i + n])):
                    found |= items
                    runs.append((i, i + n))
        flat: list[int] = []
        for a, b in sorted(runs):
            if flat and a <= flat[-1]:
                flat[-1] = max(flat[-1], b)
            else:
                flat += [a, b]
        return flat, found


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def shards(benchmark: DataFrame, shard_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of about ``shard_bytes`` of text, measured before any is collected."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // shard_bytes))
    for i in range(n):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, shard_bytes: int = 4 << 20, names: tuple[str, str, str] = ("n_words", "hit", "items")) -> DataFrame:
    """``docs`` with the columns ``names``: its number of words (long), hit (sorted start, end, ... word runs) and items (array<long>).

    A window is ``span`` consecutive words of an item (all its words, if fewer);
    each word inside an occurrence of a window is hit. Benchmark text goes to the
    executors in shards of ``shard_bytes``, one pass over the documents for each; each
    pass is written before the next one begins, so a task holds the index of one shard.
    Null texts have no words, null items and null item_ids take no part, an item_id
    repeated with other texts is one item; all rows and columns of ``docs`` stay, but for
    one named like those added.
    """
    out = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names))
    for part, items in enumerate(shards(benchmark, shard_bytes)):
        out = scan(written(out) if part else out, items, span, k, names, first=part == 0)
    return out


def scan(docs: DataFrame, items: list[tuple[int, str]], span: int, k: int, names: tuple[str, str, str], first: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kept = [c for c in docs.columns if c not in names]
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{names[0]}` long, `{names[1]}` array<long>, `{names[2]}` array<long>"])
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, span, k)
        for b in batches:
            counts, hit, occurring = [], [], []
            for row, text in enumerate(b.column(at)):
                words = words_of(text.as_py())
                runs, found = index.hits(words)
                if not first:
                    runs = merged(runs, b.column(len(kept) + 1)[row].as_py())
                    found |= set(b.column(len(kept) + 2)[row].as_py())
                counts.append(len(words))
                hit.append(runs)
                occurring.append(sorted(found))
            extra = [pa.array(counts, pa.int64()), pa.array(hit, pa.list_(pa.int64())), pa.array(occurring, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *extra], names=[*kept, *names])

    return docs.select(*(F.col(f"`{c}`") for c in [*kept, *([] if first else names)])).mapInArrow(run, schema)


def merged(one: list[int], other: list[int]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted([*zip(one[::2], one[1::2], strict=True), *zip(other[::2], other[1::2], strict=True)]):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def report(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One digest row per document; see ``contamination``."""
    found = contamination(docs.select("doc_id", "text"), benchmark, **parameters)
    hit = F.aggregate(F.transform("hit", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns, of any name."""
    names = tuple(free(docs.columns, c) for c in ("n_words", "hit", "items"))
    return contamination(docs, benchmark, names=names, **parameters).where(F.size(names[1]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
