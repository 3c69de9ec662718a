"""Language identification by words first and progressively shorter character n-grams.

A word of a text that the model knows scores its relative frequency in each language; one
that no language knows is scored by its longest n-grams of which some language knows one,
from ``TOP`` code points down to one. A score is -log10 of a relative frequency, or the
penalty where a language lacks what another has. A text's language has the smallest sum.

Counts are taken over all learned rows. The model keeps what reaches a share of its
language's occurrences, so its size is bounded by the reciprocal of that share whatever
the number of rows; the share follows from ``WORD_ENTRIES``, ``GRAM_ENTRIES`` and the
number of languages.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, small_side, written

TOP = 6
WORD_ENTRIES, GRAM_ENTRIES = 400_000, 200_000  # most entries of the word table, and of each order's table
PENALTY = 1.0  # what is unknown to a language scores this much beyond its rarest entry possible
PIECE, WORDS = 1 << 20, 200_000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
GAP = regex.compile(r"[^\p{L}\p{M}]")
STEP = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str) -> Iterator[list[str]]:
    """The words of a whole text, letters lower-cased, in lists of those of about ``PIECE`` code points."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > PIECE and (gap := GAP.search(text, start + PIECE)):
            end = gap.start()
        yield WORD.findall(text[start:end].lower())
        start = end


def finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def grams(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words in one array of code points with a space at both ends; for each order the words its n-grams are of and their keys."""
    x = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    out, key = [], np.full(len(x), STEP)
    for n in range(1, TOP + 1):
        size = max(0, len(x) - n + 1)
        key = finished(key[:size] * STEP + x[n - 1 :])
        whole = own[:size] == own[n - 1 :]
        if n == 1:
            whole &= x != 32
        out.append((own[:size][whole], key[whole]))
    return out


@dataclass
class Table:
    """Sorted keys; the entries of key i are ``langs[ends[i]:ends[i + 1]]`` with their gains over the penalty."""

    keys: np.ndarray
    ends: np.ndarray
    langs: np.ndarray
    gains: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, langs: np.ndarray, gains: np.ndarray) -> Table:
        order = np.lexsort((langs, keys))
        distinct, starts = np.unique(keys[order], return_index=True)
        return cls(distinct, np.append(starts, len(order)), langs[order], gains[order])

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def add(self, out: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """Add the gains of the keys numbered ``at`` to the given rows of ``out`` (rows by language)."""
        sizes = self.ends[at + 1] - self.ends[at]
        entry = np.repeat(self.ends[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        flat = np.repeat(rows, sizes) * out.shape[1] + self.langs[entry]
        out += np.bincount(flat, self.gains[entry], out.size).reshape(out.shape)


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    table: Table
    orders: list[Table]

    def gains(self, words: list[str]) -> np.ndarray:
        """For each word and language how far its score lies below the penalty."""
        out = np.zeros((len(words), len(self.languages)))
        at = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        self.table.add(out, np.flatnonzero(at >= 0), at[at >= 0])
        left = np.flatnonzero(at < 0)
        if not len(left):
            return out
        for table, (own, keys) in zip(reversed(self.orders), reversed(grams([words[i] for i in left])), strict=True):
            found = table.find(keys)
            own, found = own[found >= 0], found[found >= 0]
            open_ = np.zeros(len(left), bool)
            open_[own] = True
            open_ &= left >= 0  # words that a longer n-gram has scored are marked
            own, found = own[open_[own]], found[open_[own]]
            part = np.zeros((len(left), len(self.languages)))
            table.add(part, own, found)
            hits = np.bincount(own, minlength=len(left))
            out[left[open_]] = part[open_] / hits[open_, None]
            left = np.where(open_, -1, left)
        return out


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n over all of ``texts`` (lang, text): summed in each task and again before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                own = seen[lang.as_py()]
                for words in pieces(text.as_py()):
                    own.update(words)
                    if sum(map(len, seen.values())) > WORDS:
                        yield from flushed(seen)
                        own = seen[lang.as_py()]
        yield from flushed(seen)

    def flushed(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in seen.items():
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])
        seen.clear()

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, m (code points), key, n of the n-grams in counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, WORDS):
                part = b.slice(i, WORDS)
                langs, numbers = np.unique(np.array(part.column(0).to_pylist(), object), return_inverse=True)
                n = part.column(2).to_numpy()
                for m, (own, keys) in enumerate(grams(part.column(1).to_pylist()), 1):
                    distinct, inverse = np.unique(keys, return_inverse=True)
                    both, at = np.unique(numbers[own] * len(distinct) + inverse, return_inverse=True)
                    total = np.zeros(len(both), np.int64)
                    np.add.at(total, at, n[own])
                    columns = [pa.array(langs[both // max(1, len(distinct))].tolist(), pa.string()), pa.array(np.full(len(both), m, np.int32)), pa.array(distinct[both % max(1, len(distinct))].view(np.int64)), pa.array(total)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "m", "key", "n"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, m int, key long, n long").groupBy("lang", "m", "key").agg(F.sum("n").alias("n"))


def shares(counts: DataFrame, per: list[str], least: float) -> DataFrame:
    """``counts`` with share, its part of all occurrences of ``per``, where that is ``least`` or more."""
    totals = written(counts.groupBy(*per).agg(F.sum("n").alias("total")))
    return counts.join(small_side(totals), per).withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= least)


def learn(rows: DataFrame) -> Model:
    """The model of ``rows`` (lang, text), neither null. What the driver gathers is bounded by the entries named above."""
    words = written(word_counts(rows))
    languages = [r[0] for r in words.select("lang").distinct().orderBy("lang").toLocalIterator()]
    number = {lang: i for i, lang in enumerate(languages)}

    def entries(counts: DataFrame, per: list[str], most: int, *columns: str) -> tuple:
        least = max(1, len(languages)) / most
        kept = shares(counts, per, least).select("lang", "share", *columns).toPandas()
        return kept, kept["lang"].map(number).to_numpy(np.int64), PENALTY - np.log10(least) + np.log10(kept["share"].to_numpy(float))

    kept, langs, gains = entries(words, ["lang"], WORD_ENTRIES, "word")
    names = {w: i for i, w in enumerate(sorted(set(kept["word"])))}
    table = Table.of(kept["word"].map(names).to_numpy(np.int64), langs, gains)
    counts, orders = written(gram_counts(words)), []
    for m in range(1, TOP + 1):
        kept, langs, gains = entries(counts.where(F.col("m") == m), ["lang"], GRAM_ENTRIES, "key")
        orders.append(Table.of(kept["key"].to_numpy(np.int64).view(np.uint64), langs, gains))
    return Model(languages, names, table, orders)


class Scorer:
    """Sums of texts in turn; a text's sums do not depend on its neighbours."""

    def __init__(self, model: Model):
        self.model, self.ids, self.open, self.size = model, defaultdict(count().__next__), [], 0

    def add(self, text: int, words: list[str]) -> None:
        self.open.append((text, np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))))
        self.size += len(words)

    def sums(self, out: np.ndarray, n: np.ndarray) -> None:
        """Add the open pieces to ``out`` (texts by languages) and ``n`` (words)."""
        gains = self.model.gains(list(self.ids))
        at, own = np.concatenate([x for _, x in self.open]), np.repeat(np.arange(len(self.open)), [len(x) for _, x in self.open])
        by_piece = np.stack([np.bincount(own, gains[at, i], len(self.open)) for i in range(gains.shape[1])], 1)
        for (text, ids), row in zip(self.open, by_piece, strict=True):
            out[text] += row
            n[text] += len(ids)
        self.ids.clear()
        self.ids.default_factory = count().__next__
        self.open, self.size = [], 0


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (existing columns of those names are replaced).

    ``lang_pred`` is the learned language of least sum, ties to the smallest name; ``und``
    with score 0 if the text is null or holds no letter, or if nothing was learned. A text
    none of whose letters is known to any language gets the first language with an even
    score. ``score`` is the language's part of ``10 ** -sum`` over all languages. Texts are
    read whole, in pieces, so very long ones need no more memory. Rows are kept one by one
    (repeated ones too); an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, guess = free(docs.columns, "text_read"), free(docs.columns, "guess")
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    whole = docs.select(*kept, F.col("text").cast("string").alias(text))
    schema = whole.drop(text).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out, n = np.zeros((b.num_rows, len(model.languages))), np.zeros(b.num_rows, np.int64)
            scorer = Scorer(model)
            for i, t in enumerate(b.column(b.num_columns - 1)):
                for words in pieces(t.as_py() or "") if model.languages else ():
                    if words:
                        scorer.add(i, words)
                    if scorer.size > WORDS:
                        scorer.sums(out, n)
            if scorer.open:
                scorer.sums(out, n)
            some = np.flatnonzero(n)
            names, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if len(some):
                best = out[some].argmax(1)
                names[some] = np.array(model.languages, object)[best]
                score[some] = 1 / (10.0 ** np.maximum(out[some] - out[some].max(1, keepdims=True), -300)).sum(1)
            columns = [*b.columns[:-1], pa.array(names.tolist(), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "lang_pred", "score"])

    return whole.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned on the rows with a language whose fold is not 2, predicted for all.

    A null doc_id has no fold: such a row is neither learned from nor held out.
    """
    learned = docs.where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return identify(rows, learn(learned)).select("doc_id", "held_out", "lang_pred", "score")
