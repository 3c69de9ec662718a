"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

Two models for each class, both counted from distinct words or word pairs, so that no
count depends on how the rows are dealt:

* spelling: n-grams of a word's bytes, so inflections that the labelled rows lack still
  lean on stems that they hold. Orders over ``SHARED`` are counted for each class, the
  lowest ones over all words of the corpus;
* sequence: pairs of words, backing off to how many words a word follows in the class,
  and further to its share of the whole corpus, so that a rare expression of common words
  tells its class and a common one does not.

Below the top order an n-gram counts its distinct left neighbours (continuation counts);
one that starts a word has none and counts its occurrences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, written
from .line_dedup import NORMAL, mixed

ORDER, SHARED, CACHE, WORDS, TEXTS = 6, 2, 400_000, 20_000, 256
FIRST, LAST = 2, 3  # mark a word's edges; no word holds them
TAILS = (1.0, 3.0)
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Level:
    """One order: sorted n-grams with counts, sorted contexts with totals and types (columns: ordinary, toxic)."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    types: np.ndarray
    discount: np.ndarray

    def smoothed(self, gram: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Interpolated Kneser-Ney probabilities of each class over ``lower``, those of the order below."""
        total, types = lookup(self.contexts, self.totals, context), lookup(self.contexts, self.types, context)
        c = np.maximum(lookup(self.grams, self.counts, gram) - self.discount, 0)
        return np.where(total > 0, (c + self.discount * types * lower) / np.maximum(total, 1e-9), lower)


@dataclass
class Model:
    levels: list[Level] = field(default_factory=list)
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    pair_ratios: np.ndarray = field(default_factory=lambda: np.empty(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 + len(TAILS)))
    offset: float = -30.0
    sent: tuple | None = field(default=None, repr=False, compare=False)

    def tables(self, context: SparkContext) -> Broadcast:
        """The tables as tasks get them, sent once however often the model is used: the driver holds one copy. Weights stay on the driver."""
        if self.sent is None or self.sent[0] is not context:
            self.sent = context, context.broadcast(Model(self.levels, self.pairs, self.pair_ratios))
        return self.sent[1]

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """log P(spelling | toxic) - log P(spelling | ordinary) of each word."""
        if not words or not self.levels:
            return np.zeros(len(words))
        own, at, orders = grams(words)
        p = np.full((len(own), 2), 1 / 256)
        for n, (level, gram) in enumerate(zip(self.levels, orders, strict=True), 1):
            ok = at >= max(1, n - 1)
            p[ok] = level.smoothed(gram[ok], gram[ok] >> np.uint64(8), p[ok])
        got = np.log(p[:, 1] / p[:, 0])
        got[at == 0] = 0
        return np.bincount(own, got, len(words))


def grams(words: list[bytes], top: int = ORDER) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word number and place of each byte (edges marked), and for each order the n-gram that ends there.

    An n-gram is its bytes in one integer, the last one lowest: shifted by a byte it is
    its context, without the highest byte its suffix. No byte is 0, so orders never mix.
    """
    x = np.frombuffer(b"".join(bytes([FIRST]) + w + bytes([LAST]) for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    own = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(x)) - (np.cumsum(sizes) - sizes)[own]
    out, gram = [], np.zeros(len(x), np.uint64)
    for n in range(top):
        gram = gram.copy()
        gram[n:] |= x[: max(0, len(x) - n)] << np.uint64(8 * n)
        out.append(gram)
    return own, at, out


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key for each pair of word hashes."""
    return mixed(a * STEP + b)


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros((len(wanted), *values.shape[1:]))
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    same = keys[at] == wanted
    return np.where(same[:, None] if values.ndim > 1 else same, values[at], 0.0)


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: ASCII letters lower-cased, ASCII punctuation dropped."""
    return (text or "").encode().translate(NORMAL).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n: occurrences over all of ``docs``, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                seen.update(words_of(text.as_py()))
                if len(seen) > CACHE:
                    yield from flush(seen)
        yield from flush(seen)

    def flush(seen: Counter) -> Iterator[pa.RecordBatch]:
        names, counts = list(seen), list(seen.values())
        for i in range(0, len(names), WORDS):
            yield pa.RecordBatch.from_arrays([pa.array(names[i : i + WORDS], pa.binary()), pa.array(counts[i : i + WORDS], pa.int64())], names=["word", "n"])
        seen.clear()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_words(sample: DataFrame) -> DataFrame:
    """word, n0, n1: occurrences in the ordinary and the toxic rows of a labelled sample."""
    counts = [word_counts(sample.where(F.col("toxic") == y)).withColumnRenamed("n", f"n{y}") for y in (0, 1)]
    return counts[0].join(counts[1], "word", "full").na.fill(0)


def gram_counts(words: DataFrame, top: int, lowest: int) -> DataFrame:
    """level, gram, n0, n1 for the orders ``lowest`` to ``top`` of a table of distinct words (word, n0, n1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, WORDS):
                some = b.slice(i, WORDS)
                n = np.stack([some.column(c).to_numpy() for c in (1, 2)], axis=1)
                own, at, orders = grams(some.column(0).to_pylist(), top)
                for order in range(lowest, top + 1):
                    good = at >= order - 1 if order == top else at == order - 1
                    good &= at >= 1
                    keys, group = np.unique(orders[order - 1][good], return_inverse=True)
                    sums = [np.bincount(group, n[own[good], y], len(keys)).astype(np.int64) for y in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.view(np.int64)), *map(pa.array, sums)], names=["level", "gram", "n0", "n1"])

    counted = written(words.mapInArrow(run, "level int, gram long, n0 long, n1 long").groupBy("level", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    every = level = counted.where(F.col("level") == top)
    for order in range(top - 1, lowest - 1, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")
        types = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("n0", "n1")]
        inside = level.select(suffix, "n0", "n1").groupBy("gram").agg(*types).select(F.lit(order).alias("level"), "gram", "n0", "n1")
        level = inside.union(counted.where(F.col("level") == order))
        every = every.union(level)
    return every


def pair_counts(sample: DataFrame) -> DataFrame:
    """a, b (word hashes), n0, n1: neighbouring words in the ordinary and the toxic rows of a labelled sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1), strict=True):
                h = np.array([xxhash.xxh64_intdigest(w, 42) for w in words_of(text.as_py())], np.uint64).view(np.int64)
                if len(h) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(h[:-1]), pa.array(h[1:]), pa.array(np.full(len(h) - 1, toxic.as_py(), np.int32))], names=["a", "b", "toxic"])

    rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "a long, b long, toxic int")
    return rows.groupBy("a", "b").agg(*(F.sum((F.col("toxic") == y).cast("long")).alias(f"n{y}") for y in (0, 1)))


def fold(doc_id) -> F.Column:
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int) -> DataFrame:
    """text, toxic, fold of labelled rows outside fold 0, at most ``max_rows`` and ``max_chars`` code points a class.

    The rows with the smallest hash of the doc_id are taken, so a rerun takes the same; of
    a repeated doc_id the smallest text.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.withColumn("fold", fold("id")).where("fold <> 0")
    rank = F.xxhash64(F.col("id"), F.lit(8))
    take = [marked.where(F.col("toxic") == y).orderBy(rank, "id").limit(max_rows) for y in (0, 1)]
    few = F.broadcast(take[0].union(take[1]))  # at most 2 * max_rows rows of 16 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(few, "id")
    rows = rows.groupBy("id", "toxic", "fold").agg(F.min("text").alias("text"))
    upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.partitionBy("toxic").orderBy(rank, "id"))  # at most max_rows rows
    return rows.withColumn("upto", upto).where(F.col("upto") <= max_chars).select("text", "toxic", "fold")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, max_chars: int = 50_000_000, min_pair: int = 2) -> Model:
    """Train on the labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    Folds 2 to 4 give the counts, fold 1 the weights that turn ratios into a
    probability. ``max_rows`` and ``max_chars`` bound the labelled sample of each class,
    and so the model, and ``min_pair`` leaves out word pairs that the sample holds less often; the shared counts take every word of every document. Without a row
    of both classes every score is 0.
    """
    sample = written(labelled_sample(docs, labels, max_rows, max_chars))
    own = sample.where("fold <> 1")
    if own.select("toxic").distinct().count() < 2:
        return Model()
    corpus = written(word_counts(docs))
    words = written(class_words(own))
    shared = gram_counts(corpus.select("word", F.col("n").alias("n0"), F.col("n").alias("n1")), SHARED, 1)  # at most 257 + 257**2 rows
    by_class = gram_counts(words, ORDER, SHARED + 1)  # bounded by the sample
    shared, by_class = written(shared), written(by_class)
    model = Model([level(shared if n <= SHARED else by_class, n) for n in range(1, ORDER + 1)])
    model.pairs, model.pair_ratios = sequence(pair_counts(own), words, corpus, min_pair)
    return calibrate(model, sample)


def discounts(counts: np.ndarray) -> np.ndarray:
    once, twice = (counts == 1).sum(axis=0), (counts == 2).sum(axis=0)
    return np.array([cut_off(a, b) for a, b in zip(once, twice, strict=True)])


def cut_off(once: int, twice: int) -> float:
    """The absolute discount, from how many n-grams were counted once and twice."""
    return float(min(0.95, max(0.1, once / max(1, once + 2 * twice))))


def table_of(grams: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> Level:
    known, of = np.unique(contexts, return_inverse=True)
    sums = [np.stack([np.bincount(of, v[:, y], len(known)) for y in (0, 1)], axis=1).astype(np.float32) for v in (counts, counts > 0)]
    ordered = np.argsort(grams, kind="stable")
    return Level(grams[ordered], counts[ordered].astype(np.float32), known, *sums, discounts(counts))


def level(counted: DataFrame, order: int) -> Level:
    """One order's table, collected by itself and kept in short floats: the driver never holds two orders twice."""
    rows = counted.where(F.col("level") == order).select("gram", "n0", "n1").toArrow()  # no Python object for each row
    gram = rows["gram"].to_numpy().view(np.uint64)
    return table_of(gram, gram >> np.uint64(8), np.stack([rows[c].to_numpy() for c in ("n0", "n1")], axis=1))


def sequence(pairs: DataFrame, words: DataFrame, corpus: DataFrame, min_pair: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the sample's word pairs, and log P(b after a | toxic) - log P(b after a | ordinary) of each.

    A pair seen fewer than ``min_pair`` times says nothing, but counts in what the others are measured by.
    """
    pairs = written(pairs)
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    times = lambda c, n: F.sum((F.col(c) == n).cast("long"))
    before = pairs.groupBy("a").agg(*(f(c).alias(f"{p}{c}") for c in ("n0", "n1") for f, p in ((F.sum, "total_"), (seen, "types_"))))
    after = written(pairs.groupBy("b").agg(seen("n0").alias("f0"), seen("n1").alias("f1")))
    total = corpus.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    share = words.select("word").join(corpus, "word").select(F.xxhash64("word").alias("b"), (F.col("n") / total).alias("s"))
    scored = pairs.where(F.col("n0") + F.col("n1") >= min_pair).join(before, "a").join(after, "b").join(share, "b")
    log_p = []
    for y in (0, 1):
        once, twice = pairs.agg(times(f"n{y}", 1), times(f"n{y}", 2)).first()
        f_once, f_twice, f_total, f_types = after.agg(times(f"f{y}", 1), times(f"f{y}", 2), F.sum(f"f{y}"), seen(f"f{y}")).first()
        if not f_total:
            log_p.append(F.log("s"))
            continue
        d, e = cut_off(once, twice), cut_off(f_once, f_twice)
        lower = (F.greatest(F.col(f"f{y}") - e, F.lit(0.0)) + F.lit(e * f_types) * F.col("s")) / f_total
        own = (F.greatest(F.col(f"n{y}") - d, F.lit(0.0)) + d * F.col(f"types_n{y}") * lower) / F.col(f"total_n{y}")
        log_p.append(F.log(F.when(F.col(f"total_n{y}") > 0, own).otherwise(lower)))
    rows = scored.select("a", "b", (log_p[1] - log_p[0]).alias("ratio")).toArrow()
    keys = pair_keys(*(rows[c].to_numpy().view(np.uint64) for c in ("a", "b")))
    order = np.argsort(keys)
    return keys[order], rows["ratio"].to_numpy()[order]


def features(docs: DataFrame, model: Model, name: str = "ratio") -> DataFrame:
    """``docs`` with ``name``, array<double>: the mean over a text's words of the spelling ratio, of its parts above each of ``TAILS``, and of the sequence ratio.

    A task scores each distinct word of some texts together and keeps the scores; a bounded
    cache holds them.
    """
    shared = model.tables(docs.sparkSession.sparkContext)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ratio, hashed = np.empty(0), np.empty(0, np.uint64)
        for b in batches:
            for part in range(0, b.num_rows, TEXTS):
                some = b.slice(part, TEXTS)
                texts = [words_of(t.as_py()) for t in some.column(at)]
                if len(known) > CACHE:
                    known, ratio, hashed = {}, ratio[:0], hashed[:0]
                new = list(set().union(*texts).difference(known))
                known.update(zip(new, range(len(ratio), len(ratio) + len(new)), strict=True))
                ratio = np.concatenate([ratio, *(shared.value.ratios(new[i : i + WORDS]) for i in range(0, len(new), WORDS))])
                hashed = np.concatenate([hashed, np.array([xxhash.xxh64_intdigest(w, 42) for w in new], np.uint64)])
                sizes = np.array([len(words) for words in texts])
                ids = np.fromiter((known[w] for words in texts for w in words), np.int64, int(sizes.sum()))
                got = summaries(ratio[ids], hashed[ids], sizes, shared.value)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(list(got), pa.list_(pa.float64()))], names=[*names, name])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{name}` array<double>"]))


def summaries(ratio: np.ndarray, hashed: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """One row of features for each text of ``sizes`` words."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    pair = np.zeros(len(ratio))
    if len(ratio) > 1 and len(model.pairs):
        pair[1:] = np.where(own[1:] == own[:-1], lookup(model.pairs, model.pair_ratios, pair_keys(hashed[:-1], hashed[1:])), 0)
    columns = [ratio, *(np.maximum(ratio - t, 0) for t in TAILS), pair]
    return np.stack([np.bincount(own, c, len(sizes)) / np.maximum(sizes, 1) for c in columns], axis=1)


def calibrate(model: Model, sample: DataFrame) -> Model:
    """Logistic weights over fold 1 (over all of the sample, where fold 1 lacks a class)."""
    got = features(sample, model).select("toxic", "fold", "ratio").toPandas()
    own = got[got["fold"] == 1]
    if own["toxic"].nunique() < 2:
        own = got
    rows = np.array(sorted([*r, float(y)] for r, y in zip(own["ratio"], own["toxic"], strict=True)))  # in one order, however collected
    x, y = rows[:, :-1], rows[:, -1]
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.concatenate([(x - x.mean(axis=0)) / scale, np.ones((len(x), 1))], axis=1)
    ridge, beta = np.array([1.0] * x.shape[1] + [1e-6]), np.zeros(x.shape[1] + 1)
    for _ in range(100):  # damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * beta)
        beta += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    model.weights = beta[:-1] / scale
    model.offset = float(beta[-1] - (model.weights * x.mean(axis=0)).sum())
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with ``name`` (0 to 1, higher: toxic likelier). Empty and null texts get the score of ratios 0.

    All rows and columns stay, ties and repeated rows get equal scores, and nothing is
    shuffled. Only the text is an input. ``name`` must be no column of ``docs``.
    """
    inner = free([*docs.columns, name], "ratio")
    rows = features(docs.withColumn("text", F.col("text").cast("string")), model, inner)
    x = F.lit(model.offset)
    for i, w in enumerate(model.weights.tolist()):
        x = x + F.col(inner)[i] * w
    x = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), x))
    return rows.withColumn(name, 1 / (1 + F.exp(-x))).drop(inner)


def scored(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; other columns are ignored, an empty table gives an empty result."""
    model = fit(docs, labels, **parameters)
    rows = score(docs.select("doc_id", "text"), model)
    held = fold("doc_id") == 0
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, with all their columns, of any name."""
    name = free(docs.columns, "score")
    return score(docs, fit(docs, labels, **parameters), name).where(F.col(name) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))
