"""Phrase collocations per language by Toivonen's sampling.

A sample of the documents proposes frequent phrases. One pass over all documents counts
them together with their negative border: every phrase that is not proposed, but both of
whose longest parts (without the last, without the first word) are. No part of a frequent
phrase is rarer than the phrase, so the sample missed something only if a border phrase
turns out frequent; then the border moves out to its closure and a further pass counts
what is new. All counts that leave this module are exact.

The border is never listed: a task counts a phrase where it meets it, if a filter holds
both its parts. That filter is a Bloom filter of fixed size, so what is broadcast does not
grow with the data; a false hit makes a phrase be counted that need not be, which costs
time but changes no result. These passes count 64-bit marks of phrases, since most of a
border is rare and its texts need not travel; marks that two phrases share only raise a
count. A last pass counts the texts of all phrases whose mark reached the threshold, and
what it finds below the threshold goes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, written

# Fixed values of the contract: where pieces end, and the scale of a score.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
SCALE = 2_000_000

LONGEST = 4
CHUNK = 4 << 20  # bytes of text that are counted together
FILTER_WORDS = 1 << 19  # of 64 bits, 4 MB
PROBES = 4
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + PIECE_ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(PIECE_ENDS))
BATCH = 20_000
EXTENDABLE = f"mark & 3 < {LONGEST - 1}"


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that every bit of a mark depends on all its words."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def mark(x: np.ndarray, m: int) -> np.ndarray:
    """The mark of phrases of ``m`` words; its lowest two bits are m - 1."""
    return (mixed(x) & ~np.uint64(3)) | np.uint64(m - 1)


class Known:
    """Bloom filter over marks; the empty one knows nothing."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, marks: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(marks), bool)
        need = np.zeros(len(marks), np.uint64)
        for i in range(PROBES):
            need |= np.uint64(1) << ((marks >> np.uint64(6 * i + 8)) & np.uint64(63))
        return self.words[(marks >> np.uint64(32)) % np.uint64(len(self.words))] & need == need


def known(found: DataFrame, before: np.ndarray, size: int = FILTER_WORDS) -> np.ndarray:
    """The filter ``before`` with the marks of ``found`` added; at most ``size`` rows of two numbers reach the driver."""
    bits = F.expr(" | ".join(f"shiftleft(1L, cast(shiftright(mark, {6 * i + 8}) & 63 as int))" for i in range(PROBES)))
    at = F.shiftrightunsigned("mark", 32) % size
    rows = found.select(at.alias("at"), bits.alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = before.copy() if len(before) or not len(rows) else np.zeros(size, np.uint64)
    out[rows["at"].to_numpy(np.int64)] |= rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, words and piece ends in order, spaced) in chunks of about ``CHUNK`` bytes; chunks end where a piece does."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0

    def flush() -> Iterator[tuple[str, bytes]]:
        for lang, parts in held.items():
            yield lang, b".".join([b"", *parts, b""]).translate(TABLE).replace(b".", b" . ").strip()
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            lang, data, start = lang.as_py(), text.as_buffer().to_pybytes(), 0
            while start < len(data):  # a very long text is cut at the first piece end after CHUNK bytes
                end = len(data)
                if end - start > CHUNK:
                    end = min((at for at in (data.find(bytes([c]), start + CHUNK) for c in PIECE_ENDS) if at >= 0), default=end)
                held[lang].append(data[start:end])
                size += end - start
                start = end
                if size >= CHUNK:
                    yield from flush()
                    size = 0
    yield from flush()


@dataclass
class Level:
    """Distinct phrases of ``m`` words in a chunk: marks, counts, whether no earlier pass counted them, and their texts by number."""

    m: int
    marks: np.ndarray
    a: np.ndarray
    fresh: np.ndarray
    texts: Callable[[np.ndarray], list[str]]


def levels(lang: str, chunk: bytes, now: Known, before: Known, ahead: bool = False) -> Iterator[Level]:
    """The words of a chunk, then its longer phrases both of whose parts ``now`` knows.

    ``fresh`` are those that no earlier pass counted: it did not take both their parts for
    parts, because ``before`` did not know one, or knew it by a false hit only and never
    met it. ``ahead`` takes them for parts as well. Within a chunk a phrase is a
    number: that of its first words and that of its last word in one integer, numbered
    anew for each length. ``heads`` has the number of the phrase that starts at a place,
    or -1.
    """
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(chunk)], np.int64)), pa.py_buffer(chunk)])
    coded = pc.ascii_split_whitespace(whole).values.dictionary_encode()
    at, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    words = np.array([i for i, w in enumerate(names) if w != "."], np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    marks = mark(hashes ^ np.uint64(xxhash.xxh64_intdigest(lang, 1)), 1)
    built: list[tuple[np.ndarray, np.ndarray]] = []  # of each length: number of the first words, last word

    def texts(m: int, which: np.ndarray) -> list[str]:
        # no recursion: a function that holds itself would keep its chunk's arrays until Python looks for cycles
        parts: list[list[str]] = []
        for left, last in reversed(built[: m - 1]):
            parts.append([names[i] for i in last[which].tolist()])
            which = left[which]
        parts.append([names[i] for i in which.tolist()])
        return parts[0] if m == 1 else list(map(" ".join, zip(*reversed(parts), strict=True)))

    yield Level(1, marks[words], np.bincount(at, minlength=len(names))[words], np.ones(len(words), bool), lambda which: texts(1, words[which]))
    is_word = np.zeros(len(names), bool)
    is_word[words] = True
    heads = np.where((now.holds(marks) & is_word)[at], at, -1)
    parts_before = before.holds(marks) & is_word  # of each number: was it a part in the earlier pass?
    for m in range(2, LONGEST + 1):
        place = np.flatnonzero((heads[:-1] >= 0) & (heads[1:] >= 0))
        if not len(place):
            return
        numbers, index, inverse, a = np.unique(heads[place] * len(names) + at[place + m - 1], return_index=True, return_inverse=True, return_counts=True)
        left, last = numbers // len(names), numbers % len(names)
        built.append((left, last))
        fresh = ~(parts_before[left] & parts_before[heads[place[index] + 1]])
        marks = mark(marks[left] * np.uint64(0x9E3779B97F4A7C15) + hashes[last], m)
        yield Level(m, marks, a, fresh, lambda which, m=m: texts(m, which))
        part = now.holds(marks) | (fresh & ahead)
        parts_before = before.holds(marks) & ~fresh
        heads = np.full(len(at), -1)
        heads[place] = np.where(part[inverse], inverse, -1)


def counted(texts: DataFrame, now: np.ndarray, before: np.ndarray, first: bool, at_least: int) -> DataFrame:
    """mark, a of what a pass counts and finds ``at_least`` times, as a written table.

    The first pass counts words and all phrases whose parts ``now`` knows. A later one
    counts the phrases that it did not, ``ahead``: with parts that it counts itself. Chunks
    are summed in the task, then by Spark before its shuffle, so a frequent word is a row a
    chunk and no occurrence travels.
    """
    shared = texts.sparkSession.sparkContext.broadcast((now, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = map(Known, shared.value)
        for lang, chunk in chunks(batches):
            for level in levels(lang, chunk, now, before, not first):
                if level.m > 1 or first:
                    marks, a = level.marks[level.fresh], level.a[level.fresh]
                    for i in range(0, len(marks), 10 * BATCH):
                        part = slice(i, i + 10 * BATCH)
                        yield pa.RecordBatch.from_arrays([pa.array(marks[part].view(np.int64)), pa.array(a[part])], names=["mark", "a"])

    rows = texts.mapInArrow(run, "mark long, a long").groupBy("mark").agg(F.sum("a").alias("a"))
    out = written(rows.where(F.col("a") >= at_least))
    shared.destroy()
    return out


def spelled(texts: DataFrame, wanted: np.ndarray, at_least: int) -> DataFrame:
    """lang, phrase, a, m (words): exact counts of the phrases that ``wanted`` knows, ``at_least`` or more; n of a language at m 0."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Known(shared.value)
        for lang, chunk in chunks(batches):
            for level in levels(lang, chunk, wanted, Known(np.empty(0, np.uint64))):
                if level.m == 1:
                    yield batch(lang, [None], level.a.sum(keepdims=True))
                own = np.flatnonzero(wanted.holds(level.marks))
                for i in range(0, len(own), BATCH):
                    part = own[i : i + BATCH]
                    yield batch(lang, level.texts(part), level.a[part])

    def batch(lang: str, phrases: list[str | None], a: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(a, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "a"])

    rows = texts.mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    m = F.when(F.col("phrase").isNull(), 0).otherwise(F.size(F.split("phrase", " ", -1)))
    out = written(rows.where((F.col("a") >= at_least) | F.col("phrase").isNull()).withColumn("m", m))
    shared.destroy()
    return out


def closed(texts: DataFrame, seed: np.ndarray, at_least: int) -> tuple[np.ndarray, DataFrame]:
    """(filter, marks): every phrase whose mark is found ``at_least`` times in ``texts``; the filter knows those that can be part of a longer one.

    The first pass counts what ``seed`` knows and its border. If frequent phrases change the
    filter, so it did not know them all, the border moves out until it is closed: one more
    pass counts what lies between, and what hangs on that. A frequent phrase has frequent
    parts, which the first pass counted and found or the second counts, so none is missed.
    """
    nothing = np.empty(0, np.uint64)
    found = counted(texts, seed, nothing, True, at_least)
    now = known(found.where(EXTENDABLE), seed)
    if np.array_equal(now, seed):
        return now, found
    more = counted(texts, now, seed, False, at_least)
    return known(more.where(EXTENDABLE), now), found.union(more)


def phrase_counts(docs: DataFrame, at_least: int = 30, share: int = 16, slack: float = 1.0) -> DataFrame:
    """lang, phrase, m, a of every phrase of 1 to 4 words that occurs ``at_least`` times in a language; n of a language at m 0.

    One document in ``share`` is in the sample, chosen by a hash of its language and text,
    and proposes phrases found there ``at_least / share`` times less ``slack`` standard
    deviations. Sample, border and threshold decide only how many passes it takes.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    expected = at_least / share
    lowered = max(2, int(expected - slack * expected**0.5))
    sample = texts.where(F.pmod(F.xxhash64("lang", "text"), F.lit(share)) == 0)
    seed, _ = closed(sample, np.empty(0, np.uint64), lowered)
    parts, frequent = closed(texts, seed, at_least)
    return spelled(texts, known(frequent, parts), at_least)


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of each candidate: the cheapest cut, ties to the shortest first part."""
    parts = frequent.where("m between 1 and 3").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    parts = small_side(parts, F.octet_length("part") + F.octet_length("lang") + 16)
    words = F.split("phrase", " ", -1)
    cuts = frequent.where("m >= 2").select("lang", "phrase", "a", F.size(words).alias("m"), words.alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    piece = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("head"), piece(F.col("k") + 1, F.col("m") - F.col("k")).alias("tail"))
    with_l = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    both = with_l.join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # 38 digits: the product passes 64 bits from 4.6e12 occurrences on
    wide = lambda c: c.cast("decimal(19,0)")
    score = F.call_function("div", wide(F.col("a")) * F.lit(SCALE).cast("decimal(7,0)"), wide(F.col("l")) + wide(F.col("r")))
    cut = F.struct(score.cast("long").alias("score"), "k", "l", "r")
    return both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(cut).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def dominated(frequent: DataFrame) -> DataFrame:
    """lang, phrase, most: the largest count of a longer candidate that holds the phrase's words side by side."""
    words = F.split("phrase", " ", -1)
    longer = frequent.where("m >= 3").select("lang", "a", "m", words.alias("w")).select("*", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("k"))
    inner = longer.select("lang", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("k") + 1)).alias("i"))
    return inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("phrase")).agg(F.max("a").alias("most"))


ROWS_A_SALT = 50_000


def first_rows(rows: DataFrame, top: int, order: list[Column]) -> DataFrame:
    """The first ``top`` rows of each language with their rank: within salted parts first, so no task sorts a whole language."""
    salts = 1 + rows.count() // ROWS_A_SALT
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    kept = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, at_least: int = 30, top: int = 2000, covered: int = 80, share: int = 16) -> DataFrame:
    """Per language the ``top`` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    ``docs`` needs ``text`` and ``lang``; other columns are ignored. A null language is
    ``und`` and merges with one of that name; null and empty texts hold no word; repeated
    rows count each. Phrases that tie in score and count rank by their UTF-8 bytes. A
    candidate goes if a longer one holds it in at least ``covered`` of 100 occurrences.
    An empty table gives an empty result. Long texts are cut between pieces, never shortened.
    """
    counts = written(phrase_counts(docs, at_least, share))
    frequent = counts.where("m > 0 and a >= {}".format(int(at_least)))
    sizes = counts.where("m = 0").select("lang", F.col("a").alias("n"))
    rows = scored(frequent).join(dominated(frequent), ["lang", "phrase"], "left")
    wide = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(3,0)")
    kept = written(rows.where(F.col("most").isNull() | (wide("most", 100) < wide("a", covered))).drop("most"))
    ranked = first_rows(kept, top, [F.desc("score"), F.desc("a"), F.asc("phrase")])
    return ranked.join(small_side(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
