"""Fuzzy line deduplication: SimHash blocks, edit similarity, connected groups.

Blocks cut from one 64-bit SimHash find half of the line pairs with an edit similarity of
0.8: such pairs lie 6 bits apart at the median and 12 in one of twenty cases. So each of
``BLOCKS`` blocks is made of ``SAMPLE`` words of the line, the smallest under the block's
own hash; lines that differ in few words agree in some block, and the SimHash over all
words discards most chance meetings before texts are compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, small_side, written
from .hamming import near_groups

# ASCII upper case to lower case, other ASCII but letters and digits to spaces; other bytes stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
NORMAL_LINES = NORMAL[:10] + b"\n" + NORMAL[11:]
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# A byte's 8 bits as four 16-bit counters in each of two long integers; a chunk's sums stay under 2**16.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype("<u2").view("<u8")
CHUNK, TEXT_CHARS = 8000, 1 << 18
# Lines of so many words, or so many code points (Chinese or Thai lines have few spaces), are compared with similar ones.
FUZZY_WORDS, FUZZY_CHARS, GRAM = 5, 20, 3
# A pair that shares a part s of its distinct words agrees in no block with chance (1 - s**SAMPLE) ** BLOCKS: 1.5 % at 0.8.
BLOCKS, SAMPLE = 8, 4
FACTORS = np.random.default_rng(42).integers(1 << 31, size=(BLOCKS, SAMPLE), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
COMMON_WORD = np.uint32(1 << 31)
KEYS = [f"key{i}" for i in range(BLOCKS)]
ROOT_BYTES = 16 << 20


def normal_words(line: str) -> list[bytes]:
    """Words of a normalised line: ASCII letters lower-cased, ASCII punctuation dropped."""
    return line.encode().translate(NORMAL).split()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def run_hashes(values: np.ndarray, first: np.ndarray, size: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of each run of values (at ``first``, ``size`` long, covering all): a polynomial in ``base``, mixed."""
    powers = np.full(int(size.max()), base)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(values)) - np.repeat(first, size)
    return mixed(np.add.reduceat((values + np.uint64(1)) * powers[place], first) + size.astype(np.uint64))


def simhashes(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each run [start, end) of weighted hashes; the runs follow each other and none is empty."""
    ones = np.zeros((len(starts), 64), dtype=np.int64)
    for at in range(0, len(h), CHUNK):
        stop = min(at + CHUNK, len(h))
        first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, stop, side="left")
        lanes = SPREAD.take(h[at:stop].astype("<u8").view(np.uint8), axis=0).reshape(-1, 16) * weight[at:stop, None]
        ones[first:last] += np.add.reduceat(lanes, np.maximum(starts[first:last] - at, 0), axis=0).view("<u2")
    total = np.add.reduceat(weight, starts).astype(np.int64)
    return np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each normalised line and, for each word, its number among the distinct ones; hash, bytes and code points of those."""
    x = np.frombuffer(data, np.uint8)
    letter = np.zeros(len(x) + 2, bool)
    np.greater(x, 32, out=letter[1:-1])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    starts, size = edge[::2], edge[1::2] - edge[::2]
    count = np.diff(np.searchsorted(starts, np.append(np.flatnonzero(x == 10), len(x))), prepend=0)
    if not len(starts):
        return count, starts, starts.astype(np.uint64), size, size
    places = np.append(0, np.cumsum(size))
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(places), pa.py_buffer(x[letter[1:-1]])]).dictionary_encode()
    _, places, letters = words.dictionary.buffers()
    places = np.frombuffer(places, np.int64, len(words.dictionary) + 1)
    letters, first, size = np.frombuffer(letters, np.uint8, places[-1]), places[:-1], np.diff(places)
    # A character's further UTF-8 bytes are 10xxxxxx.
    points = np.add.reduceat((letters & 0xC0) != 0x80, first, dtype=np.int64)
    return count, words.indices.to_numpy(), run_hashes(letters.astype(np.uint64), first, size, BASE), size, points


def line_grams(line: bytes) -> bytes:
    """The overlapping code point triples of a normalised line, as words."""
    text = "".join(line.decode().split())
    return " ".join({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}).encode()


def sampled_blocks(h: np.ndarray, common: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row for each run of word hashes and one signed 64-bit key for each block of ``SAMPLE`` sampled words.

    Words of at most three bytes are sampled only where a line lacks longer ones.
    """
    late, keys = np.where(common, COMMON_WORD, np.uint32(0)), np.empty((len(first), BLOCKS), np.uint64)
    h = (h >> np.uint64(32)).astype(np.uint32)
    for block, factors in enumerate(FACTORS):
        key = np.full(len(first), np.uint64(block))
        for factor in factors:
            value = h * factor
            value >>= np.uint32(1)
            value |= late
            key = key * STEP + np.minimum.reduceat(value, first)
        keys[:, block] = mixed(key)
    return keys.view(np.int64)


@dataclass
class Lines:
    """Lines with a word: text and line number, identity, SimHash, words, code points, compared fuzzily, block keys."""

    text: np.ndarray
    number: np.ndarray
    ident: np.ndarray
    prints: np.ndarray
    words: np.ndarray
    chars: np.ndarray
    fuzzy: np.ndarray
    keys: np.ndarray


def line_table(texts: list[str | None]) -> Lines:
    """All lines of some texts that hold a word, looked at together.

    The identity covers the line's words in order. SimHash and blocks cover its distinct
    words (its distinct code point triples, where it has under ``FUZZY_WORDS`` words but
    ``FUZZY_CHARS`` code points); in the SimHash those over three bytes weigh twice, so
    neither a word repeated many times nor the commonest words outweigh the rest.
    """
    data = [(t or "").encode().translate(NORMAL_LINES) for t in texts]
    n_lines = np.array([d.count(b"\n") + 1 for d in data])
    joined = b"\n".join(data)
    count, code, h, size, points = hashed_words(joined)
    which = np.flatnonzero(count)
    if not len(which):
        none, no_key = np.empty(0, np.int64), np.empty(0, np.uint64)
        return Lines(none, none, no_key, no_key, none, none, none.astype(bool), none.reshape(0, BLOCKS))
    own = count[which]
    chars = np.add.reduceat(points[code], np.cumsum(own) - own) + own - 1  # spaces between words count
    ident = run_hashes(h[code], np.cumsum(own) - own, own, STEP)
    text = np.repeat(np.arange(len(texts)), n_lines)[which]
    dense = (own < FUZZY_WORDS) & (chars >= FUZZY_CHARS)
    # Copies of a line are looked at once.
    _, some, copy = np.unique(ident, return_index=True, return_inverse=True)
    plain = np.zeros(len(which), bool)
    plain[some] = ~dense[some]
    kind = np.empty(len(which), np.int64)
    kind[some] = np.arange(len(some))
    line, code = np.repeat(kind[plain], own[plain]), code[np.repeat(plain, own)]
    if dense[some].any():
        ends = np.flatnonzero(np.frombuffer(joined + b"\n", np.uint8) == 10)
        at = some[dense[some]]
        parts, part, part_h, part_size, _ = hashed_words(b"\n".join(line_grams(joined[ends[w - 1] + 1 if w else 0 : ends[w]]) for w in which[at].tolist()))
        line, code = np.concatenate([line, np.repeat(kind[at], parts)]), np.concatenate([code, part + len(h)])
        h, size = np.concatenate([h, part_h]), np.concatenate([size, part_size])
    # A word repeated in a line counts once.
    bits = len(h).bit_length()
    held = np.sort(line << bits | code)
    held = held[np.append(True, held[1:] != held[:-1])]
    line, code = held >> bits, held & (1 << bits) - 1
    first = np.searchsorted(line, np.arange(len(some)))
    common = size <= 3
    prints = simhashes(h[code], np.where(common, 1, 2).astype(np.uint64)[code], first, np.append(first[1:], len(code)))[copy]
    number = which - (np.cumsum(n_lines) - n_lines)[text]
    return Lines(text, number, ident, prints, own, chars, (own >= FUZZY_WORDS) | dense, sampled_blocks(h[code], common[code], first)[copy])


def common_start(a: str, b: str) -> int:
    """How many code points two texts have in common at their start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    step = 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def without_ends(a: str, b: str) -> tuple[str, str]:
    """Two texts without what they have in common at both ends, which does not change their distance; the shorter one first."""
    start = common_start(a, b)
    a, b = a[start:], b[start:]
    if end := common_start(a[::-1], b[::-1]):
        a, b = a[:-end], b[:-end]
    return (a, b) if len(a) <= len(b) else (b, a)


def band_distance(a: str, b: str, most: int) -> int | None:
    """The Levenshtein distance of a shorter and a longer text if it is ``most`` at most (under the longer length), else None.

    Myers' recurrence on a window of 2 * most + 2 places that moves down a place in each step (Hyyrö, 2003).
    """
    if len(b) - len(a) > most:
        return None
    masks: dict[str, int] = {}
    for start in range(0, len(b), 4096):  # the first step's window begins most + 1 places above the first one
        part: dict[str, int] = {}
        for i, c in enumerate(b[start : start + 4096]):
            part[c] = part.get(c, 0) | 1 << i
        for c, bits in part.items():
            masks[c] = masks.get(c, 0) | bits << start + most + 1
    top, full = 2 * most + 1, (1 << 2 * most + 2) - 1
    up, down, score, turn, least = full >> most + 1 << most + 1, 0, most, len(b) - most, 2 * most + len(a) - len(b)
    for t, c in enumerate(a):
        eq = masks.get(c, 0) >> t & full
        d = (((eq & up) + up) ^ up | eq | down) & full
        rise, fall = down | ~(d | up) & full, d & up
        if t < turn:
            score += not d >> top
            if score > least:
                return None
        else:
            at = top - 1 - (t - turn)
            score += (rise >> at & 1) - (fall >> at & 1)
        d >>= 1
        up, down = fall | ~(d | rise) & full, d & rise
    return score if score <= most else None


def edit_similarity(a: str, b: str) -> float:
    """1 - Levenshtein distance / longer length, over code points.

    Common ends are trimmed, then Myers' bit-vector recurrence runs on Python's
    long integers, so memory stays linear in the shorter text.
    """
    longest = max(len(a), len(b))
    if a == b:
        return 1.0
    a, b = without_ends(a, b)
    if not a:
        return 1 - len(b) / longest
    most = len(b) // 16 if len(b) > LONG // 4 else len(b)
    while 4 * most < len(b):  # near texts need a band of the table only
        if (distance := band_distance(a, b, most)) is not None:
            return 1 - distance / longest
        most *= 2
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for c in b:
        eq = masks.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(d | up) & full, up & d
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~(x | rise) & full, rise & x
    return 1 - score / longest


STEP_WORDS, TABLE_WORDS, LONG = 8192, 1 << 20, 4096


def edit_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances of many pairs, over code points; pairs of like lengths are looked at together."""
    pairs = [without_ends(a, b) for a, b in pairs]
    out = np.array([len(b) for _, b in pairs], np.int64)
    order = sorted((i for i, (a, _) in enumerate(pairs) if a), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    while order:
        blocks = -(-len(pairs[order[-1]][1]) // 64)  # the longest come last and are taken first
        some = order[-max(1, STEP_WORDS // blocks) :]
        alone = max(0, len(some) - max(1, STEP_WORDS // blocks // 8))  # a few go along, however short
        some = [i for k, i in enumerate(some) if k >= alone or 4 * len(pairs[i][1]) >= 3 * 64 * (blocks - 1)]
        del order[-len(some) :]
        out[some] = block_distances([pairs[i] for i in some], blocks)
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points of some texts, the text and the place of each."""
    size = np.array([len(t) for t in texts])
    own = np.repeat(np.arange(len(texts)), size)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), own, np.arange(len(own)) - (np.cumsum(size) - size)[own]


def block_distances(pairs: list[tuple[str, str]], blocks: int) -> np.ndarray:
    """Levenshtein distances of (shorter, longer) pairs whose longer texts fit ``blocks`` times 64 code points, none empty.

    Myers' recurrence over the shorter text, in blocks of 64 places of the longer one (Hyyrö, 2003).
    In step t block w looks at place t - w, so what it needs of block w - 1 is of the step before
    and all blocks of all pairs move at once.
    """
    short, long = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    (points, own, at), (others, their, place) = (code_points(list(texts)) for texts in reversed(list(zip(*pairs, strict=True))))
    n, code = len(pairs), np.zeros(int(max(points.max(), others.max(initial=0))) + 1, np.int32)  # code 0: no letter of a longer text
    code[points] = 1
    letters = np.flatnonzero(code)
    width = len(letters) + 1
    if n > 1 and n * blocks * width > TABLE_WORDS:
        return np.concatenate([block_distances(half, blocks) for half in (pairs[: n // 2], pairs[n // 2 :])])
    code[letters] = np.arange(1, width)
    first = (np.arange(n * blocks) * width).reshape(blocks, n)
    masks, letter = np.zeros(blocks * n * width, np.uint64), np.zeros((64, blocks, n), np.int32)
    letter[at % 64, at // 64, own] = code[points]
    for bit in range(64):
        masks[first + letter[bit]] |= np.uint64(1 << bit)
    masks[first] = 0
    steps = int(short.max()) + blocks - 1
    texts = np.zeros((steps + blocks, n), np.int64)  # the last place first, so that a step reads one slice
    texts[steps - 1 - place, their] = code[others]
    up, down = np.full((blocks, n), ~np.uint64(0)), np.zeros((blocks, n), np.uint64)
    plus, minus, eq, x, d, rise = (np.zeros_like(down) for _ in range(6))
    plus[0], index = 1, np.empty_like(first)
    one, top, rows, last = np.uint64(1), np.uint64(63), np.arange(n), (long - 1) // 64
    rises, falls = np.zeros((steps, n), np.uint64), np.zeros((steps, n), np.uint64)
    for t in range(steps):
        np.add(first, texts[steps - 1 - t : steps - 1 - t + blocks], out=index)
        np.take(masks, index, out=eq, mode="clip")
        np.bitwise_or(eq, down, out=x)
        eq |= minus
        np.bitwise_and(eq, up, out=d)
        d += up
        d ^= up
        d |= eq
        np.bitwise_or(d, up, out=rise)
        np.invert(rise, out=rise)
        rise |= down
        fall = np.bitwise_and(up, d, out=d)
        rises[t], falls[t] = rise[last, rows], fall[last, rows]
        np.left_shift(rise, one, out=down)
        np.left_shift(fall, one, out=eq)
        down |= plus
        eq |= minus
        np.right_shift(rise[:-1], top, out=plus[1:])
        np.right_shift(fall[:-1], top, out=minus[1:])
        np.bitwise_or(x, down, out=up)
        np.invert(up, out=up)
        up |= eq
        down &= x
    bit, place = ((long - 1) % 64).astype(np.uint64), np.arange(steps)[:, None] - last
    move = (rises >> bit & one).astype(np.int64) - (falls >> bit & one).astype(np.int64)
    return long + np.where((place >= 0) & (place < short), move, 0).sum(axis=0)


def bag_distance(a: str, b: str) -> int:
    """A lower bound of the Levenshtein distance: an edit takes away or adds one code point at most."""
    x, y = Counter(a), Counter(b)
    return max((x - y).total(), (y - x).total())


def quick_bounds(a: str, b: str, similarity: float) -> tuple[float, float] | None:
    """Bounds of the Levenshtein distance that tell whether the similarity holds, where lengths or word-by-word replacement give them."""
    longest, x, y = max(len(a), len(b)), a.split(" "), b.split(" ")
    most = (1 - similarity) * longest
    if abs(len(a) - len(b)) > most + 1e-9:
        return abs(len(a) - len(b)), longest
    if len(x) == len(y) and (replaced := sum(max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q)) <= most:
        return 0, replaced
    return None


def edit_bounds(a: str, b: str, similarity: float, exact: bool = True) -> tuple[float, float]:
    """Bounds of the Levenshtein distance, equal unless they tell whether the similarity holds.

    Word-by-word replacement often proves it, and lengths often rule it out, without the recurrence.
    So do the texts' code points in any order, looked at where no ``exact`` distance is of use.
    """
    if quick := quick_bounds(a, b, similarity):
        return quick
    longest = max(len(a), len(b))
    if not exact and (bag := bag_distance(a, b)) > (1 - similarity) * longest + 1e-9:
        return bag, longest
    distance = round((1 - edit_similarity(a, b)) * longest)
    return distance, distance


def many_bounds(pairs: list[tuple[str, str]], similarity: float, exact: bool = True) -> list[tuple[float, float]]:
    """``edit_bounds`` of many pairs: texts of up to ``LONG`` code points are looked at together, and then always exactly."""
    short = [max(map(len, pair)) <= LONG for pair in pairs]
    out = [quick_bounds(a, b, similarity) if s else edit_bounds(a, b, similarity, exact) for (a, b), s in zip(pairs, short, strict=True)]
    left = [i for i, bounds in enumerate(out) if bounds is None]
    for i, distance in zip(left, edit_distances([pairs[i] for i in left]).tolist(), strict=True):
        out[i] = distance, distance
    return out


def alike(a: str, b: str, similarity: float) -> bool:
    """Is the edit similarity at least ``similarity``?"""
    return 1 - edit_bounds(a, b, similarity)[1] / max(1, len(a), len(b)) >= similarity


def lines_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_id, line_no, line_id, fp, chars, key0, key1, ...) for the lines with a word.

    Equal normalised lines share line_id (a 64-bit hash of their words in order). The keys
    are the line's blocks; they are null for lines that are only compared exactly, and for
    a line that stands further up in the same batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, texts, size = 0, [], 0
            for i, text in enumerate(b.column(2)):
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size > TEXT_CHARS or i + 1 == b.num_rows:
                    yield rows(b.slice(start, len(texts)), texts)
                    start, texts, size = i + 1, [], 0

    def rows(b: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        t = line_table(texts)
        new = np.zeros(len(t.ident), bool)
        new[np.unique(t.ident, return_index=True)[1]] = True
        new &= t.fuzzy
        keys = [pa.array(key, mask=~new) for key in t.keys.T]
        columns = [b.column(0).take(pa.array(t.text)), b.column(1).take(pa.array(t.text)), pa.array(t.number.astype(np.int32)), pa.array(t.ident.view(np.int64)), pa.array(t.prints.view(np.int64)), pa.array(t.chars.astype(np.int32)), *keys]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_id", "line_no", "line_id", "fp", "chars", *KEYS])

    return named(docs).mapInArrow(run, f"doc_id long, text_id long, line_no int, line_id long, fp long, chars int, {', '.join(f'{k} long' for k in KEYS)}")


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, text: ids may be null or repeated, with the hash of the text they tell rows apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))


def repeated_lines(docs: DataFrame, similarity: float = 0.8, distance: int = 20) -> DataFrame:
    """Rows (doc_id, text_id, line_no): the line occurrences that repeat an earlier one.

    Equal normalised lines are one class first. Classes that agree in a block and whose
    64-bit SimHashes differ in at most ``distance`` bits are candidates, confirmed by an
    edit similarity of ``similarity`` or more. Of each connected group the occurrence
    with the smallest (doc_id, line_no) stays, a null doc_id last. Lines of under five
    words and 20 code points are repeats only where they are equal.
    """
    hashes = ["line_id", "fp", *KEYS]
    lines = written(lines_of(docs), hashes)
    # Numbers only, so that rows are grouped by hash and not sorted: copies have equal columns, and any occurrence tells their text.
    classes = written(lines.groupBy("line_id").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc_id", "text_id", "line_no")), *(F.max(c).alias(c) for c in ("fp", "chars", *KEYS))), [*hashes, "text_id"])

    nodes = classes.where(F.col(KEYS[0]).isNotNull()).select(F.col("line_id").alias("id"), "fp", F.array(*KEYS).alias("keys"), F.col("chars").alias("width"))
    roots = near_groups(nodes, distance, 0, 0, 0, lambda ids: similar(docs, classes, ids, similarity), keyed=True, ratio=similarity, limit=lambda x, y: (1 - similarity) * F.greatest(x, y) + 1e-6)
    few = small_side(cut(roots.withColumnRenamed("node", "line_id")), F.lit(32), ROOT_BYTES)
    # A class without a root is nobody's root either: alone, unless it has copies.
    grouped = classes.select("line_id", "n").join(few, "line_id", "left").where("root is not null or n > 1").select("line_id", F.coalesce("root", "line_id").alias("group"))
    among = cut(lines.select("doc_id", "text_id", "line_no", "line_id").join(cut(grouped), "line_id").drop("line_id"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no", "text_id")
    first = small_side(cut(among.groupBy("group").agg(F.min(place).alias("first"))), F.lit(128), ROOT_BYTES)
    return among.join(first, "group").where(place != F.col("first")).select("doc_id", "text_id", "line_no")


def similar(docs: DataFrame, classes: DataFrame, ids: DataFrame, similarity: float) -> Callable[..., DataFrame]:
    """A function that bounds the edit distance of edges (a, b) between line classes and tells whether the texts are similar enough.

    Texts are fetched once, for the classes in ``ids`` only, from the document that ``classes`` names.
    """
    wanted = classes.join(small_side(cut(ids.withColumnRenamed("id", "line_id")), F.lit(32), ROOT_BYTES), "line_id").select("line_id", F.col("doc_id").alias("at_doc"), F.col("text_id").alias("at_text"), F.col("line_no").alias("at_line"))
    by_doc = cut(wanted.groupBy("at_doc", "at_text").agg(F.collect_list(F.struct("at_line", "line_id")).alias("wanted")))  # bounded by one document's lines

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, names = [], []
            wants = b.column(1).flatten()
            sizes, places, ids = b.column(1).value_lengths().to_pylist(), wants.field("at_line").to_pylist(), wants.field("line_id").to_pylist()
            at = 0
            for text, size in zip(b.column(0), sizes, strict=True):
                split = (text.as_py() or "").split("\n")
                for k in range(at, at + size):
                    if places[k] < len(split):
                        lines.append(split[places[k]])
                        names.append(ids[k])
                at += size
            for i in range(0, len(lines), 4096):
                own = [(n, normal_words(line)) for n, line in zip(names[i : i + 4096], lines[i : i + 4096], strict=True)]
                some = [(n, b" ".join(words).decode()) for n, words in own if words]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], pa.int64()), pa.array([t for _, t in some], pa.string())], names=["line_id", "line"])

    joined = named(docs).join(small_side(by_doc, 48 + 32 * F.size("wanted")), F.col("text_id").eqNullSafe(F.col("at_text")) & F.col("doc_id").eqNullSafe(F.col("at_doc"))).select("text", "wanted")
    texts = written(joined.mapInArrow(pick, "line_id long, line string").dropDuplicates(["line_id"]))

    @F.pandas_udf("lo double, hi double, near boolean")
    def measured(x: pd.Series, y: pd.Series, exact: pd.Series) -> pd.DataFrame:
        bounds = many_bounds(list(zip(x, y, strict=True)), similarity, bool(exact.all()))
        near = [1 - hi / max(1, len(p), len(q)) >= similarity for (_, hi), p, q in zip(bounds, x, y, strict=True)]
        return pd.DataFrame({"lo": [float(lo) for lo, _ in bounds], "hi": [float(hi) for _, hi in bounds], "near": near})

    x, y = texts.select(F.col("line_id").alias("a"), F.col("line").alias("x")), texts.select(F.col("line_id").alias("b"), F.col("line").alias("y"))
    return lambda edges, exact=True: cut(cut(edges).join(x, "a").join(y, "b").select("a", "b", measured("x", "y", F.lit(exact)).alias("m")).select("a", "b", "m.*"))


def dedup_lines(docs: DataFrame, lines: str = "__lines", removed: str = "__removed", **parameters) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, plus ``lines`` and ``removed`` (long).

    Lines without a word always stay. Null texts stay null, and a document whose lines
    are all removed keeps an empty text. Rows with the same doc_id and text share the
    decisions; ties go to the smaller (doc_id, line_no, hash of the text). All other
    columns, of any name and type, and all rows stay; an empty table gives an empty
    result. An input column named like one of the two added ones gives way to it.
    """
    again = repeated_lines(docs, **parameters)
    gone, doc, of = (free(docs.columns, c) for c in ("gone_lines", "gone_doc", "gone_text"))
    by_doc = cut(again.groupBy(F.col("doc_id").alias(doc), F.col("text_id").alias(of)).agg(F.collect_set("line_no").alias(gone)))  # bounded by one document's lines
    text = docs["text"].cast("string")
    joined = docs.join(small_side(by_doc, 48 + 4 * F.size(gone)), F.xxhash64(text).eqNullSafe(F.col(of)) & docs["doc_id"].cast("long").eqNullSafe(F.col(doc)), "left")
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(F.col(gone), i))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        *(F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns if c not in (lines, removed)),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias(lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed),
    )


def drop_repeated_lines(docs: DataFrame, length: str = "n_chars", **parameters) -> DataFrame:
    """``dedup_lines`` without its counts; documents of which no word stays go, and a column ``length`` follows the text."""
    lines, removed = free(docs.columns, "lines_before"), free(docs.columns, "lines_removed")
    out = dedup_lines(docs, lines, removed, **parameters)
    same = F.col(removed) == 0
    out = out.where(same | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if length in docs.columns:
        out = out.withColumn(length, F.when(same, F.col(length)).otherwise(F.length("text")).cast(docs.schema[length].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
