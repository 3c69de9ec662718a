"""SimHash near-duplicate groups of documents, with pivot distance tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, small_side, written
from .hamming import key_blocks, near_groups

CHUNK = 1 << 15
# MinHash: values a band, bands, and one odd multiplier for each value. A pair of
# similarity s shares no band with chance (1 - s**BAND) ** BANDS: 3e-6 at 0.8.
BAND, BANDS = 5, 32
# Differing bits of the SimHashes of two shingle sets. At a similarity of 0.8 a bit differs with chance 0.15 (0.19 at most,
# for four of five shingles), so a pair lies further apart with chance 1e-8 (1e-6); of unrelated pairs 81 % do.
SET_DISTANCE = 28
FACTORS = np.random.default_rng(42).integers(1 << 63, size=BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 for a text without words.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a shorter
    text is one shingle. A bit is set if it is set in over half the XXH64 (seed 42)
    values, repeats included. Long texts are folded in chunks of bounded size.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, at = b" ".join(words), [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    n = max(1, len(words) - shingle + 1)
    view, hashed, ones = memoryview(joined), xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for start in range(0, n, CHUNK):
        h = [hashed(view[at[i] : at[min(i + shingle, len(words))] - 1], 42) for i in range(start, min(n, start + CHUNK))]
        ones += np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_id (XXH64 of the text) and fp (signed 64-bit) of each row of ``docs``; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], names=["doc_id", "text_id", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_id")).mapInArrow(run, "doc_id long, text_id long, fp long")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int | None = None, n_pivots: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id.

    Documents are linked when their fingerprints differ in at most ``distance``
    bits; component_id is the smallest doc_id that links reach. Equal fingerprints
    are one node, so copies are never expanded into pairs. Candidates share
    ``blocks - distance`` fingerprint blocks (their number follows the number of
    fingerprints, if not given, and decides nothing); pairs whose distances to any
    reference fingerprint differ by more than ``distance`` are discarded before
    the exact count of differing bits.

    Null or empty texts have fingerprint 0 and are linked like any other. A null
    doc_id stays null and belongs to a group without naming it. Repeated rows give
    repeated rows. Other columns are ignored. An empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, shingle))
    nodes, roots = grouped(marked, distance, blocks, n_pivots)
    linked = cut(nodes.join(roots, "fp"))
    least = small_side(cut(linked.groupBy("root").agg(F.min("least").alias("component_id"))), F.lit(24))
    of = linked.join(least, "root").select("fp", "component_id")
    alone = nodes.join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return marked.join(of.union(alone), "fp").select("doc_id", "fp", "component_id")


def grouped(marked: DataFrame, distance: int, blocks: int | None, n_pivots: int) -> tuple[DataFrame, DataFrame]:
    """Rows (fp, least) for the distinct fingerprints of ``marked`` with their smallest doc_id, and (fp, root) for the linked ones."""
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    blocks = blocks or key_blocks(nodes.count(), distance)
    roots = near_groups(nodes.select(F.col("fp").alias("id"), "fp"), distance, blocks, blocks - distance, n_pivots)
    return nodes, cut(roots.withColumnRenamed("node", "fp"))


def drop_near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int | None = None, n_pivots: int = 8) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the first by doc_id, then by a hash of the text.

    All columns, of any name and type, stay as they are. A null doc_id comes last, so it
    is kept only where its whole group has none. Groups are chosen from apart, so a doc_id
    repeated with texts of two groups keeps a row in each.
    """
    marked = cut(fingerprints(docs, shingle))
    _, roots = grouped(marked, distance, blocks, n_pivots)
    root = marked.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return first_of_groups(docs, root)


def first_of_groups(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``members`` (doc_id, text_id, root)."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id")
    doc, of, row = (free(docs.columns, c) for c in ("kept_doc", "kept_text", "kept_row"))
    first = members.groupBy("root").agg(F.min(place).alias("at"))
    keep = cut(first.select(F.col("at.doc_id").alias(doc), F.col("at.text_id").alias(of)).distinct())
    text_id = F.xxhash64(docs["text"].cast("string"))
    kept = docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep[doc]) & (text_id == keep[of]))
    # Copies of the kept row are reduced before they are dealt; JSON orders rows of any type.
    whole = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns))
    return kept.groupBy(doc, of).agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(*(F.col(row)[c].alias(c) for c in docs.columns))


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of a text's word shingles (words as in ``fingerprint``); none for a text without words."""
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)], dtype=np.uint64))


def set_fingerprint(own: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of a set of shingle hashes, each counted once: a bit is set if over half of them set it."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(own), CHUNK):
        ones += np.unpackbits(own[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(own), bitorder="little").view("<u8")[0])


def band_keys(own: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band of MinHash values of a shingle set; a set without shingles has keys of its own."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(own), 2048):
        least = np.minimum(least, (own[None, at : at + 2048] * FACTORS[:, None]).min(axis=1))
    rows = least.reshape(BANDS, BAND)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], dtype=np.uint64).view(np.int64)


def set_similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two packed sorted sets; two empty sets are equal."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = SET_DISTANCE, n_pivots: int = 8) -> DataFrame:
    """``docs`` with one row of each group linked by a shingle similarity (Jaccard) of ``similarity`` or more.

    Equal shingle sets are one node first, with the SimHash of its distinct shingles. Nodes
    that share a block are candidates; the blocks are MinHash bands, since a SimHash distance
    wide enough for 0.8 leaves no blocks of its bits that tell texts apart. Candidates
    whose distances to any reference fingerprint differ by more than ``distance`` are
    discarded, then those with more differing bits, and what is left is compared exactly.
    ``distance`` and the bands suit a ``similarity`` of 0.8 or more. Texts without words are one group. The survivor is chosen as in
    ``drop_near_duplicates``.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, prints, sizes, keys = np.empty(b.num_rows, np.uint64), np.empty(b.num_rows, np.uint64), np.empty(b.num_rows, np.int32), []
            for i, t in enumerate(b.column(2)):
                own = shingles(t.as_py(), shingle)
                ids[i], prints[i], sizes[i] = xxhash.xxh64_intdigest(own.tobytes()), set_fingerprint(own), len(own)
                keys.append(band_keys(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(sizes), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_id", "id", "fp", "n", "keys"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingles(t.as_py(), shingle).tobytes() for t in some.column(1)], pa.binary())], names=["id", "own"])

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))
    marked = texts.mapInArrow(run, "doc_id long, text_id long, id long, fp long, n int, keys array<long>")
    nodes = written(marked.groupBy("id").agg(F.min(place).alias("at"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")))

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([set_similarity(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    def confirmed(ids: DataFrame) -> Callable[..., DataFrame]:
        wanted = cut(nodes.join(ids, "id").select("id", F.col("at.doc_id").alias("at_doc"), F.col("at.text_id").alias("at_text")))
        found = texts.join(small_side(wanted), (F.col("text_id") == F.col("at_text")) & F.col("doc_id").eqNullSafe(F.col("at_doc")))
        sets = written(found.select("id", "text").mapInArrow(pack, "id long, own binary").dropDuplicates(["id"]))
        x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
        return lambda edges, exact=True: cut(cut(edges).join(x, "a").join(y, "b").select("a", "b", alike("x", "y").alias("s")).select("a", "b", (1 - F.col("s")).alias("lo"), (1 - F.col("s")).alias("hi"), (F.col("s") >= similarity).alias("near")))

    wide = nodes.select("id", "fp", "keys", F.col("n").alias("width"))
    roots = near_groups(wide, distance, 0, 0, n_pivots, confirmed, keyed=True, ratio=similarity, limit=lambda x, y: F.lit(1 - similarity + 1e-9))
    of = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return first_of_groups(docs, of.select("at.doc_id", "at.text_id", "root"))
