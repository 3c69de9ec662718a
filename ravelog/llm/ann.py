"""Nearest neighbours by a block matrix join with int8 product tiles."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK, STRIPE = 2048, 16384, 2048


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, so that products are exact), scales and error norms of unit rows."""
    scale = np.abs(v).max(axis=1) / 127
    codes = np.rint(v / scale[:, None])
    return codes.astype(np.float32), scale, np.linalg.norm(v - codes * scale[:, None], axis=1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosines in double precision, summed in component order so equal vectors tie exactly."""
    dot, aa, bb = np.zeros(len(b)), np.zeros(len(b)), np.zeros(len(b))
    for i in range(b.shape[1]):
        x, y = a[:, i], b[:, i]
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / np.sqrt(aa * bb)


def tile_search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest rows of one tile for each query: (query_id, vec_id, score).

    Codes give each cosine within |eq||c'| + |q'||ec| + |eq||ec|; a row whose upper
    bound is under the query's k-th best lower bound cannot be among the k nearest.
    The others are recomputed in double precision and go through a heap of size k.
    """
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1))[:, None]
    qc, qs, qe = quantise(unit(q))
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf)
    for at in range(0, len(c_ids), STRIPE):
        rows, ids = c[at : at + STRIPE], c_ids[at : at + STRIPE]
        cc, cs, ce = quantise(unit(rows))
        near = (qc @ cc.T).astype(np.float64) * qs[:, None] * cs[None, :]
        error = qe[:, None] * (1 + ce[None, :]) + (1 + qe[:, None]) * ce[None, :] + qe[:, None] * ce[None, :] + 1e-12
        mine = q_ids[:, None] == ids[None, :]
        near[mine] = -np.inf
        if near.shape[1] > k:
            lower = near - error
            floor = np.maximum(floor, np.partition(lower, near.shape[1] - k, axis=1)[:, near.shape[1] - k])
        left, right = np.nonzero((near + error >= floor[:, None]) & ~mine)
        for part in range(0, len(left), 1 << 18):
            i, j = left[part : part + (1 << 18)], right[part : part + (1 << 18)]
            for x, s, v in zip(i.tolist(), cosine(q[i], rows[j]).tolist(), ids[j].tolist(), strict=True):
                if len(heaps[x]) < k:
                    heapq.heappush(heaps[x], (s, -v))
                elif (s, -v) > heaps[x][0]:
                    heapq.heapreplace(heaps[x], (s, -v))
    return [(int(q_ids[x]), -v, s) for x, heap in enumerate(heaps) for s, v in heap]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components that is not zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine for each query, exact.

    ``queries`` and ``vectors`` have vec_id and embedding. Both are cut into blocks
    by a hash of the id; each pair of blocks is one tile of bounded size, and a tile
    gives at most k rows a query. A query's own vec_id is no candidate; ties go to
    the smaller vec_id. Vectors of another length than the query's, null vectors,
    zero vectors and those with a null or non-finite component take no part.
    """
    rows, asked = usable(vectors), usable(queries)
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_rows, n_asked = blocks(vectors, row_block), blocks(asked, query_block)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = asked.select("vec_id", "v", F.size("v").alias("dim"), block(n_asked).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("rb"))
    right = rows.select("vec_id", "v", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("qb"), block(n_rows).alias("rb"))

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        wide = lambda s: np.array(s.tolist(), dtype=np.float64)
        found = tile_search(q["vec_id"].to_numpy(), wide(q["v"]), c["vec_id"].to_numpy(), wide(c["v"]), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    on = ["qb", "rb", "dim"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(tile, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
