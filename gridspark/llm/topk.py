"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are dealt into blocks; a block pair is one task's work.  Inside a block every
dimension is a sorted list.  The lists are read in step from the end that the sign of the
query's component favours.  What has been read gives each vector a lower and an upper bound of
its score; a vector whose upper bound is below the k-th best lower bound (or score found
before) cannot qualify.  Reading stops when few vectors can; their scores are then resolved.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors and queries of one block pair.
BLOCK, QUERY_BLOCK = 8192, 2048
#: Vectors whose lists are read together, and queries that are bounded together.
LIST, TOGETHER = 2048, 256
#: Parts of the lists after which bounds are compared.
DEPTHS = (0.5, 0.65, 1.0)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null for vectors that hold a null or non-finite one."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact_type(q: np.ndarray, x: np.ndarray):
    """A number type in which every partial sum of products is exact."""
    largest = max(map(abs, (int(q.min()), int(q.max())))) * max(map(abs, (int(x.min()), int(x.max())))) * q.shape[1]
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object


def nra(q: np.ndarray, qids: np.ndarray, x: np.ndarray, xids: np.ndarray, k: int):
    """(query row, vector id, score) of the k best of each query; ties go to the smaller id.

    Where scores need more than 53 bits, bounds would be rounded, so none is used.
    """
    if not q.size or not x.size:  # vectors without components: every score is zero
        pairs = [(i, v) for i in range(len(q)) for v in sorted(v for v in xids if v != qids[i])[:k]]
        return (np.array([p[i] for p in pairs], np.int64) for i in (0, 1)), np.zeros(len(pairs), np.int64)
    kind = _exact_type(q, x)
    q, x = q.astype(kind), x.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)]  # query row, id, score
    threshold = np.full(len(q), -math.inf)
    for at in range(0, len(x), LIST):
        xs, ids = x[at : at + LIST], xids[at : at + LIST]
        lists = np.sort(xs, axis=0)
        found = [best]
        for lo in range(0, len(q), TOGETHER):
            hi = min(lo + TOGETHER, len(q))
            rows = np.arange(len(xs))
            alive = qids[lo:hi, None] != ids[None, :]
            limit = threshold[lo:hi].copy()
            for part in DEPTHS:
                read = max(1, int(len(xs) * part))
                top, bottom = lists[len(xs) - read], lists[read - 1]  # the last values read
                some = xs[rows]
                upper = up[lo:hi] @ np.maximum(some, top).T + down[lo:hi] @ np.minimum(some, bottom).T
                lower = (
                    up[lo:hi] @ np.where(some >= top, some, lists[0]).T
                    + down[lo:hi] @ np.where(some <= bottom, some, lists[-1]).T
                ).astype(float)
                lower[~alive] = -math.inf
                if lower.shape[1] >= k and kind is not object:
                    limit = np.maximum(limit, np.partition(lower, -k, axis=1)[:, -k])
                alive &= upper >= limit[:, None]
                left = alive.any(axis=0)
                rows, alive = rows[left], alive[:, left]
                if not len(rows) or alive.sum() <= 8 * k * (hi - lo):
                    break
            i, j = np.nonzero(alive)
            score = (q[lo + i] * xs[rows[j]]).sum(axis=1)
            found.append([lo + i, ids[rows[j]], score])
        i, v, s = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((v, -(np.unique(s, return_inverse=True)[1] if kind is object else s), i))
        i, v, s = i[order], v[order], s[order]
        first = np.searchsorted(i, i)
        kept = np.arange(len(i)) - first < k
        best = [i[kept], v[kept], s[kept]]
        full = (np.bincount(best[0], minlength=len(q)) == k) & (kind is not object)
        threshold[full] = best[2][np.searchsorted(best[0], np.flatnonzero(full)) + k - 1].astype(float)
    return best[:2], best[2]


def _block_pair(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["v"].map(len).max())
        asks = pdf["ask"].to_numpy()
        q, x = _matrix(pdf["v"][asks].tolist(), width), _matrix(pdf["v"][~asks].tolist(), width)
        qids, xids = pdf["id"][asks].to_numpy(), pdf["id"][~asks].to_numpy()
        (row, ids), score = nra(q, qids, x, xids, k)
        score = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score], np.int64)
        return pd.DataFrame({"query_id": qids[row], "vec_id": ids, "score": score})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each row that ``is_query``.

    ``vectors`` holds arrays of longs.  Rows with a null id or vector take no part; rows that
    repeat an id count once (the largest vector).  A shorter vector is filled up with zeros.
    Ties go to the smaller id.  With fewer candidates than ``k`` all are returned.  Scores
    beyond the range of a long are clipped to it.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("ask"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.groupBy("id").agg(F.max(F.struct("v", "ask")).alias("r")).select("id", "r.v", "r.ask")
    n, asked = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, query_blocks = -(-n // BLOCK) or 1, -(-asked // QUERY_BLOCK) or 1
    spread = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    data = rows.select(spread(blocks).alias("b"), every(query_blocks).alias("q"), F.lit(False).alias("ask"), "id", "v")
    asks = rows.filter("ask").select(every(blocks).alias("b"), spread(query_blocks).alias("q"), "ask", "id", "v")
    found = data.unionByName(asks).groupBy("b", "q").applyInPandas(_block_pair(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
