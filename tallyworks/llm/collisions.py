"""Nearest neighbours by collision counting over single random projections, with query-centred windows.

Each block of vectors keeps its projections as sorted arrays. A query opens a window around its own
projection in each array and widens it step by step (virtual rehashing: no array is built again). A vector
that lies in the window of at least `share` of the projections is verified by its exact Euclidean distance. The search of a block ends when
the k-th verified distance is so small against the windows that a nearer vector would have reached
that share, but for `doubt` standard deviations. Queries, the smaller side, are sent to every block; of each block, k results a query go on. Projections far
outside a block's own range are put at its ends, so that one huge vector does not spoil the arrays of the others.

Vectors that are null, zero, hold null or non-finite components, or have another length than most take no part, nor
does a null vec_id. A query's own row is never its neighbour; every other row is, whether it repeats it or shares its
vec_id, and each row that asks is answered. Ties go to the smaller vec_id. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import dimension, distances, matrix, usable

HITS = "query long, query_id long, vec_id long, score double"


def _inside(width: float, distance: float) -> float:
    """Chance that two vectors so far apart fall within width on one projection."""
    return math.erf(width / (distance * math.sqrt(2))) if distance > 0 else 1.0


class Block:
    """Projections of a block's vectors as one flat array, sorted within each projection, projections side by side."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, projections: int, seed: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.x = ids[order], rows[order], x[order]
        self.a = np.random.default_rng(seed).standard_normal((x.shape[1], projections))
        p = self.projected(self.x).T
        # what lies a thousand quartile ranges out is put at that place: it enters windows no later than it should, and it
        # can't take the others' places from the arrays
        low, mid, high = np.quantile(p, [0.25, 0.5, 0.75], axis=1, keepdims=True)
        far = 1000 * np.maximum(high - low, 1e-300)
        self.least, self.most = (mid - far).ravel(), (mid + far).ravel()
        p = np.ascontiguousarray(np.clip(p, mid - far, mid + far))
        self.order = np.argsort(p, axis=1, kind="stable")
        self.low = float(p.min())
        self.span = 4 * (float(p.max()) - self.low) + 1
        self.flat = (np.take_along_axis(p, self.order, 1) - self.low + np.arange(projections)[:, None] * self.span).ravel()
        self.order = self.order.ravel()

    def projected(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num(x @ self.a, nan=0.0, posinf=1e300, neginf=-1e300)

    def search(self, query: int, q: np.ndarray, k: int, share: float, doubt: float, step: float) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(self.ids), self.a.shape[1]
        need = math.ceil(share * m)
        first = np.arange(m) * n
        at = np.clip(self.projected(q), self.least, self.most) - self.low + np.arange(m) * self.span
        lo = np.clip(np.searchsorted(self.flat, at), first, first + n)
        hi = lo.copy()
        count = np.zeros(n, np.int64)
        done = self.rows == query
        want = min(k, int((~done).sum()))
        found, far = np.empty(0, np.int64), np.empty(0)
        # to begin with, windows of a sixteenth of the vectors: far fewer than share of them hold any but near ones
        reach = max(1, n // 32)
        left, right = np.clip(lo - reach, first, first + n - 1), np.clip(lo + reach, first, first + n - 1)
        width = max(1e-9, float(np.median(self.flat[right] - self.flat[left])) / 2)
        while want:
            a = np.minimum(lo, np.clip(np.searchsorted(self.flat, at - width), first, first + n))
            b = np.maximum(hi, np.clip(np.searchsorted(self.flat, at + width, "right"), first, first + n))
            new = [self.order[i:j] for i, j in zip(np.r_[a, hi].tolist(), np.r_[lo, b].tolist(), strict=True) if i < j]
            lo, hi = a, b
            if new:
                count += np.bincount(np.concatenate(new), minlength=n)
            fresh = np.flatnonzero((count >= need) & ~done)
            if len(fresh):
                done[fresh] = True
                found, far = np.r_[found, fresh], np.r_[far, distances(self.x[fresh], q)]
            if len(found) >= want:
                p = _inside(width, float(np.partition(far, want - 1)[want - 1]))
                if p * m - doubt * math.sqrt(p * (1 - p) * m) >= need or done.all():
                    break
            width *= step
        best = np.lexsort((self.ids[found], far))[:k]
        return self.ids[found[best]], far[best]


def search(vectors: DataFrame, is_query: Column, k: int = 10, projections: int = 128, share: float = 0.5, doubt: float = 2.0, step: float = 1.15, block: int = 16384, queries: int = 16384, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for each row of vectors (vec_id, embedding) that is_query."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    size = dimension(rows, "embedding")
    rows = cut(rows.filter(F.size("embedding") == size).withColumn("row", F.monotonically_increasing_id()))  # fixed by the write
    asked = rows.filter(is_query)
    n_asked = asked.count()
    blocks = max(1, -(-rows.count() // block))
    # a block is indexed once for every so many queries; only with few blocks the queries are split further, so that all cores have work
    groups = max(1, -(-n_asked // queries), min(-(-n_asked // 64), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // blocks)))
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = rows.withColumn("i", deal(blocks, 1)).withColumn("j", every(groups))
    asking = asked.select(*[F.col(c).alias(c) for c in rows.columns]).withColumn("j", deal(groups, 2)).withColumn("i", every(blocks))

    def run(key: tuple, s: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(s) and len(q):
            b = Block(s["vec_id"].to_numpy(), s["row"].to_numpy(), matrix(s["embedding"]), projections, seed)
            for i, own, v in zip(q["row"].tolist(), q["vec_id"].tolist(), matrix(q["embedding"]), strict=True):
                ids, far = b.search(i, v, k, share, doubt, step)
                out += [(i, own, x, d) for x, d in zip(ids.tolist(), far.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"]).astype({"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})

    hits = stored.groupBy("i", "j").cogroup(asking.groupBy("i", "j")).applyInPandas(run, HITS)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
