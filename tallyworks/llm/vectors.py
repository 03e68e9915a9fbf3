"""Vectors as operators see them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row by a power of two near its largest component: no digit changes, and no square of a finite row is infinite or lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever the size of their components."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; where squares leave the range of doubles, of the scaled differences."""
    with np.errstate(over="ignore", under="ignore"):
        d = x - q
        s = (d * d).sum(1)
        odd = ~np.isfinite(s) | (s < 1e-250)
        out = np.sqrt(s)
        if odd.any():
            top = np.abs(d[odd]).max(1)
            whole = np.where((top > 0) & np.isfinite(top), top, 1.0)
            out[odd] = np.where(np.isfinite(top), whole * np.sqrt(((d[odd] / whole[:, None]) ** 2).sum(1)), np.inf)
    return out


def dimension(vectors: DataFrame, column: str) -> int:
    """The commonest length (of equals the smallest); vectors of other lengths can't be compared with these."""
    row = vectors.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return row["d"] if row else 0


def sample(vectors: DataFrame, column: str, rows: int) -> np.ndarray:
    """At most rows vectors, those of the smallest hash, in a fixed order."""
    got = vectors.select(column, F.xxhash64(column, F.lit(11)).alias("h")).orderBy("h").limit(rows).collect()
    return np.array([r[column] for r in got], np.float64)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centres of Lloyd's algorithm from k rows drawn by seed; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)
