"""Shapiro-Wilk by group, on a bounded sample of each group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as P
from ..functions.scalars import hash_uniform


def royston_p(w: float, n: int) -> float:
    """The upper tail of the transformed statistic; fixed values are those of the published approximation."""
    if n == 3:
        return max(0.0, 6 / np.pi * (np.arcsin(np.sqrt(w)) - np.arcsin(np.sqrt(0.75))))
    if w >= 1:
        return 1.0
    if n <= 11:
        y = -np.log(-2.273 + 0.459 * n - np.log(1 - w))
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), np.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, u = np.log(1 - w), np.log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], u), np.exp(np.polyval([0.0030302, -0.082676, -0.4803], u))
    return float(P.norm_cdf(-(y - mean) / sd))


def statistic(x: np.ndarray) -> float:
    """w of sorted values, three or more and not all equal, with Royston's weights."""
    n = len(x)
    m = np.array([P.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u = 1 / np.sqrt(n)
    mm = float(m @ m)
    cc = m / np.sqrt(mm)
    a = np.empty(n)
    last = cc[-1] + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    if n <= 5:
        a[1:-1] = m[1:-1] / np.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    else:
        second = cc[-2] + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
        a[2:-2] = m[2:-2] / np.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a[-2], a[1] = second, -second
    a[-1], a[0] = last, -last
    return float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())


def shapiro_wilk(df: DataFrame, x: str, g: str, unit: str, most: int = 5000) -> DataFrame:
    """g, n, w, p, verdict: by group, on at most so many rows of the smallest hash of unit; the approximation holds up to 5,000."""
    p = df.filter(F.col(x).isNotNull()).select(F.col(g).alias("grp"), F.col(x).cast("double").alias("x"), F.col(unit).alias("id"), hash_uniform("sw", unit).alias("u"))
    n = p.groupBy(F.col("grp").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    # a little more than most by threshold, then the first of those: no group is ordered whole
    few = p.join(F.broadcast(n), F.col("grp") == F.col("g")).filter(F.col("u") * F.col("n") <= most + 10 * F.sqrt(F.lit(float(most))))
    capped = few.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("u", "id"))).filter(F.col("k") <= most).select("grp", "x")

    def tested(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(rows["x"].to_numpy())
        k = len(v)
        if k < 3 or v[0] == v[-1]:
            return pd.DataFrame({g: [key[0]], "n": [k], "w": [None], "p": [None], "verdict": ["too few" if k < 3 else "no variation"]})
        w = statistic(v)
        p = royston_p(min(w, 1.0), k)
        return pd.DataFrame({g: [key[0]], "n": [k], "w": [w], "p": [p], "verdict": ["not normal" if p < 0.05 else "normal"]})

    return capped.groupBy("grp").applyInPandas(tested, f"{g} string, n long, w double, p double, verdict string")
