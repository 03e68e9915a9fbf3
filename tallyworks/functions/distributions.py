"""Distribution functions: tails as Column expressions, quantiles in numpy.

Tails come from the incomplete beta and gamma functions of Apache Commons Math, which Spark ships. Upper tails are
taken directly, so they stay exact when tiny. Quantiles are bisected on numpy versions (a result has few rows).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_BETA = "org.apache.commons.math3.special.Beta"
_GAMMA = "org.apache.commons.math3.special.Gamma"
_ERF = "org.apache.commons.math3.special.Erf"


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _call(cls: str, f: str, *args) -> Column:
    return F.reflect(F.lit(cls), F.lit(f), *[_d(a) for a in args]).cast("double")


def beta_cdf(x, a, b) -> Column:
    """Regularised incomplete beta."""
    return _call(_BETA, "regularizedBeta", x, a, b)


def normal_upper(z) -> Column:
    return _call(_ERF, "erfc", _d(z) / math.sqrt(2)) / 2


def normal_two_sided(z) -> Column:
    return _call(_ERF, "erfc", F.abs(_d(z)) / math.sqrt(2))


def t_two_sided(t, df) -> Column:
    t, df = _d(t), _d(df)
    return beta_cdf(df / (df + t * t), df / 2, F.lit(0.5))


def f_upper(f, d1, d2) -> Column:
    f, d1, d2 = _d(f), _d(d1), _d(d2)
    return F.when(f <= 0, 1.0).otherwise(beta_cdf(d2 / (d2 + d1 * F.greatest(f, F.lit(1e-300))), d2 / 2, d1 / 2))


def chi2_upper(x, df) -> Column:
    return F.when(_d(x) <= 0, 1.0).otherwise(_call(_GAMMA, "regularizedGammaQ", _d(df) / 2, F.greatest(_d(x), F.lit(1e-300)) / 2))


def binomial_lower(k, n, p) -> Column:
    """P(X <= k)."""
    k, n = _d(k), _d(n)
    return F.when(k >= n, 1.0).otherwise(beta_cdf(1 - _d(p), F.greatest(n - k, F.lit(1e-9)), k + 1))


def quantile(tail: Callable[[Column], Column], level, low, high, steps: int = 60) -> Column:
    """The least x between low and high from which on tail(x) is at most level, by bisection within the row."""
    half = lambda a: (a["lo"] + a["hi"]) / 2
    step = lambda a, _: F.when(tail(half(a)) <= _d(level), F.struct(a["lo"].alias("lo"), half(a).alias("hi"))).otherwise(F.struct(half(a).alias("lo"), a["hi"].alias("hi")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(_d(low).alias("lo"), _d(high).alias("hi")), step, half)


# numpy side

def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _bisect(f: Callable[[float], float], p: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if f(mid) < p else (low, mid)
    return (low + high) / 2


def norm_ppf(p: float) -> float:
    if not 0 < p < 1:
        return -math.inf if p <= 0 else math.inf
    return -norm_ppf(1 - p) if p > 0.5 else _bisect(norm_cdf, p, -40.0, 0.0)


def beta_inc(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300) if abs(1 - (a + b) * x / (a + 1)) > 1e-300 else 1e300
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


#: From here on the incomplete beta is read off a table, as its fraction takes more steps the larger its parameters are.
LARGE = 1000


@lru_cache(4)
def _beta_table(a: float, b: float, panels: int = 8192) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Start, step, values and slopes (by step) of the incomplete beta over ten deviations to either side, integrated in panels."""
    top, sd = (a - 1) / (a + b - 2), math.sqrt(a * b / (a + b + 1)) / (a + b)
    low, high = max(0.0, top - 10 * sd), min(1.0, top + 10 * sd)
    step = (high - low) / panels
    density = lambda u: np.exp((a - 1) * np.log1p((u - top) / top) + (b - 1) * np.log1p((top - u) / (1 - top)))
    node, weight = np.polynomial.legendre.leggauss(6)
    within = density(low + step * (np.arange(panels)[:, None] + (node + 1) / 2)) @ (weight / 2)
    with np.errstate(divide="ignore"):
        slope = density(low + step * np.arange(panels + 1))
    return low, step, np.concatenate([[0.0], np.cumsum(within)]) / within.sum(), slope / within.sum()


def _beta_read(x: np.ndarray, a: float, b: float) -> np.ndarray:
    low, step, value, slope = _beta_table(a, b)
    at = np.clip((x - low) / step, 0, len(value) - 1)
    i = np.minimum(at.astype(np.int64), len(value) - 2)
    t, v, w = at - i, value[i], value[i + 1]
    rise, s, e = w - v, slope[i], slope[i + 1]
    return np.clip(v + t * (s + t * (3 * rise - 2 * s - e + t * (s + e - 2 * rise))), 0, 1)


def beta_inc_many(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """beta_inc of many x for one a and b."""
    x = np.asarray(x, float)
    if min(a, b) >= LARGE:
        return _beta_read(x, float(a), float(b))
    turn = x > (a + 1) / (a + b + 2)
    z = np.clip(np.where(turn, 1 - x, x), 1e-300, 1.0)
    p, q = np.where(turn, b, a).astype(float), np.where(turn, a, b).astype(float)
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(z) + q * np.log1p(-z)) / p
    c, start = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(start) < 1e-300, 1e-300, start)
    h = d.copy()
    for m in range(1, 1000):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(d == 0, 1e-300, d)
            c = 1 + num / c
            c = np.where(c == 0, 1e-300, c)
            h = h * c * d
        if np.abs(c * d - 1).max(initial=0) < 1e-14:
            break
    out = np.where(turn, 1 - front * h, front * h)
    return np.clip(np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out)), 0, 1)


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def t_cdf(t: float, df: float) -> float:
    tail = beta_inc(df / (df + t * t), df / 2, 0.5) / 2
    return 1 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    return -t_ppf(1 - p, df) if p > 0.5 else _bisect(lambda t: t_cdf(t, df), p, -1e6, 0.0)


def chi2_ppf(p: float, df: float) -> float:
    return 2 * gamma_ppf(p, df / 2)


def gamma_ppf(p: float, a: float) -> float:
    return _bisect(lambda x: gamma_inc(a, x), p, 0.0, a + 60 * math.sqrt(a) + 200) if p > 0 and a > 0 else 0.0


def beta_ppf(p: float, a: float, b: float) -> float:
    return _bisect(lambda x: beta_inc(x, a, b), p, 0.0, 1.0)


def studentized_range_cdf(q: float, k: int, df: float) -> float:
    """Of the range of k means over an independent deviation with df: a double Gauss-Legendre integral."""
    x, w = np.polynomial.legendre.leggauss(96)
    cdf = np.vectorize(norm_cdf)
    z = 8 * x

    def inner(r: float) -> float:
        return float(k * (8 * w * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * np.maximum(cdf(z) - cdf(z - r), 0) ** (k - 1)).sum())

    sd = 1 / math.sqrt(2 * df)
    lo, hi = max(1e-9, 1 - 9 * sd), 1 + 9 * sd
    s = (lo + hi) / 2 + (hi - lo) / 2 * x
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(((hi - lo) / 2 * w * np.exp(log_density) * np.array([inner(q * v) for v in s])).sum())


def studentized_range_ppf(p: float, k: int, df: float) -> float:
    low, high = 0.0, 100.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if studentized_range_cdf(mid, k, df) < p else (low, mid)
    return (low + high) / 2
