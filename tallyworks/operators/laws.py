"""Laws of order statistics under resampling and shuffling, without draws.

A resample of n rows has its k-th value at most x when at least k of its rows are; that number is binomial with the share F(x) of
rows up to x. Its k-th row lies at F of the k-th of n uniform numbers, so two order statistics of one resample have the joint law of two uniform ones,
a beta and a beta of the rest. A shuffle of two groups places the k-th row of one by the hypergeometric law, and then the middle row
of the other among the places that are left.

Only values whose place is within some standard deviations of the wanted one have any chance. Spark finds
the places (prefix sums over distinct values) and keeps these: for n rows fewer than 20 sqrt(n) values, which is what reaches the
driver, and all that the rest of the work grows with. Quantiles are order statistics: the first value that reaches p of the rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as P
from .order import prefix_sums

#: Standard deviations beyond which a place has no chance worth counting.
FAR = 9.0


class Places:
    """The distinct values near some places of n ordered rows: v, rows before each, rows of each."""

    def __init__(self, v, before, rows, n: int) -> None:
        self.v, self.before, self.rows, self.n = np.asarray(v, float), np.asarray(before, np.int64), np.asarray(rows, np.int64), n

    def near(self, p: float) -> Places:
        """Those near the place of the quantile p alone."""
        w = reach(p, self.n)
        at = ((self.before + self.rows) / self.n >= p - w) & (self.before / self.n <= p + w)
        return Places(self.v[at], self.before[at], self.rows[at], self.n)

    def at(self, place: int) -> float:
        """The value of the row at place, from 1."""
        return float(self.v[np.searchsorted(self.before + self.rows, place)])


def reach(p, n):
    return FAR * (p * (1 - p) / n) ** 0.5 + 3 / n


def places_near(df: DataFrame, value: str, ps: list[float]) -> Places:
    """Places of df's values around the quantiles ps."""
    s = prefix_sums(df, [], value, {"n": F.lit(1)})
    share = lambda x: F.col(x) / F.col("n_all")
    keep = F.lit(False)
    for p in ps:
        w = FAR * F.sqrt(F.lit(p * (1 - p)) / F.col("n_all")) + 3 / F.col("n_all")
        keep = keep | ((share("n_before") + share("n") >= p - w) & (share("n_before") <= p + w))
    rows = s.filter(keep).select(value, "n_before", "n", "n_all").orderBy(value).collect()
    return Places([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], rows[0][3] if rows else 0)


def place_of(p: float, n: int) -> int:
    """The first row, from 1, that reaches p of n."""
    return max(1, math.ceil(p * n - 1e-9))


def quantile_law(x: Places, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Values of a resample's quantile and their chances."""
    k = place_of(p, x.n)
    upto = P.beta_inc_many((x.before + x.rows) / x.n, k, x.n - k + 1)
    return x.v, np.diff(upto, prepend=0.0 if x.before[0] == 0 else P.beta_inc_many(x.before[:1] / x.n, k, x.n - k + 1)[0])


def first_at(v: np.ndarray, chances: np.ndarray, q: float) -> float:
    return float(v[min(np.searchsorted(np.cumsum(chances), q - 1e-12), len(v) - 1)])


def jackknifed(x: Places, ps: list[float], signs: list[int]) -> float:
    """Acceleration of a signed sum of quantiles: without one row each is one of two neighbours, by the row's place."""
    n = x.n - 1
    ks = [place_of(p, n) for p in ps]
    cuts = [0, *sorted(set(ks)), x.n]
    values, weights = [], []
    for lo, hi in zip(cuts, cuts[1:], strict=False):  # rows lo + 1 .. hi are left out in turn
        if hi > lo:
            values.append(sum(s * x.at(k + 1 if hi <= k else k) for k, s in zip(ks, signs, strict=True)))
            weights.append(hi - lo)
    v, w = np.array(values), np.array(weights, float)
    return acceleration(v, w)


def acceleration(v: np.ndarray, w: np.ndarray) -> float:
    d = (v * w).sum() / w.sum() - v
    squares = (w * d * d).sum()
    return float((w * d**3).sum() / (6 * squares**1.5)) if squares > 0 else 0.0


def intervals(seen: float, mean: float, se: float, below: float, at, acceleration: float, level: float = 0.95) -> dict[str, float | None]:
    """Percentile, basic and bias-corrected accelerated limits of a law: at(q) is its quantile, below the chance of less than seen."""
    tail = (1 - level) / 2
    low, high = at(tail), at(1 - tail)
    out = {"observed": seen, "bias": mean - seen, "se": se, "low": low, "high": high, "basic_low": 2 * seen - high, "basic_high": 2 * seen - low, "bca_low": None, "bca_high": None}
    if 0 < below < 1:  # else there is nothing to correct by
        z0, z = P.norm_ppf(below), P.norm_ppf(1 - tail)
        for name, s in (("bca_low", z0 - z), ("bca_high", z0 + z)):
            if 1 - acceleration * s > 0:
                out[name] = at(min(max(P.norm_cdf(z0 + s / (1 - acceleration * s)), 1e-15), 1 - 1e-15))
    return out


def of_law(seen: float, v: np.ndarray, chances: np.ndarray, acceleration: float, level: float = 0.95) -> dict[str, float | None]:
    total = chances.sum()
    mean = float((v * chances).sum() / total)
    se = math.sqrt(max(float((chances * (v - mean) ** 2).sum() / total), 0.0))
    return intervals(seen, mean, se, float(chances[v < seen].sum()), lambda q: first_at(v, chances, q), acceleration, level)


def bootstrap_quantile(x: Places, p: float, level: float = 0.95) -> dict[str, float | None]:
    """Limits of a quantile over all resamples."""
    v, chances = quantile_law(x.near(p), p)
    return of_law(x.at(place_of(p, x.n)), v, chances, jackknifed(x, [p], [1]), level)


class Spread:
    """Law of the difference of two quantiles of one resample."""

    def __init__(self, x: Places, low: float, high: float) -> None:
        self.x, self.n = x, x.n
        self.r, self.s = place_of(low, x.n), place_of(high, x.n)
        a, self.b = x.near(low), x.near(high)
        self.a, self.b_upto = a.v, (self.b.before + self.b.rows) / x.n
        self.tiny = 1e-12 * max(1.0, np.abs(x.v).max())
        sd = math.sqrt(low * (1 - low) / x.n)
        lo, hi = a.before / x.n, (a.before + a.rows) / x.n
        lo, hi = np.maximum(lo, low - FAR * sd - 1 / x.n), np.minimum(hi, low + FAR * sd + 1 / x.n)
        lo, hi = np.clip(lo, 0, 1), np.clip(hi, 0, 1)
        parts = np.maximum(np.ceil((hi - lo) / sd), 1).astype(np.int64)
        at = np.repeat(np.arange(len(lo)), parts)
        step = ((hi - lo) / parts)[at]
        start = lo[at] + step * (np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts))
        node, weight = np.polynomial.legendre.leggauss(24 if x.n <= 48 else 12 if step.max(initial=0) > sd / 4 else 4 if step.max(initial=0) > sd / 20 else 2)
        u = (start[:, None] + step[:, None] * (node + 1) / 2).ravel()
        self.of = np.repeat(at, len(node))
        with np.errstate(divide="ignore"):
            density = math.lgamma(x.n + 1) - math.lgamma(self.r) - math.lgamma(x.n - self.r + 1) + (self.r - 1) * np.log(u) + (x.n - self.r) * np.log1p(-u)
        mass = np.exp(density) * (step[:, None] * weight / 2).ravel()
        some = mass > 1e-18
        self.u, self.mass, self.of = u[some], mass[some], self.of[some]

    def upto(self, t: float) -> float:
        """Chance of a difference of at most t."""
        if self.r == self.s:
            return float(t >= 0)
        if t < 0:
            return 0.0
        k = np.searchsorted(self.b.v, self.a + t + self.tiny, "right")
        f = np.where(k > 0, self.b_upto[np.maximum(k - 1, 0)], self.b.before[0] / self.n)[self.of]
        z, k, m = np.clip((f - self.u) / (1 - self.u), 0, 1), self.s - self.r, self.n - self.r + 1
        away = (z - k / m) / math.sqrt(k * (m - k) / m**3)
        near = np.abs(away) < FAR if self.n > 48 else np.ones(len(z), bool)
        rest = np.where(away > 0, 1.0, 0.0)
        rest[near] = P.beta_inc_many(z[near], k, m - k)
        return min(1.0, float((self.mass * rest).sum()))

    def snapped(self, t: float) -> float:
        """The largest difference up to t that there is."""
        k = np.searchsorted(self.b.v, self.a + t + self.tiny, "right")
        d = self.b.v[np.maximum(k - 1, 0)] - self.a
        return float(d[(k > 0) & (d >= 0)].max(initial=0.0))

    def at(self, q: float) -> float:
        lo, hi = -self.tiny, float(self.b.v.max() - self.a.min())
        for _ in range(80):
            mid = (lo + hi) / 2
            if mid in (lo, hi) or hi - lo < self.tiny:
                break
            lo, hi = (lo, mid) if self.upto(mid) >= q - 1e-12 else (mid, hi)
        return self.snapped(hi)

    def moments(self) -> tuple[float, float]:
        """Mean and standard deviation: over all differences where these are few, else over a grid of 201."""
        if len(self.a) * len(self.b.v) <= 4096:
            t = np.unique(np.maximum((self.b.v[None] - self.a[:, None]).ravel(), 0))
        else:
            t = np.linspace(self.at(1e-9), self.at(1 - 1e-9), 201)
        c = np.diff([0.0, *[self.upto(x) for x in t]])
        middle = t if len(self.a) * len(self.b.v) <= 4096 else t - np.diff(t, prepend=t[0]) / 2
        mean = float((middle * c).sum() / c.sum())
        return mean, math.sqrt(max(float((c * (middle - mean) ** 2).sum() / c.sum()), 0.0))


def bootstrap_spread(x: Places, low: float = 0.25, high: float = 0.75, level: float = 0.95) -> dict[str, float | None]:
    """Limits of the difference of two quantiles over all resamples."""
    s = Spread(x, low, high)
    seen = x.at(s.s) - x.at(s.r)
    mean, se = s.moments()
    below = s.upto(seen - 4 * s.tiny)
    return intervals(seen, mean, se, below, s.at, jackknifed(x, [high, low], [1, -1]), level)


def bootstrap_gap(a: Places, b: Places, p: float = 0.5, level: float = 0.95) -> dict[str, float]:
    """Limits of a's quantile less b's, each group resampled by itself: the two laws are folded without forming their pairs."""
    (v, pv), (w, pw) = quantile_law(a.near(p), p), quantile_law(b.near(p), p)
    cum, tiny = np.concatenate([[0.0], np.cumsum(pv)]), 1e-12 * max(1.0, np.abs(v).max(), np.abs(w).max())
    upto = lambda t: float((pw * cum[np.searchsorted(v, w + t + tiny, "right")]).sum())

    def at(q: float) -> float:
        lo, hi = v[0] - w[-1] - tiny, v[-1] - w[0]
        for _ in range(200):
            mid = (lo + hi) / 2
            if mid in (lo, hi) or hi - lo < tiny:
                break
            lo, hi = (lo, mid) if upto(mid) >= q - 1e-12 else (mid, hi)
        k = np.searchsorted(v, w + hi + tiny, "right")
        return float((v[np.maximum(k - 1, 0)] - w)[k > 0].max())

    mean = lambda x, c: float((x * c).sum() / c.sum())
    spread = lambda x, c: float((c * (x - mean(x, c)) ** 2).sum() / c.sum())
    seen = a.at(place_of(p, a.n)) - b.at(place_of(p, b.n))
    tail = (1 - level) / 2
    low, high = at(tail), at(1 - tail)
    return {"observed": seen, "bias": mean(v, pv) - mean(w, pw) - seen, "se": math.sqrt(spread(v, pv) + spread(w, pw)), "low": low, "high": high, "basic_low": 2 * seen - high, "basic_high": 2 * seen - low}


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def _choose(n, k):
    return _LGAMMA(np.asarray(n, float) + 1) - _LGAMMA(np.asarray(k, float) + 1) - _LGAMMA(np.asarray(n, float) - k + 1)


def _few_drawn(total: np.ndarray, marked: np.ndarray, drawn: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Chance of fewer than least marked ones among drawn of total, marked of which are.

    Summed away from the likeliest number: downwards from least - 1 below it, and beyond it upwards from least, as what lacks to 1.
    Its terms only fall, so that none is lost because the first one is too small for a number.
    """
    low, high = np.maximum(0, drawn - (total - marked)), np.minimum(drawn, marked)
    sure = (least > 0) & (high < least)
    live = (least > low) & ~sure
    up = live & (least > np.floor((drawn + 1.0) * (marked + 1.0) / (total + 2.0)))
    out, h = np.zeros(len(live)), np.where(up, least, np.where(live, least - 1, 0)).astype(float)
    with np.errstate(invalid="ignore"):
        term = np.where(live, np.exp(_choose(np.where(live, drawn, 0), h) + _choose(np.where(live, total - drawn, 0), np.where(live, marked - h, 0)) - _choose(np.where(live, total, 0), np.where(live, marked, 0))), 0.0)
    while live.any():
        out = out + np.where(live, term, 0)
        rest = total - drawn - marked + h
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(up, (drawn - h) * (marked - h) / ((h + 1) * (rest + 1)), h * rest / ((drawn - h + 1) * (marked - h + 1)))
        term, h = np.where(live, term * ratio, 0.0), h + np.where(up, 1, -1)
        live &= (h >= low) & (h <= high) & ((term > out * 1e-17) | (ratio > 1))
    return np.clip(np.where(sure, 1.0, np.where(up, 1 - out, out)), 0, 1)


def _gap_reached(x: Places, na: int, k: int, m: int, gap: float) -> float:
    """Chance that the m-th row of the second group lies at least gap above the k-th of the first, which has na of the n rows."""
    n, nb = x.n, x.n - na
    mean = k * (n + 1) / (na + 1)
    sd = math.sqrt(k * (na - k + 1) * (n + 1) * (n - na) / ((na + 1) ** 2 * (na + 2)))
    i = np.arange(max(k, math.floor(mean - FAR * sd - 2)), min(n - na + k, math.ceil(mean + FAR * sd + 2)) + 1)
    chance = np.exp(_choose(i - 1, k - 1) + _choose(n - i, na - k) - _choose(n, na))
    ends = x.before + x.rows
    value = x.v[np.minimum(np.searchsorted(ends, i), len(x.v) - 1)]
    reach_at = np.searchsorted(x.v, value + gap - 1e-12 * max(1.0, np.abs(x.v).max()))  # the first value so far above
    first = np.where(reach_at < len(x.v), x.before[np.minimum(reach_at, len(x.v) - 1)], ends[-1]) + 1
    first = np.maximum(first, i + 1)
    # rows of the second group among those between: fewer than are still to come before its m-th
    need = m - (i - k)
    between = first - 1 - i
    above = np.where(need > 0, _few_drawn(n - i, nb - (i - k), between, need), 0.0)
    if ends[-1] < n:  # what lies beyond the kept values has no chance
        above = np.where(reach_at < len(x.v), above, 0.0)
    return float((chance * above).sum())


def shuffled_gap(x: Places, na: int, observed: float, p: float = 0.5) -> float:
    """Chance, over all shuffles of the labels, of quantiles at least as far apart as observed; x holds both groups' values."""
    if observed == 0:
        return 1.0
    k, m = place_of(p, na), place_of(p, x.n - na)
    return min(1.0, _gap_reached(x, na, k, m, abs(observed)) + _gap_reached(x, x.n - na, m, k, abs(observed)))


def pooled_places(df: DataFrame, value: str, first: Column, p: float = 0.5) -> tuple[Places, int, float]:
    """Values of both groups around the places that their quantiles may take, rows of the first group, and the observed quantile of the second less the first's."""
    d = df.filter(F.col(value).isNotNull()).withColumn("_a", first.cast("int"))
    s = prefix_sums(d, [], value, {"n": F.lit(1), "a": F.col("_a")})
    n, na = F.col("n_all"), F.col("a_all")
    # a group of m rows of n: its quantile's place among all has this deviation, relative to n
    wide = lambda m: FAR * F.sqrt(F.lit(p * (1 - p)) * (n - m) / (n * (m + 2))) + 4 / F.least(m + 1, n)
    w = F.greatest(wide(na), wide(n - na))
    reaches = lambda upto, before, total: (upto >= F.ceil(p * total - 1e-9)) & (before < F.ceil(p * total - 1e-9))
    own_a = reaches(F.col("a_before") + F.col("a"), F.col("a_before"), na)
    own_b = reaches(F.col("n_before") - F.col("a_before") + F.col("n") - F.col("a"), F.col("n_before") - F.col("a_before"), n - na)
    near = ((F.col("n_before") + F.col("n")) / n >= p - w) & (F.col("n_before") / n <= p + w)
    rows = s.filter(near | own_a | own_b).select(F.col(value).alias("v"), "n_before", "n", "n_all", "a_all", near.alias("near"), own_a.alias("own_a"), own_b.alias("own_b")).orderBy("v").collect()
    kept = [r for r in rows if r["near"]]
    x = Places([r["v"] for r in kept], [r["n_before"] for r in kept], [r["n"] for r in kept], rows[0]["n_all"] if rows else 0)
    seen = sum(r["v"] for r in rows if r["own_b"]) - sum(r["v"] for r in rows if r["own_a"])
    return x, (rows[0]["a_all"] if rows else 0), float(seen)
