"""Laws without draws against all resamples and all shuffles of small data, and against many of larger data."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.functions import distributions as P
from tallyworks.operators import laws as L

SMALL = [[1.0, 2.0, 2.0, 5.0, 9.0], [3.0, 3.0, 3.0, 7.0], [0.1, 0.4, 1.7, 2.2, 2.9, 8.0], [4.0, 4.0, 4.0]]


def places(values):
    v, n = np.unique(np.asarray(values, float), return_counts=True)
    return L.Places(v, np.cumsum(n) - n, n, len(values))


def at(values, p):
    return sorted(values)[L.place_of(p, len(values)) - 1]


def law(values):
    """All resamples of a small list, each as likely."""
    return [sorted(t) for t in itertools.product(values, repeat=len(values))]


def test_beta_inc_of_many():
    x = np.linspace(0, 1, 41)
    for a, b in ((1, 1), (3, 8), (400, 20), (7500, 7501), (1, 30)):
        assert np.allclose(P.beta_inc_many(x, a, b), [P.beta_inc(v, a, b) for v in x], atol=1e-13)


def test_beta_inc_of_large_parameters(monkeypatch):
    x = np.linspace(0, 1, 4001)
    for a, b in ((1000, 1000), (1200, 30_000), (75_000, 225_001)):
        got = P.beta_inc_many(x, a, b)
        with monkeypatch.context() as m:
            m.setattr(P, "LARGE", 1e99)
            assert np.allclose(got, P.beta_inc_many(x, a, b), atol=2e-10)  # the fraction's front has rounded logs of gammas
    for n in (10**5, 27 * 10**6, 10**9):  # halves by symmetry, and far out the normal law
        sd = 0.5 / math.sqrt(2 * n + 1)
        assert abs(P.beta_inc_many(np.array([0.5]), n, n)[0] - 0.5) < 1e-12
        assert np.allclose(P.beta_inc_many(0.5 + sd * np.array([-12, -1, 2, 12]), n, n), [0, P.norm_cdf(-1), P.norm_cdf(2), 1], atol=1 / n)


@pytest.mark.parametrize("values", SMALL)
@pytest.mark.parametrize("p", [0.25, 0.5, 0.75])
def test_quantiles_of_all_resamples(values, p):
    drawn = np.array([at(t, p) for t in law(values)])
    v, c = L.quantile_law(places(values), p)
    assert np.allclose(c, [(drawn == x).mean() for x in v], atol=1e-12)
    check(L.bootstrap_quantile(places(values), p), at(values, p), drawn, [at(values[:i] + values[i + 1:], p) for i in range(len(values))])


def check(got, seen, drawn, left_out):
    d = np.sort(drawn)
    quantile = lambda q: d[min(len(d) - 1, math.ceil(q * len(d) - 1e-9) - 1)]
    assert got["observed"] == pytest.approx(seen) and got["bias"] == pytest.approx(d.mean() - seen, abs=1e-9) and got["se"] == pytest.approx(d.std(), abs=1e-9)
    low, high = quantile(0.025), quantile(0.975)
    assert (got["low"], got["high"]) == pytest.approx((low, high)) and (got["basic_low"], got["basic_high"]) == pytest.approx((2 * seen - high, 2 * seen - low))
    below = (d < seen - 1e-9).mean()
    if not 0 < below < 1:
        assert got["bca_low"] is None and got["bca_high"] is None
        return
    e = np.mean(left_out) - np.array(left_out)
    a = (e**3).sum() / (6 * (e**2).sum() ** 1.5) if (e**2).sum() else 0.0
    z0 = P.norm_ppf(below)
    for name, z in (("bca_low", z0 + P.norm_ppf(0.025)), ("bca_high", z0 + P.norm_ppf(0.975))):
        assert got[name] == pytest.approx(quantile(P.norm_cdf(z0 + z / (1 - a * z))))


@pytest.mark.parametrize("values", SMALL)
def test_spread_of_all_resamples(values):
    iqr = lambda t: at(t, 0.75) - at(t, 0.25)
    drawn = np.array([iqr(t) for t in law(values)])
    s = L.Spread(places(values), 0.25, 0.75)
    for t in np.unique(drawn):
        assert s.upto(t) == pytest.approx((drawn <= t + 1e-9).mean(), abs=1e-9)
    check(L.bootstrap_spread(places(values)), iqr(values), drawn, [iqr(values[:i] + values[i + 1:]) for i in range(len(values))])


def test_spread_of_many_resamples():
    rng = np.random.default_rng(3)
    for values in (rng.lognormal(2, 0.8, 900), rng.integers(0, 12, 800).astype(float)):
        got = L.bootstrap_spread(places(values))
        d = np.sort(rng.choice(values, (20_000, len(values))), axis=1)
        drawn = d[:, L.place_of(0.75, len(values)) - 1] - d[:, L.place_of(0.25, len(values)) - 1]
        assert got["se"] == pytest.approx(drawn.std(), rel=0.03)
        for name, q in (("low", 0.025), ("high", 0.975)):
            assert abs((drawn <= got[name] + 1e-9).mean() - q) < 0.006 or ((drawn < got[name] - 1e-9).mean() < q <= (drawn <= got[name] + 1e-9).mean() + 0.006)


@pytest.mark.parametrize("a, b", [([1.0, 2.0, 2.0, 5.0], [0.0, 3.0, 3.0]), ([1.0, 4.0, 6.0, 6.0, 7.0], [2.0, 2.5, 9.0, 9.5])])
def test_gap_of_all_resamples(a, b):
    drawn = np.sort([at(s, 0.5) - at(t, 0.5) for s in law(a) for t in law(b)])
    got = L.bootstrap_gap(places(a), places(b))
    quantile = lambda q: drawn[math.ceil(q * len(drawn) - 1e-9) - 1]
    assert (got["low"], got["high"]) == pytest.approx((quantile(0.025), quantile(0.975)))
    assert got["se"] == pytest.approx(drawn.std()) and got["bias"] == pytest.approx(drawn.mean() - got["observed"], abs=1e-12)


@pytest.mark.parametrize("a, b", [([1.0, 2.0, 2.0, 5.0], [0.0, 3.0, 3.0]), ([1.0, 4.0, 6.0, 6.0, 7.0], [2.0, 2.5, 9.0, 9.5, 11.0, 12.0]), ([1.0, 1.0, 1.0], [1.0, 2.0, 2.0, 2.0, 8.0]), ([5.0], [1.0, 2.0, 3.0])])
def test_gap_of_all_shuffles(spark, a, b):
    both = a + b
    gaps = []
    for chosen in itertools.combinations(range(len(both)), len(a)):
        rest = [both[i] for i in range(len(both)) if i not in chosen]
        gaps.append(abs(at(rest, 0.5) - at([both[i] for i in chosen], 0.5)))
    seen = at(b, 0.5) - at(a, 0.5)
    assert L.shuffled_gap(places(both), len(a), seen) == pytest.approx(np.mean(np.array(gaps) >= abs(seen) - 1e-9), abs=1e-12)
    df = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b] + [(None, True)], "x double, first boolean")
    x, na, found = L.pooled_places(df, "x", F.col("first"))
    assert (na, found, x.n) == (len(a), seen, len(both)) and L.shuffled_gap(x, na, found) == pytest.approx(np.mean(np.array(gaps) >= abs(seen) - 1e-9), abs=1e-12)


def test_gap_of_many_shuffles(spark):
    rng = np.random.default_rng(5)
    for a, b in ((rng.normal(0, 1, 300), rng.normal(0.15, 1, 700)), (rng.integers(0, 9, 400).astype(float), rng.integers(0, 10, 380).astype(float))):
        df = spark.createDataFrame([(float(v), True) for v in a] + [(float(v), False) for v in b], "x double, first boolean").repartition(3)
        x, na, seen = L.pooled_places(df, "x", F.col("first"))
        got = L.shuffled_gap(x, na, seen)
        both, k, m = np.r_[a, b], L.place_of(0.5, len(a)) - 1, L.place_of(0.5, len(b)) - 1
        order = rng.permuted(np.tile(both, (8000, 1)), axis=1)
        gap = np.abs(np.sort(order[:, len(a):], axis=1)[:, m] - np.sort(order[:, :len(a)], axis=1)[:, k])
        drawn = (gap >= abs(seen) - 1e-9).mean()
        assert abs(got - drawn) < 4 * math.sqrt(max(drawn * (1 - drawn), 1e-3) / 8000), (got, drawn)


def test_places_that_reach_the_driver(spark):
    df = spark.range(0, 40_000, numPartitions=4).withColumn("x", F.rand(4))
    got = L.places_near(df, "x", [0.25, 0.75])
    assert got.n == 40_000 and len(got.v) < 2 * 20 * math.sqrt(40_000)
    values = sorted(r.x for r in df.collect())
    assert got.at(10_000) == values[9_999] and got.near(0.75).at(30_000) == values[29_999]


def test_few_drawn_far_beyond_the_likeliest():
    """Brute force, also where the number asked for lies so far out that its own chance is no number any more."""
    def brute(total, marked, drawn, least):
        ways = [math.comb(marked, h) * math.comb(total - marked, drawn - h) for h in range(min(marked, drawn) + 1)]
        return float(Fraction(sum(ways[:max(0, least)]), sum(ways)))

    cases = [(4000, 1000, 2000, least) for least in (-3, 0, 1, 250, 480, 500, 501, 530, 700, 900, 1000, 1001)] + [(12000, 4000, 6000, least) for least in (2000, 2400, 3000, 3900)] + [(60, 50, 30, least) for least in (19, 20, 21, 25, 30, 31)] + [(5, 0, 3, 1), (5, 5, 5, 5), (5, 5, 5, 6)]
    got = L._few_drawn(*[np.array(x) for x in zip(*cases, strict=True)])
    assert np.allclose(got, [brute(*q) for q in cases], atol=1e-9), list(zip(cases, got, [brute(*q) for q in cases], strict=True))
