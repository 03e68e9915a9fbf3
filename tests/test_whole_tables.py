"""Queries without SQL text against brute force over all their rows."""

import os
from fractions import Fraction
from math import comb

import pytest

import __spark_entry__ as entry
from tallyworks.plans.comparisons import fisher_exact
from tallyworks.plans.registry import persons

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def brute_fisher(m1, m0, n, k):
    ways = {i: comb(m1, i) * comb(m0, n - i) for i in range(max(0, n - m0), min(n, m1) + 1)}
    return float(Fraction(sum(w for w in ways.values() if w <= ways[k]), sum(ways.values())))


@pytest.mark.parametrize("m1, m0, n, k", [(8, 6, 7, 6), (3, 3, 3, 0), (0, 5, 2, 0), (5, 0, 5, 5), (0, 0, 0, 0), (40, 25, 30, 11), (3000, 4000, 3500, 1460), (2500, 2500, 2500, 1210)])
def test_fisher_on_counts(spark, m1, m0, n, k):
    t = spark.createDataFrame([(m1, m0, n, k)], "m1 long, m0 long, n long, k long")
    assert abs(fisher_exact(t).first().p - brute_fisher(m1, m0, n, k)) < 1e-9


@given
def test_fisher_takes_all_persons(spark):
    rows = persons(spark, SF).select("status", "w").collect()
    yes, own = [r.status == "F" for r in rows], [r.w > 4 for r in rows]
    want = brute_fisher(sum(yes), len(rows) - sum(yes), sum(own), sum(a and b for a, b in zip(yes, own, strict=True)))
    assert abs(entry.queries()["fisher_2x2"](spark, SF).first().p - want) < 2e-9


@given
def test_rate_ratio_of_every_pair(spark):
    pops = sorted(r.pop for r in entry.queries()["poisson_ci"](spark, SF).select("pop").collect())
    got = entry.queries()["rate_ratio_ci"](spark, SF).collect()
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in pops for b in pops if a < b]
    rate = {r.pop: r.rate for r in entry.queries()["direct_ci_fay_feuer"](spark, SF).collect()}
    assert all(r.low <= r.ratio <= r.high and abs(r.ratio - rate[r.a] / rate[r.b]) < 1e-4 for r in got)
