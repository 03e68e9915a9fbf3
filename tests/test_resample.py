"""Resampling and models without SQL text against plain numpy."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyworks.functions import distributions as P
from tallyworks.operators import models as M
from tallyworks.operators import resample as B
from tallyworks.operators.survey import poisson_edges
from tallyworks.operators.normality import royston_p

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


@pytest.fixture(scope="module")
def values(spark):
    x = np.random.default_rng(2).lognormal(2, 0.7, 400).round(2)
    return x, spark.createDataFrame([(i, float(v), i % 3 == 0) for i, v in enumerate(x)], "id long, x double, first boolean")


def test_poisson_counts_have_their_chances():
    e = poisson_edges()
    assert len(e) > 12 and abs(e[0] - np.exp(-1)) < 1e-15 and abs(sum(1 - v for v in e) - 1) < 1e-12  # the mean is 1


def test_bootstrap_of_a_mean(spark, values):
    x, df = values
    got = {r.rep: r.t for r in B.bootstrap_means(df, "id", {"t": (F.col("x"), F.lit(1))}, 30, "s").collect()}
    e = np.array(poisson_edges())
    for rep in range(1, 31):
        k = np.array([(uniform("s", i, rep) >= e).sum() for i in range(len(x))])
        assert abs(got[rep] - (k * x).sum() / k.sum()) < 1e-9


def test_intervals():
    t = np.random.default_rng(0).normal(5, 1, 4000)
    plain = B.intervals(5.0, t.tolist(), 0.0)
    assert abs(plain["low"] - 3.04) < 0.1 and abs(plain["bca_low"] - plain["low"]) < 0.1 and abs(plain["se"] - 1) < 0.05
    skewed = B.intervals(5.0, t.tolist(), 0.1)
    assert skewed["bca_low"] > plain["bca_low"] and skewed["bca_high"] > plain["bca_high"]
    assert B.intervals(99.0, t.tolist(), 0.0)["bca_low"] > np.quantile(t, 0.99)  # seen beyond all replicates


def test_median_of_all_resamples(spark, values):
    x, df = values
    got = B.quantile_bootstrap(df.union(df.limit(0)), "x", 0.5).first()
    rng = np.random.default_rng(1)
    drawn = np.sort(np.sort(rng.choice(x, (20_000, len(x))), axis=1)[:, len(x) // 2 - 1])
    near = np.sort(x)
    at = lambda v: int(np.searchsorted(near, v))
    assert got.estimate == near[len(x) // 2 - 1]
    assert abs(at(got.low) - at(drawn[500])) <= 1 and abs(at(got.high) - at(drawn[-501])) <= 1


def test_shuffles_keep_the_group_size(spark, values):
    x, df = values
    size = sum(i % 3 == 0 for i in range(len(x)))
    got = {r.rep: r.s for r in B.permuted_sums(df, "id", "x", F.col("first"), 12, "p").collect()}
    assert sorted(got) == list(range(1, 13))
    for rep in got:
        order = sorted(range(len(x)), key=lambda i: (uniform("p", i, rep), i))
        assert abs(got[rep] - x[order[:size]].sum()) < 1e-9
    tied = B.permuted_sums(df.withColumn("x", F.lit(1.0)), "id", "x", F.col("first"), 3, "p").collect()
    assert [r.s for r in tied] == [size] * 3


@pytest.mark.parametrize("n, w, p", [(3, 0.75, 0.0), (50, 0.9, 0.0005), (20, 0.96, 0.54), (8, 0.9, 0.29)])
def test_shapiro_p(n, w, p):
    assert abs(royston_p(w, n) - p) < 0.02


def test_components_and_correspondence(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame(a.tolist(), "a double, b double, c double, d double")
    values, vectors, *_ = M.pca(df, list("abcd"))
    z = (a - a.mean(0)) / a.std(0, ddof=1)
    want = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(values, want[1] ** 2 / 59) and np.allclose(np.abs(vectors), np.abs(want[2].T))
    t = rng.integers(1, 40, (6, 4)).astype(float)
    ca = M.correspondence(t)
    e = t.sum(1)[:, None] * t.sum(0) / t.sum()
    assert abs(ca["chi2"] - ((t - e) ** 2 / e).sum()) < 1e-8
    # distances between row profiles are those of the coordinates
    prof = t / t.sum(1)[:, None]
    d = lambda i, j: ((prof[i] - prof[j]) ** 2 / (t.sum(0) / t.sum())).sum()
    assert abs(d(0, 1) - ((ca["rows"][0] - ca["rows"][1]) ** 2).sum()) < 1e-9


@given
def test_clusters_take_all_components(spark):
    rows = entry.queries()["kmeans"](spark, SF).collect()
    v = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("embedding IS NOT NULL AND label IS NOT NULL").collect()], float)
    assert all(sum(r.n for r in rows if r.k == k) == len(v) for k in (2, 3, 4, 5))
    by_k = {r.k: r.inertia for r in rows}
    assert by_k[2] < ((v - v.mean(0)) ** 2).sum() and by_k[5] < by_k[2]


@given
def test_tukey_p(spark):
    for r in entry.queries()["posthoc_adjusted"](spark, SF).collect():
        assert r.raw - 1e-6 <= r.tukey <= min(1, 10 * r.raw) + 1e-3 and 0 <= r.p_holm <= r.bonferroni <= 1
    assert abs(1 - P.studentized_range_cdf(3.877676, 3, 10) - 0.05) < 1e-3
