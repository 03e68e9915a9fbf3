"""Correspondence points, groups left out and the rules for tests against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.functions import distributions as P
from tallyworks.operators import compare as K
from tallyworks.operators import models as M
from tallyworks.plans import comparisons as C


@pytest.mark.parametrize("shape", [(9, 4), (3, 8), (2, 2)])
def test_correspondence_points(spark, shape):
    rng = np.random.default_rng(sum(shape))
    t = rng.integers(0, 30, shape).astype(float)
    t[0, 0] = 0
    t[:, -1] += 1
    t[-1] += 1
    rows = [(f"a{i}", f"b{j}") for i in range(shape[0]) for j in range(shape[1]) for _ in range(int(t[i, j]))]
    cells = K.contingency(spark.createDataFrame(rows, "x string, y string").repartition(3), "x", "y")
    k = min(2, min(shape) - 1)
    got = {(r.side, r.label): r for r in M.correspondence_points(cells, k).collect()}
    want = M.correspondence(t)
    p = t / t.sum()
    r, c = p.sum(1), p.sum(0)
    s2 = (p - np.outer(r, c)) ** 2 / np.outer(r, c)
    assert len(got) == sum(shape)
    for side, name, coords, mass, inertia in (("row", "a", want["rows"], r, s2.sum(1)), ("column", "b", want["columns"], c, s2.sum(0))):
        for i in range(len(mass)):
            q = got[side, f"{name}{i}"]
            xy = np.array([q[f"axis{j + 1}"] for j in range(k)])
            assert np.allclose(np.abs(xy), np.abs(coords[i, :k])) and np.isclose(q.mass, mass[i]) and np.isclose(q.inertia, inertia[i])
            assert np.allclose([q[f"contribution{j + 1}"] for j in range(k)], mass[i] * coords[i, :k] ** 2 / want["inertia"][:k])
            assert np.isclose(q.quality, (coords[i, :k] ** 2).sum() / (coords[i] ** 2).sum())
        assert np.isclose(sum(q.inertia for (w, _), q in got.items() if w == side), want["chi2"] / t.sum())
    # the sides agree in sign: rows are the weighted means of columns
    x = np.array([[got["row", f"a{i}"][f"axis{j + 1}"] for j in range(k)] for i in range(shape[0])])
    y = np.array([[got["column", f"b{i}"][f"axis{j + 1}"] for j in range(k)] for i in range(shape[1])])
    assert np.allclose(x * np.sqrt(want["inertia"][:k]), (p / r[:, None]) @ y)


def test_leave_one_out(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4)) + 1000
    g = rng.integers(0, 7, 120)
    names = list("abcd")
    df = spark.createDataFrame([(f"g{k}", *map(float, v)) for k, v in zip(g, x, strict=True)], "g string, " + ", ".join(f"{n} double" for n in names)).repartition(4)
    got = {r.g: r for r in M.leave_one_out(df, "g", names).collect()}
    assert len(got) == 7
    for k in range(7):
        cor = np.corrcoef(x[g != k].T)
        assert np.allclose(got[f"g{k}"].r, [cor[i, j] for i, j in itertools.combinations(range(4), 2)]) and np.isclose(got[f"g{k}"].share, np.linalg.eigvalsh(cor)[-1] / 4)
    flat = spark.createDataFrame([("u", 1.0, 2.0), ("v", 1.0, 3.0), ("w", 1.0, 9.0)], "g string, a double, b double")
    assert all(r.r == [None] and r.share is None for r in M.leave_one_out(flat, "g", ["a", "b"]).collect())


def test_a_test_for_every_branch(spark):
    cases = {
        ("numeric", True, True, True, True): "welch t", ("numeric", True, True, False, True): "welch t", ("numeric", True, False, True, True): "mann-whitney",
        ("numeric", False, True, True, True): "anova", ("numeric", False, True, False, True): "welch anova", ("numeric", False, False, False, True): "kruskal-wallis", ("numeric", False, False, True, True): "kruskal-wallis",
        ("categorical", True, True, True, False): "fisher", ("categorical", True, True, True, True): "chi2", ("categorical", False, True, True, True): "chi2", ("categorical", False, True, True, False): "chi2",
    }
    facts = spark.createDataFrame([(str(i), *k) for i, k in enumerate(cases)], "comparison string, kind string, two boolean, normal boolean, equal boolean, expected boolean")
    got = {r.comparison: r for r in C.chosen(facts).collect()}
    assert {i: got[str(i)].test for i in range(len(cases))} == dict(enumerate(cases.values()))
    assert all(r.reason and r.effect in C.CUTS and r.alternative != r.test for r in got.values())


def test_normality_of_groups(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.normal(size=400)] + [("b", float(v)) for v in rng.normal(5, 2, 300)]
    schema = "g string, x double"
    assert C.normal_groups(spark.createDataFrame(rows, schema), "x", "g").first()[0]
    assert not C.normal_groups(spark.createDataFrame(rows + [("c", float(v)) for v in rng.lognormal(size=300)], schema), "x", "g").first()[0]


def test_quantiles_in_columns(spark):
    rows = spark.createDataFrame([(3.0,), (17.5,), (250.0,)], "df double")
    for r in rows.select("df", P.quantile(lambda q: P.t_two_sided(q, F.col("df")), 0.05, 0, 200).alias("t"), P.quantile(lambda q: P.chi2_upper(q, F.col("df")), 0.025, 0, 1000).alias("c")).collect():
        assert abs(r.t - P.t_ppf(0.975, r.df)) < 1e-9 and abs(r.c - P.chi2_ppf(0.975, r.df)) < 1e-7


def test_effect_labels(spark):
    rows = spark.createDataFrame([("d", -0.9, "large"), ("d", 0.1, "negligible"), ("eta2", 0.06, "medium"), ("v", 0.2, "small"), ("r", 0.5, "large")], "m string, v double, want string")
    assert all(r[0] == r[1] for r in rows.select("want", C.label(F.col("m"), F.col("v"))).collect())
