import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.operators import differences as X


def counted(spark, values, parts=3):
    return X.counted(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(parts), F.col("v"))


CASES = {
    "real": lambda g: (g.lognormal(3, 2, 300) / 7, g.lognormal(3, 2, 260) / 3),
    "ties": lambda g: (g.integers(0, 40, 300) / 10, g.integers(5, 60, 331) / 10),
    "one value": lambda g: (np.full(50, 0.1), np.full(31, 0.3)),
    "few": lambda g: (np.array([0.1, 0.7]), np.array([0.3])),
    "far": lambda g: (np.r_[g.normal(0, 1, 200), 1e9, -1e9], np.r_[g.normal(2, 1e-3, 200), 5e8]),
    "hot": lambda g: (np.r_[np.full(300, 2.2), g.normal(2, 3, 150)], np.r_[np.full(200, 1.1), g.normal(1, 3, 155)]),
}


@pytest.mark.parametrize("name", CASES)
def test_median_difference(spark, monkeypatch, name):
    monkeypatch.setattr(X, "FEW", 500)  # so that rounds are needed
    a, b = CASES[name](np.random.default_rng(7))
    d = np.sort(np.subtract.outer(a, b).ravel())
    assert X.median_difference(counted(spark, a), counted(spark, b)) == (d[(len(d) - 1) // 2], len(d))


@pytest.mark.parametrize("name", ["ties", "far", "hot"])
def test_median_average(spark, monkeypatch, name):
    monkeypatch.setattr(X, "FEW", 500)
    a, _ = CASES[name](np.random.default_rng(8))
    i, j = np.triu_indices(len(a))
    d = np.sort(a[i] + a[j])
    assert X.median_average(counted(spark, a)) == (d[(len(d) - 1) // 2] / 2, len(d))


def test_every_place(spark):
    a, b = [0.1, 0.2, 0.2, 0.5], [0.1, 0.4, 0.7]
    x, y = counted(spark, a), counted(spark, b)
    d = np.sort(np.subtract.outer(a, b).ravel())
    assert [X.place_among(x, y, k) for k in (1, 6, 12)] == [d[k - 1] for k in (1, 6, 12)]


def test_none(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert X.median_difference(X.counted(none, F.col("v")), counted(spark, [1.0])) == (None, 0) and X.median_average(X.counted(none, F.col("v"))) == (None, 0)


@pytest.mark.parametrize("name", [k for k in CASES if k != "few"])
def test_many_strips(spark, monkeypatch, name):
    monkeypatch.setattr(X, "FEW", 50)
    monkeypatch.setattr(X, "STRIP", 20)
    monkeypatch.setattr(X, "BLOCKS", 16)
    a, b = CASES[name](np.random.default_rng(9))
    d = np.sort(np.subtract.outer(a, b).ravel())
    assert X.median_difference(counted(spark, a), counted(spark, b)) == (d[(len(d) - 1) // 2], len(d))
    i, j = np.triu_indices(len(a))
    own = np.sort(a[i] + a[j])
    assert X.median_average(counted(spark, a)) == (own[(len(own) - 1) // 2] / 2, len(own))


def test_ties_end_the_rounds(spark, monkeypatch):
    """Differences of whole cents: each occurs some hundred times, so that a bracket never holds few until it holds one."""
    calls = []
    upto = X.Strips.upto
    monkeypatch.setattr(X.Strips, "upto", lambda self, cuts: calls.append(len(cuts)) or upto(self, cuts))
    monkeypatch.setattr(X, "FEW", 50)
    g = np.random.default_rng(10)
    a, b = g.integers(0, 20_000, 3000) / 100, g.integers(0, 20_000, 3000) / 100
    d = np.sort(np.subtract.outer(a, b).ravel())
    assert X.median_difference(counted(spark, a), counted(spark, b)) == (d[(len(d) - 1) // 2], len(d))
    assert len(calls) <= 6  # equal distances alone would take twelve or more
