import math

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import distributions as P
from tallyworks.functions import scalars as S
from tallyworks.operators import clean as C
from tallyworks.operators import compare as K
from tallyworks.operators import models as M
from tallyworks.operators import survey as V


def test_quantiles_against_printed_tables():
    assert abs(P.norm_ppf(0.975) - 1.959963984540054) < 1e-12
    assert abs(P.t_ppf(0.975, 10) - 2.2281388520) < 1e-9
    assert abs(P.chi2_ppf(0.95, 3) - 7.8147279033) < 1e-8
    assert abs(P.beta_ppf(0.5, 2, 3) - 0.3857275681) < 1e-9
    assert abs(P.studentized_range_ppf(0.95, 3, 20) - 3.5779) < 2e-3


def test_tails_as_columns(spark):
    r = spark.range(1).select(P.t_two_sided(F.lit(2.2281388520), F.lit(10)).alias("t"), P.f_upper(F.lit(4.102821), F.lit(2), F.lit(10)).alias("f"), P.chi2_upper(F.lit(7.8147279033), F.lit(3)).alias("c"),
                              P.normal_upper(F.lit(30.0)).alias("z"), P.binomial_lower(F.lit(3), F.lit(10), F.lit(0.5)).alias("b")).first()
    assert abs(r.t - 0.05) < 1e-8 and abs(r.f - 0.05) < 1e-6 and abs(r.c - 0.05) < 1e-8 and 0 < r.z < 1e-190 and abs(r.b - 176 / 1024) < 1e-12


@pytest.mark.parametrize("text, day", [("31/02/2024", None), ("29/02/2024", "2024-02-29"), ("2023-02-29", None), ("2024-02-29", "2024-02-29"), ("x", None), (None, None), ("", None)])
def test_dates(spark, text, day):
    v = spark.createDataFrame([(text,)], "d string").select(S.parse_date("d")).first()[0]
    assert (v and v.isoformat()) == day


def test_numbers(spark):
    rows = [("1.234,56", 1234.56), ("+3", 3.0), ("1.2.3x", None), ("", None), ("-0,5", -0.5)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(S.parse_number("t")["value"]).collect()
    assert [r[0] for r in got] == [v for _, v in rows]


def test_formatting(spark):
    r = spark.createDataFrame([(-0.0000001, 1234567.891, None)], "a double, b double, c double").select(S.format_result("a"), S.format_es("b"), S.format_result("c"), S.format_flag(F.lit(True)), S.fold_key(F.lit("Ñandú, Él"))).first()
    assert list(r) == ["0.000000", "1.234.567,89", "", "Sí", "nanduel"]


def test_cleaning_keeps_first_row(spark):
    df = spark.createDataFrame([(1, "7", "5"), (2, "7", "6"), (3, "8", "x")], "line int, id string, v string")
    got = {r.id: r.v for r in C.clean_table(df, [C.VarSpec("v", "integer", 0, 10)], "id", "line").collect()}
    assert got == {"7": 5.0, "8": None}


def test_one_psu_strata_are_counted(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (2, 3, 1.0), (2, 3, 1.0)], "h int, c int, y double")
    r = V.ratio_estimate(df, "h", "c", F.lit(1.0), F.col("y"), F.lit(1.0)).first()
    assert (r.p, r.lonely, r.df) == (0.75, 1, 1)
    assert abs(r.se - math.sqrt(2 * ((0.25**2 + 0.75**2) - (0.25 - 0.75) ** 2 / 2)) / 4) < 1e-12


def test_wrong_weight_is_noticed(spark):
    """A changed weight changes the estimate: the check against a recount would fail."""
    df = spark.createDataFrame([(1, i, float(i % 3), i % 5 + 1) for i in range(40)], "h int, c int, y double, w int")
    right = V.ratio_estimate(df, "h", "c", F.col("w"), F.col("y"), F.lit(1.0)).first().p
    wrong = V.ratio_estimate(df, "h", "c", F.lit(1.0), F.col("y"), F.lit(1.0)).first().p
    assert abs(right - wrong) > 1e-6


def test_poststratified_weights_sum_to_counts(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("b", 4.0)], "cell string, w double")
    n = spark.createDataFrame([("a", 50), ("b", 7)], "cell string, N int")
    got = {r.cell: r.s for r in V.poststratify(df, "cell", "w", n).groupBy("cell").agg(F.sum("weight_ps").alias("s")).collect()}
    assert abs(got["a"] - 50) < 1e-9 and abs(got["b"] - 7) < 1e-9


def test_replicates_are_reproducible_and_fair(spark):
    u = spark.range(500).withColumnRenamed("id", "u")
    a = V.replicates(u, "u", 40, "s").groupBy("rep").agg(F.sum("times").alias("n")).collect()
    b = V.replicates(u.repartition(7), "u", 40, "s").groupBy("rep").agg(F.sum("times").alias("n")).collect()
    assert sorted(a) == sorted(b) and abs(sum(r.n for r in a) / 40 - 500) < 25


def test_separated_classes_give_no_table(spark):
    df = spark.createDataFrame([(float(i), int(i >= 50)) for i in range(100)], "x double, y int")
    assert M.logistic(df, ["x"], "y") is None
    mixed = spark.createDataFrame([(float(i), int((i * 7919) % 100 < i)) for i in range(100)], "x double, y int")
    f = M.logistic(mixed, ["x"], "y")
    assert f is not None and f["beta"][1] > 0


def test_ols_residuals_and_types(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, z = rng.normal(size=300), rng.normal(size=300)
    y = 1 + 2 * x - z + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(v)) for a, b, v in zip(x, z, y)], "x double, z double, y double")
    f = M.ols(M.gram(df, ["x", "z"], "y"))
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(300), x, z]), y, rcond=None)
    assert np.allclose(f.beta, beta)
    d = M.diagnostics(df, f, "y").agg(F.sum("residual").alias("r"), F.sum("leverage").alias("h")).first()
    assert abs(d.r) < 1e-8 and abs(d.h - 3) < 1e-9
    cells = df.withColumn("a", (F.col("x") > 0).cast("int")).withColumn("b", (F.col("z") > 0).cast("int")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    ss = {n: s for n, s, _ in M.two_way(cells, "a", "b")[0]}
    assert all(v >= -1e-9 for v in ss.values())


def test_holm_is_monotone(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    got = {r.k: r.p_holm for r in K.holm(p, "p", ["k"]).collect()}
    assert [round(got[k], 9) for k in "acb"] == [0.03, 0.06, 0.06]
