"""Comparing groups: statistics from sums by group, then arithmetic on a few rows, then p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as P
from .order import average_ranks, quantiles

c = F.col


def group_stats(df: DataFrame, x: str, g: str) -> DataFrame:
    """g, n, mean, var (n - 1)."""
    return df.filter(c(x).isNotNull()).groupBy(g).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))


def two_groups(df: DataFrame, x: str, g: str, a: str, b: str) -> DataFrame:
    """na, ma, va, nb, mb, vb: one row."""
    s = group_stats(df.filter(c(g).isin(a, b)), x, g)
    return s.agg(*[F.max(F.when(c(g) == k, c(v))).alias(n + t) for k, t in ((a, "a"), (b, "b")) for v, n in (("n", "n"), ("mean", "m"), ("var", "v"))])


def t_test(s: DataFrame) -> DataFrame:
    """Welch and pooled t, degrees of freedom, p, Cohen's d and Hedges' g of a two_groups row."""
    ea, eb = c("va") / c("na"), c("vb") / c("nb")
    pooled = ((c("na") - 1) * c("va") + (c("nb") - 1) * c("vb")) / (c("na") + c("nb") - 2)
    s = s.withColumn("diff", c("ma") - c("mb")).withColumn("t_welch", c("diff") / F.sqrt(ea + eb)).withColumn("df_welch", (ea + eb) * (ea + eb) / (ea * ea / (c("na") - 1) + eb * eb / (c("nb") - 1)))
    s = s.withColumn("t_pooled", c("diff") / F.sqrt(pooled * (1 / c("na") + 1 / c("nb")))).withColumn("d", c("diff") / F.sqrt(pooled))
    return s.withColumn("g", c("d") * (1 - 3 / (4 * (c("na") + c("nb")) - 9))).withColumn("p_welch", P.t_two_sided(c("t_welch"), c("df_welch")))


def anova(df: DataFrame, x: str, g: str) -> DataFrame:
    """ss_between, ss_within, df1, df2, f, eta2, omega2, p: from group sums."""
    s = group_stats(df, x, g).filter("n > 1")
    t = s.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum(c("n") * c("mean")).alias("t"), F.sum(c("n") * c("mean") * c("mean")).alias("q"), F.sum((c("n") - 1) * c("var")).alias("ss_within"))
    t = t.withColumn("ss_between", c("q") - c("t") * c("t") / c("N")).withColumn("df1", c("k") - 1).withColumn("df2", c("N") - c("k"))
    ms = c("ss_within") / c("df2")
    t = t.withColumn("f", c("ss_between") / c("df1") / ms).withColumn("eta2", c("ss_between") / (c("ss_between") + c("ss_within"))).withColumn("omega2", (c("ss_between") - c("df1") * ms) / (c("ss_between") + c("ss_within") + ms))
    return t.select("ss_between", "ss_within", "df1", "df2", "f", "eta2", "omega2", P.f_upper(c("f"), c("df1"), c("df2")).alias("p"))


def welch_anova(df: DataFrame, x: str, g: str) -> DataFrame:
    s = group_stats(df, x, g).filter("n > 1 AND var > 0").withColumn("w", c("n") / c("var"))
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("sw", F.sum("w").over(whole)).withColumn("grand", F.sum(c("w") * c("mean")).over(whole) / c("sw"))
    t = s.agg(F.count(F.lit(1)).alias("k"), F.sum(c("w") * F.pow(c("mean") - c("grand"), 2)).alias("a"), F.sum(F.pow(1 - c("w") / c("sw"), 2) / (c("n") - 1)).alias("b"))
    k = c("k").cast("double")
    t = t.withColumn("f", c("a") / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * c("b"))).withColumn("df1", c("k") - 1).withColumn("df2", (k * k - 1) / (3 * c("b")))
    return t.select("f", "df1", "df2", P.f_upper(c("f"), c("df1"), c("df2")).alias("p"))


def alexander_govern(df: DataFrame, x: str, g: str) -> DataFrame:
    """chi2, df, p: normalised one-sample t of each group against the weighted mean."""
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = group_stats(df, x, g).filter("n > 1 AND var > 0").withColumn("w", c("n") / c("var")).withColumn("grand", F.sum(c("w") * c("mean")).over(whole) / F.sum("w").over(whole))
    s = s.withColumn("t", (c("mean") - c("grand")) / F.sqrt(c("var") / c("n"))).withColumn("v", c("n") - 1).withColumn("a", c("v") - 0.5).withColumn("b", 48 * c("a") * c("a"))
    s = s.withColumn("q", F.sqrt(c("a") * F.ln(1 + c("t") * c("t") / c("v"))))
    q = c("q")
    z = q + (F.pow(q, 3) + 3 * q) / c("b") - (4 * F.pow(q, 7) + 33 * F.pow(q, 5) + 240 * F.pow(q, 3) + 855 * q) / (10 * c("b") * c("b") + 8 * c("b") * F.pow(q, 4) + 1000 * c("b"))
    return s.agg(F.sum(z * z).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df")).withColumn("p", P.chi2_upper(c("chi2"), c("df")))


def levene(df: DataFrame, x: str, g: str) -> DataFrame:
    """Brown-Forsythe: analysis of variance of distances to the group's median."""
    m = quantiles(df, x, {"_m": 0.5}, [g]).withColumnRenamed(g, "_g")
    return anova(df.join(F.broadcast(m), c(g) == c("_g")).withColumn("_z", F.abs(c(x) - c("_m"))), "_z", g)


def bartlett(df: DataFrame, x: str, g: str) -> DataFrame:
    s = group_stats(df, x, g).filter("n > 1 AND var > 0")
    t = s.agg(F.sum(c("n") - 1).alias("v"), F.count(F.lit(1)).alias("k"), F.sum((c("n") - 1) * c("var")).alias("ss"), F.sum((c("n") - 1) * F.ln("var")).alias("l"), F.sum(1 / (c("n") - 1)).alias("r"), (F.max("var") / F.min("var")).alias("ratio"))
    stat = (c("v") * F.ln(c("ss") / c("v")) - c("l")) / (1 + (c("r") - 1 / c("v")) / (3 * (c("k") - 1)))
    return t.select(stat.alias("chi2"), (c("k") - 1).alias("df"), "ratio").withColumn("p", P.chi2_upper(c("chi2"), c("df")))


def contingency(df: DataFrame, a: str, b: str, w: str | None = None) -> DataFrame:
    """a, b, n, row_n, col_n, total, expected; missing cells are zeros."""
    t = df.groupBy(c(a).alias("a"), c(b).alias("b")).agg((F.sum(w) if w else F.count(F.lit(1))).alias("n"))
    t = t.select("a").distinct().crossJoin(t.select("b").distinct()).join(t, ["a", "b"], "left").fillna(0, ["n"])  # the two label lists
    rows, cols, all_ = Window.partitionBy("a"), Window.partitionBy("b"), Window.partitionBy(F.lit(0))
    t = t.withColumn("row_n", F.sum("n").over(rows)).withColumn("col_n", F.sum("n").over(cols)).withColumn("total", F.sum("n").over(all_))
    return t.withColumn("expected", c("row_n") * c("col_n") / c("total"))


def chi2_independence(cells: DataFrame) -> DataFrame:
    """chi2, df, cramer_v, low_share (cells expected under 5), p."""
    s = cells.agg(F.sum(F.pow(c("n") - c("expected"), 2) / c("expected")).alias("chi2"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"), F.max("total").alias("total"), F.avg((c("expected") < 5).cast("int")).alias("low_share"))
    s = s.withColumn("df", (c("r") - 1) * (c("k") - 1))
    return s.select("chi2", "df", F.sqrt(c("chi2") / (c("total") * (F.least("r", "k") - 1))).alias("cramer_v"), "low_share", P.chi2_upper(c("chi2"), c("df")).alias("p"))


def _ranked(df: DataFrame, x: str, g: str) -> DataFrame:
    counts = df.filter(c(x).isNotNull()).groupBy(c(g).alias("g"), c(x).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    ranks = average_ranks(df, x).select(c(x).alias("_v"), "rank", c("n").alias("ties"), "n_all")
    return counts.join(ranks, c("v") == c("_v"))


def mann_whitney(df: DataFrame, x: str, g: str, a: str, b: str, continuity: float = 0.5) -> DataFrame:
    """u, z (tie-corrected), p, p_greater = P(a > b) with ties half."""
    r = _ranked(df.filter(c(g).isin(a, b)), x, g)
    ties = r.groupBy("v").agg(F.max("ties").alias("t")).agg(F.sum(c("t") * c("t") * c("t") - c("t")).alias("ties"))
    s = r.agg(F.sum(F.when(c("g") == a, c("m"))).alias("na"), F.sum(F.when(c("g") == b, c("m"))).alias("nb"), F.sum(F.when(c("g") == a, c("m") * c("rank"))).alias("ra")).crossJoin(ties)
    s = s.withColumn("u", c("ra") - c("na") * (c("na") + 1) / 2).withColumn("n", (c("na") + c("nb")).cast("double"))
    sd = F.sqrt(c("na") * c("nb") / 12.0 * (c("n") + 1 - c("ties") / (c("n") * (c("n") - 1))))
    gap = c("u") - c("na") * c("nb") / 2
    return s.select("u", (F.signum(gap) * F.greatest(F.abs(gap) - continuity, F.lit(0.0)) / sd).alias("z"), (c("u") / (c("na") * c("nb"))).alias("p_greater")).withColumn("p", P.normal_two_sided(c("z")))


def kruskal_wallis(df: DataFrame, x: str, g: str) -> DataFrame:
    """h (tie-corrected), df, epsilon2, p."""
    r = _ranked(df, x, g)
    ties = r.groupBy("v").agg(F.max("ties").alias("t")).agg(F.sum(c("t") * c("t") * c("t") - c("t")).alias("ties"))
    k = r.groupBy("g").agg(F.sum("m").alias("n"), F.sum(c("m") * c("rank")).alias("r"))
    s = k.agg(F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(c("r") * c("r") / c("n")).alias("q")).crossJoin(ties)
    h = (12 / (c("n") * (c("n") + 1)) * c("q") - 3 * (c("n") + 1)) / (1 - c("ties") / (c("n") * c("n") * c("n") - c("n")))
    s = s.withColumn("h", h)
    return s.select("h", (c("k") - 1).alias("df"), F.greatest(F.lit(0.0), (c("h") - c("k") + 1) / (c("n") - c("k"))).alias("epsilon2")).withColumn("p", P.chi2_upper(c("h"), c("df")))


def wilcoxon_signed(df: DataFrame, diff: Column) -> DataFrame:
    """n, zeros, w_plus, w_minus, z (continuity 0.5), p."""
    d = df.select(diff.alias("d")).filter(c("d").isNotNull())
    zeros = d.agg(F.count_if(c("d") == 0).alias("zeros"))
    r = _ranked(d.filter("d <> 0").withColumn("ad", F.abs("d")).withColumn("s", F.when(c("d") > 0, "+").otherwise("-")), "ad", "s")
    ties = r.groupBy("v").agg(F.max("ties").cast("double").alias("t")).agg(F.sum(c("t") * c("t") * c("t") - c("t")).alias("ties"))
    s = r.agg(F.sum("m").cast("double").alias("n"), F.coalesce(F.sum(F.when(c("g") == "+", c("m") * c("rank"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(c("g") == "-", c("m") * c("rank"))), F.lit(0.0)).alias("w_minus")).crossJoin(ties).crossJoin(zeros)
    n = c("n")
    gap = c("w_plus") - n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - c("ties") / 48)
    return s.select(n.cast("long").alias("n"), "zeros", "w_plus", "w_minus", (F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)) / sd).alias("z")).withColumn("p", P.normal_two_sided(c("z")))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho, p: Pearson correlation of average ranks, and its t test."""
    d = df.filter(c(x).isNotNull() & c(y).isNotNull()).groupBy(c(x).alias("x"), c(y).alias("y")).agg(F.count(F.lit(1)).alias("m"))
    full = d.select(c("x"), c("y"), "m")
    rx = average_ranks(df, x).select(c(x).alias("_x"), c("rank").alias("rx"))
    ry = average_ranks(df, y).select(c(y).alias("_y"), c("rank").alias("ry"))
    j = full.join(rx, c("x") == c("_x")).join(ry, c("y") == c("_y"))
    m = c("m")
    s = j.agg(F.sum(m).cast("double").alias("n"), *[F.sum(m * e).alias(k) for k, e in (("a", c("rx")), ("b", c("ry")), ("ab", c("rx") * c("ry")), ("aa", c("rx") * c("rx")), ("bb", c("ry") * c("ry")))])
    n = c("n")
    s = s.withColumn("rho", (n * c("ab") - c("a") * c("b")) / F.sqrt((n * c("aa") - c("a") * c("a")) * (n * c("bb") - c("b") * c("b"))))
    return s.select("rho", P.t_two_sided(c("rho") * F.sqrt((n - 2) / (1 - c("rho") * c("rho"))), n - 2).alias("p"))


def ks_two_sample(df: DataFrame, x: str, g: str, a: str, b: str) -> DataFrame:
    """d: the largest gap between two distribution functions."""
    from .order import prefix_sums

    s = prefix_sums(df.filter(c(g).isin(a, b)), [], x, {"ka": (c(g) == a).cast("int"), "kb": (c(g) == b).cast("int")})
    return s.agg(F.max(F.abs((c("ka_before") + c("ka")) / c("ka_all") - (c("kb_before") + c("kb")) / c("kb_all"))).alias("d"))


def holm(pairs: DataFrame, p: str, order: list[str]) -> DataFrame:
    """p_holm: step-down adjusted p-values of a table of comparisons."""
    whole = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(whole.orderBy(p, *order))
    d = pairs.withColumn("_k", rank).withColumn("_m", F.count(F.lit(1)).over(whole)).withColumn("_a", F.least(F.lit(1.0), (c("_m") - c("_k") + 1) * c(p)))
    return d.withColumn("p_holm", F.max("_a").over(whole.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))).drop("_k", "_m", "_a")
