"""Intervals, tests, association and analysis of variance over orders as persons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions as P
from ..operators import compare as K
from ..operators import describe as D
from ..operators import order as O
from . import sqltext as Q
from .registry import ORACLES, PERSONS, persons, query, r, rounded

c = F.col
Z = 1.959963984540054
TWO = f"WITH {PERSONS}, s AS (SELECT count(*) FILTER (grp = '1-URGENT') AS na, avg(x) FILTER (grp = '1-URGENT') AS ma, var_samp(x) FILTER (grp = '1-URGENT') AS va, count(*) FILTER (grp = '5-LOW') AS nb, avg(x) FILTER (grp = '5-LOW') AS mb, var_samp(x) FILTER (grp = '5-LOW') AS vb FROM persons)"
AB = ("1-URGENT", "5-LOW")


def two(spark, d):
    return K.two_groups(persons(spark, d), "x", "grp", *AB)


@query("ci_mean", f"WITH {PERSONS} SELECT coalesce(grp, 'Total') AS grp, count(*) AS n, round(avg(x), 4) AS mean, round(avg(x) - {Z} * stddev_samp(x) / sqrt(count(*)), 4) AS low, round(avg(x) + {Z} * stddev_samp(x) / sqrt(count(*)), 4) AS high FROM persons GROUP BY GROUPING SETS ((), (grp))")
def _(spark, d):
    half = Z * F.stddev_samp("x") / F.sqrt(F.count("x"))
    return persons(spark, d).rollup("grp").agg(F.count("x").alias("n"), r(F.avg("x")).alias("mean"), r(F.avg("x") - half).alias("low"), r(F.avg("x") + half).alias("high")).withColumn("grp", F.coalesce("grp", F.lit("Total")))


@query("ci_mean_t", f"WITH RECURSIVE {PERSONS}, s AS (SELECT stratum, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM persons GROUP BY 1), {Q.bisected('tq', 's', ['stratum'], Q.t_two_sided('q', '(n - 1)') + ' <= 0.05', '0', '200')} SELECT stratum, n, round(m, 4) AS mean, round(m - q * sqrt(v / n), 4) AS low, round(m + q * sqrt(v / n), 4) AS high FROM s JOIN tq USING (stratum)")
def _(spark, d):
    """Intervals with the t quantile of each group's own degrees of freedom."""
    s = K.group_stats(persons(spark, d), "x", "stratum").withColumn("q", P.quantile(lambda q: P.t_two_sided(q, c("n") - 1), 0.05, 0, 200))
    half = c("q") * F.sqrt(c("var") / c("n"))
    return s.select("stratum", "n", r("mean").alias("mean"), r(c("mean") - half).alias("low"), r(c("mean") + half).alias("high"))


@query("ci_proportion", f"WITH {PERSONS}, t AS (SELECT status, CAST(count(*) AS DOUBLE) AS k, CAST(sum(count(*)) OVER () AS DOUBLE) AS n FROM persons GROUP BY 1), q AS (SELECT *, k / n AS p, {Z}::DOUBLE AS z FROM t) SELECT status, round(p, 6) AS p, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS wilson_low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS wilson_high, round(p - z * sqrt(p * (1 - p) / n), 6) AS wald_low, round(p + z * sqrt(p * (1 - p) / n), 6) AS wald_high FROM q")
def _(spark, d):
    t = persons(spark, d).groupBy("status").agg(F.count(F.lit(1)).cast("double").alias("k"))
    t = t.withColumn("n", F.sum("k").over(D.whole())).withColumn("p", c("k") / c("n"))
    n, p = c("n"), c("p")
    mid, half, den = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)), 1 + Z * Z / n
    wald = Z * F.sqrt(p * (1 - p) / n)
    return t.select("status", r("p", 6).alias("p"), r((mid - half) / den, 6).alias("wilson_low"), r((mid + half) / den, 6).alias("wilson_high"), r(p - wald, 6).alias("wald_low"), r(p + wald, 6).alias("wald_high"))


@query("ci_proportion_exact", f"WITH RECURSIVE {PERSONS}, s AS (SELECT status, count(*) AS k, CAST(sum(count(*)) OVER () AS BIGINT) AS n FROM persons GROUP BY 1), {Q.bisected('lo', 's', ['status'], Q.beta_lower('q', 'k', '(n - k + 1)') + ' >= 0.025', '0', 'CAST(k AS DOUBLE) / n')}, {Q.bisected('hi', 's', ['status'], Q.beta_lower('q', '(k + 1)', '(n - k)') + ' >= 0.975', 'CAST(k AS DOUBLE) / n', 'least(1, 1.5 * k / n + 0.01)')} SELECT status, round(lo.q, 6) AS low, round(hi.q, 6) AS high FROM lo JOIN hi USING (status)")
def _(spark, d):
    """Clopper-Pearson bounds by beta quantiles."""
    t = persons(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("k")).withColumn("n", F.sum("k").over(D.whole()))
    low = F.when(c("k") > 0, P.quantile(lambda q: 1 - P.beta_cdf(q, c("k"), c("n") - c("k") + 1), 0.975, 0, 1)).otherwise(0.0)
    high = F.when(c("k") < c("n"), P.quantile(lambda q: 1 - P.beta_cdf(q, c("k") + 1, c("n") - c("k")), 0.025, 0, 1)).otherwise(1.0)
    return t.select("status", r(low, 6).alias("low"), r(high, 6).alias("high"))


@query("ci_variance", f"WITH RECURSIVE {PERSONS}, s AS (SELECT grp, count(*) AS n, var_samp(x) AS v FROM persons GROUP BY 1), {Q.bisected('a', 's', ['grp'], Q.chi2_upper('q', '(n - 1)') + ' <= 0.025', '0', '2 * n + 50')}, {Q.bisected('b', 's', ['grp'], Q.chi2_upper('q', '(n - 1)') + ' <= 0.975', '0', '2 * n + 50')} SELECT grp, round(v, 4) AS var, round((n - 1) * v / a.q, 4) AS low, round((n - 1) * v / b.q, 4) AS high FROM s JOIN a USING (grp) JOIN b USING (grp)")
def _(spark, d):
    s = K.group_stats(persons(spark, d), "x", "grp")
    q = lambda tail: P.quantile(lambda x: P.chi2_upper(x, c("n") - 1), tail, 0, 2 * c("n") + 50)
    return s.select("grp", r("var").alias("var"), r((c("n") - 1) * c("var") / q(0.025)).alias("low"), r((c("n") - 1) * c("var") / q(0.975)).alias("high"))


PAIRS = f"WITH {PERSONS}, g AS (SELECT grp, count(*) AS n, avg(x) AS m, var_samp(x) AS v, CAST(count(*) FILTER (status = 'F') AS DOUBLE) / count(*) AS p FROM persons GROUP BY 1)"


def _pairs(spark, d):
    g = persons(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"), (F.count_if(c("status") == "F") / F.count(F.lit(1))).alias("p"))
    a, b = (g.select(*[c(k).alias(k + s) for k in g.columns]) for s in "ab")
    return a.join(b, c("grpa") < c("grpb"))


_DIFF = f"""{PAIRS.replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT a.grp AS a, b.grp AS b, a.m - b.m AS diff, sqrt(a.v / a.n + b.v / b.n) AS se, pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS df,
  sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS se_pooled, CAST(a.n + b.n - 2 AS BIGINT) AS df_pooled FROM g a JOIN g b ON a.grp < b.grp),
{Q.bisected('tq', 'e', ['a', 'b'], Q.t_two_sided('q', 'df') + ' <= 0.05', '0', '200')}, {Q.bisected('pq', 'e', ['a', 'b'], Q.t_two_sided('q', 'df_pooled') + ' <= 0.05', '0', '200')}
SELECT e.a, e.b, round(diff, 4) AS diff, round(se, 6) AS se, round(df, 4) AS df, round(diff - tq.q * se, 4) AS low, round(diff + tq.q * se, 4) AS high, round({Q.t_two_sided('(diff / se)', 'df')}, 6) AS p,
  round(se_pooled, 6) AS se_pooled, df_pooled, round(diff - pq.q * se_pooled, 4) AS low_pooled, round(diff + pq.q * se_pooled, 4) AS high_pooled, round({Q.t_two_sided('(diff / se_pooled)', 'df_pooled')}, 6) AS p_pooled
FROM e JOIN tq USING (a, b) JOIN pq USING (a, b)"""


@query("ci_diff_means", _DIFF)
def _(spark, d):
    """Intervals and p of the differences of all pairs of means, with each group's own variance and with a common one."""
    x, y = c("va") / c("na"), c("vb") / c("nb")
    e = _pairs(spark, d).withColumn("diff", c("ma") - c("mb")).withColumn("se", F.sqrt(x + y)).withColumn("df", (x + y) * (x + y) / (x * x / (c("na") - 1) + y * y / (c("nb") - 1))).withColumn("df_pooled", c("na") + c("nb") - 2)
    e = e.withColumn("se_pooled", F.sqrt(((c("na") - 1) * c("va") + (c("nb") - 1) * c("vb")) / c("df_pooled") * (1 / c("na") + 1 / c("nb"))))
    half = lambda se, df: c(se) * P.quantile(lambda q: P.t_two_sided(q, c(df)), 0.05, 0, 200)
    e = e.withColumn("half", half("se", "df")).withColumn("half_pooled", half("se_pooled", "df_pooled"))
    limits = lambda k: [r(c("diff") - c("half" + k)).alias("low" + k), r(c("diff") + c("half" + k)).alias("high" + k), r(P.t_two_sided(c("diff") / c("se" + k), c("df" + k)), 6).alias("p" + k)]
    return e.select(c("grpa").alias("a"), c("grpb").alias("b"), r("diff").alias("diff"), r("se", 6).alias("se"), r("df").alias("df"), *limits(""), r("se_pooled", 6).alias("se_pooled"), "df_pooled", *limits("_pooled"))


@query("ci_diff_proportions", f"{PAIRS} SELECT a.grp AS a, b.grp AS b, round(a.p - b.p - {Z} * sqrt(a.p * (1 - a.p) / a.n + b.p * (1 - b.p) / b.n), 6) AS low, round(a.p - b.p + {Z} * sqrt(a.p * (1 - a.p) / a.n + b.p * (1 - b.p) / b.n), 6) AS high FROM g a JOIN g b ON a.grp < b.grp")
def _(spark, d):
    half = Z * F.sqrt(c("pa") * (1 - c("pa")) / c("na") + c("pb") * (1 - c("pb")) / c("nb"))
    return _pairs(spark, d).select(c("grpa").alias("a"), c("grpb").alias("b"), r(c("pa") - c("pb") - half, 6).alias("low"), r(c("pa") - c("pb") + half, 6).alias("high"))


@query("separate_vs_difference", f"{PAIRS} SELECT a.grp AS a, b.grp AS b, abs(a.m - b.m) <= {Z} * (sqrt(a.v / a.n) + sqrt(b.v / b.n)) AS overlap, abs(a.m - b.m) > {Z} * sqrt(a.v / a.n + b.v / b.n) AS differ FROM g a JOIN g b ON a.grp < b.grp")
def _(spark, d):
    x, y, gap = c("va") / c("na"), c("vb") / c("nb"), F.abs(c("ma") - c("mb"))
    return _pairs(spark, d).select(c("grpa").alias("a"), c("grpb").alias("b"), (gap <= Z * (F.sqrt(x) + F.sqrt(y))).alias("overlap"), (gap > Z * F.sqrt(x + y)).alias("differ"))


@query("t_one_sample", f"WITH {PERSONS}, s AS (SELECT count(*) AS n, (avg(x) - 250) / (stddev_samp(x) / sqrt(count(*))) AS t, (avg(x) - 250) / stddev_samp(x) AS d FROM persons) SELECT n, round(t, 6) AS t, round(d, 6) AS d, round({Q.t_two_sided('t', '(n - 1)')}, 6) AS p FROM s")
def _(spark, d):
    s = persons(spark, d).agg(F.count("x").alias("n"), ((F.avg("x") - 250) / (F.stddev_samp("x") / F.sqrt(F.count("x")))).alias("t"), ((F.avg("x") - 250) / F.stddev_samp("x")).alias("d"))
    return s.select("n", r("t", 6).alias("t"), r("d", 6).alias("d"), r(P.t_two_sided(c("t"), c("n") - 1), 6).alias("p"))


@query("t_two_sample", f"{TWO}, e AS (SELECT *, va / na AS ea, vb / nb AS eb, ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) AS pv FROM s), k AS (SELECT *, (ma - mb) / sqrt(ea + eb) AS tw, (ea + eb) * (ea + eb) / (ea * ea / (na - 1) + eb * eb / (nb - 1)) AS dw, (ma - mb) / sqrt(pv * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)) AS tp FROM e) SELECT round(ma - mb, 6) AS diff, round(tw, 6) AS t_welch, round(dw, 4) AS df_welch, round({Q.t_two_sided('tw', 'dw')}, 6) AS p_welch, round(tp, 6) AS t_pooled, round({Q.t_two_sided('tp', '(na + nb - 2)')}, 6) AS p_pooled, round((ma - mb) / sqrt(pv), 6) AS d, round((ma - mb) / sqrt(pv) * (1 - 3.0::DOUBLE / (4 * (na + nb) - 9)), 6) AS g FROM k")
def _(spark, d):
    t = K.t_test(two(spark, d))
    return rounded(t.withColumn("p_pooled", P.t_two_sided(c("t_pooled"), c("na") + c("nb") - 2)), 6).select("diff", "t_welch", F.round("df_welch", 4).alias("df_welch"), "p_welch", "t_pooled", "p_pooled", "d", "g")


@query("with_p_values", f"SELECT test, round(stat, 6) AS stat, round(p, 6) AS p FROM (SELECT 'welch t' AS test, t_welch AS stat, p_welch AS p FROM ({{t_two_sample}}) UNION ALL SELECT 'anova', f, p FROM ({{anova_one_way}}) UNION ALL SELECT 'kruskal', h, p FROM ({{kruskal_wallis}}) UNION ALL SELECT 'mann-whitney', z, p FROM ({{mann_whitney}}) UNION ALL SELECT 'alexander-govern', chi2, p FROM ({{alexander_govern}}))")
def _(spark, d):
    """p-values of several tests from their statistics, by upper tails taken directly."""
    p = persons(spark, d)
    rows = [("welch t", K.t_test(two(spark, d)).select(c("t_welch").alias("stat"), c("p_welch").alias("p"))), ("anova", K.anova(p, "x", "grp").select(c("f").alias("stat"), "p")), ("kruskal", K.kruskal_wallis(p, "x", "grp").select(c("h").alias("stat"), "p")),
            ("mann-whitney", K.mann_whitney(p, "x", "grp", *AB).select(c("z").alias("stat"), "p")), ("alexander-govern", K.alexander_govern(p, "x", "grp").select(c("chi2").alias("stat"), "p"))]
    out = None
    for name, df in rows:
        one = df.select(F.lit(name).alias("test"), r("stat", 6).alias("stat"), r("p", 6).alias("p"))
        out = one if out is None else out.union(one)
    return out


@query("f_two_variances", f"{TWO}, k AS (SELECT va / vb AS f, na - 1 AS df1, nb - 1 AS df2 FROM s), u AS (SELECT *, {Q.f_upper('f', 'df1', 'df2')} AS up FROM k) SELECT round(f, 6) AS f, df1, df2, round(2 * least(up, 1 - up), 6) AS p FROM u")
def _(spark, d):
    t = two(spark, d).select((c("va") / c("vb")).alias("f"), (c("na") - 1).alias("df1"), (c("nb") - 1).alias("df2"))
    up, down = P.f_upper(c("f"), c("df1"), c("df2")), P.f_upper(1 / c("f"), c("df2"), c("df1"))
    return t.select(r("f", 6).alias("f"), "df1", "df2", r(2 * F.least(up, down), 6).alias("p"))


@query("z_one_proportion", f"WITH {PERSONS}, s AS (SELECT CAST(count(*) FILTER (status = 'F') AS DOUBLE) / count(*) AS p, count(*) AS n FROM persons) SELECT round((p - 0.5) / sqrt(0.25 / n), 6) AS z, round(2 * asin(sqrt(p)) - 2 * asin(sqrt(0.5)), 6) AS h, round({Q.normal_two_sided('(p - 0.5) / sqrt(0.25 / n)')}, 6) AS p_value FROM s")
def _(spark, d):
    s = persons(spark, d).agg((F.count_if(c("status") == "F") / F.count(F.lit(1))).alias("p"), F.count(F.lit(1)).alias("n"))
    return s.select(r((c("p") - 0.5) / F.sqrt(0.25 / c("n")), 6).alias("z"), r(2 * F.asin(F.sqrt("p")) - 2 * F.asin(F.sqrt(F.lit(0.5))), 6).alias("h"), r(P.normal_two_sided((c("p") - 0.5) / F.sqrt(0.25 / c("n"))), 6).alias("p_value"))


@query("z_two_proportions", f"{PAIRS}, k AS (SELECT a.grp AS a, b.grp AS b, a.p AS pa, b.p AS pb, (a.p - b.p) / sqrt((a.p * a.n + b.p * b.n) / (a.n + b.n) * (1 - (a.p * a.n + b.p * b.n) / (a.n + b.n)) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS z FROM g a JOIN g b ON a.grp < b.grp) SELECT a, b, round(z, 6) AS z, round(2 * asin(sqrt(pa)) - 2 * asin(sqrt(pb)), 6) AS h, round({Q.normal_two_sided('z')}, 6) AS p FROM k")
def _(spark, d):
    q = (c("pa") * c("na") + c("pb") * c("nb")) / (c("na") + c("nb"))
    t = _pairs(spark, d).withColumn("z", (c("pa") - c("pb")) / F.sqrt(q * (1 - q) * (1 / c("na") + 1 / c("nb"))))
    return t.select(c("grpa").alias("a"), c("grpb").alias("b"), r("z", 6).alias("z"), r(2 * F.asin(F.sqrt("pa")) - 2 * F.asin(F.sqrt("pb")), 6).alias("h"), r(P.normal_two_sided(c("z")), 6).alias("p"))


@query("normal_probability", f"WITH {PERSONS}, m AS (SELECT avg(x) AS m, stddev_samp(x) AS sd FROM persons), t AS (SELECT ceil(x / 50) * 50 AS b, count(*) AS n FROM persons GROUP BY 1), k AS (SELECT CAST(b AS DOUBLE) AS below, sum(n) OVER (ORDER BY b) / CAST(sum(n) OVER () AS DOUBLE) AS o FROM t) SELECT below, round(o, 6) AS observed, round({Q.normal_lower('(below - m) / sd')}, 6) AS normal FROM k, m")
def _(spark, d):
    """Share below each round amount under the fitted normal, beside the observed one."""
    p = persons(spark, d)
    s = F.broadcast(p.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")))
    t = O.prefix_sums(p.withColumn("b", F.ceil(c("x") / 50) * 50), [], "b", {"n": F.lit(1)}).crossJoin(s)
    return t.select(c("b").cast("double").alias("below"), r((c("n_before") + c("n")) / c("n_all"), 6).alias("observed"), r(1 - P.normal_upper((c("b") - c("m")) / c("sd")), 6).alias("normal"))


#: Power and the normal quantile that it asks for.
POWER = {"n_80": 0.8416212335729143, "n_90": 1.2815515655446004, "n_95": 1.6448536269514722}


@query("power_n", f"{PAIRS}, e AS (SELECT a.grp AS a, b.grp AS b, (a.m - b.m) / sqrt((a.v + b.v) / 2) AS d, a.n AS na, b.n AS nb FROM g a JOIN g b ON a.grp < b.grp) SELECT a, b, round(d, 6) AS d, " + ", ".join(f"CAST(ceil(2 * pow(({Z} + {z}) / d, 2)) AS BIGINT) AS {k}" for k, z in POWER.items()) + f", round({Q.normal_lower(f'(abs(d) / sqrt(1.0::DOUBLE / na + 1.0::DOUBLE / nb) - {Z})')}, 6) AS power FROM e")
def _(spark, d):
    """Rows a group that find each pair's difference with a chance of 80, 90 and 95 %, and the chance with the rows there are."""
    e = _pairs(spark, d).withColumn("d", (c("ma") - c("mb")) / F.sqrt((c("va") + c("vb")) / 2))
    power = 1 - P.normal_upper(F.abs("d") / F.sqrt(1 / c("na") + 1 / c("nb")) - Z)
    return e.select(c("grpa").alias("a"), c("grpb").alias("b"), r("d", 6).alias("d"), *[F.ceil(2 * F.pow((F.lit(Z) + z) / c("d"), 2)).alias(k) for k, z in POWER.items()], r(power, 6).alias("power"))


CELLS = "t AS (SELECT seg AS a, grp AS b, count(*) AS n FROM persons GROUP BY ALL), cells AS (SELECT *, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e, sum(n) OVER () AS total, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb FROM t)"


@query("contingency_table", f"WITH {PERSONS}, {CELLS} SELECT a, b, n, round(100.0::DOUBLE * n / ra, 4) AS row_pct, round(100.0::DOUBLE * n / cb, 4) AS col_pct, round(100.0::DOUBLE * n / total, 4) AS total_pct, round(e, 4) AS expected FROM cells")
def _(spark, d):
    t = K.contingency(persons(spark, d), "seg", "grp")
    return t.select("a", "b", "n", *[r(100.0 * c("n") / c(k)).alias(v) for k, v in (("row_n", "row_pct"), ("col_n", "col_pct"), ("total", "total_pct"))], r("expected").alias("expected"))


@query("chi2_independence", f"WITH {PERSONS}, {CELLS}, k AS (SELECT sum(pow(n - e, 2) / e) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, sqrt(sum(pow(n - e, 2) / e) / (max(total) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))) AS v, avg(CASE WHEN e < 5 THEN 1.0::DOUBLE ELSE 0 END) AS low FROM cells) SELECT round(chi2, 6) AS chi2, df, round(v, 6) AS cramer_v, round(low, 6) AS low_share, round({Q.chi2_upper('chi2', 'df')}, 6) AS p FROM k")
def _(spark, d):
    return rounded(K.chi2_independence(K.contingency(persons(spark, d), "seg", "grp")), 6)


@query("chi2_goodness", f"WITH {PERSONS}, t AS (SELECT grp, count(*) AS n FROM persons GROUP BY 1), e AS (SELECT avg(n) AS e FROM t), k AS (SELECT sum(pow(n - e, 2) / e) AS chi2, count(*) - 1 AS df FROM t, e) SELECT round(chi2, 6) AS chi2, df, round({Q.chi2_upper('chi2', 'df')}, 6) AS p FROM k")
def _(spark, d):
    t = persons(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumn("e", F.avg("n").over(D.whole()))
    t = t.agg(F.sum(F.pow(c("n") - c("e"), 2) / c("e")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))
    return t.select(r("chi2", 6).alias("chi2"), "df", r(P.chi2_upper(c("chi2"), c("df")), 6).alias("p"))


def fisher_exact(t):
    """p for one row of counts m1, m0 (rows of the table), n (first column) and k (their cell), as longs.

    Chances of the tables with these margins, at most min(n, m1) + 1 of them, are taken relative to the likeliest table,
    through log-gammas, so that nothing overflows; those no likelier than the one seen are summed, and the sum is divided
    by that of all. Ties allow for the rounding of log-gammas. Tables are made by the thousand in their own tasks.
    """
    lg = lambda v: F.reflect(F.lit("org.apache.commons.math3.special.Gamma"), F.lit("logGamma"), (v + 1).cast("double")).cast("double")
    m1, m0, n, hi = c("m1"), c("m0"), c("n"), F.least("n", "m1")
    log_chance = lambda i: -(lg(i) + lg(m1 - i) + lg(n - i) + lg(m0 - n + i))
    t = t.withColumn("top", log_chance(F.floor((n + 1.0) * (m1 + 1.0) / (m1 + m0 + 2.0)))).withColumn("seen", log_chance(c("k"))).withColumn("slack", F.greatest(F.lit(1e-7), 1e-15 * lg(m1 + m0)))
    x = t.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), n - m0), hi, F.lit(1000).cast("long")))).repartition("at")
    x = x.withColumn("i", F.explode(F.sequence("at", F.least(c("at") + 999, hi)))).withColumn("l", log_chance(c("i")))
    w = F.exp(c("l") - c("top"))
    return x.agg((F.sum(F.when(c("l") <= c("seen") + c("slack"), w)) / F.sum(w)).alias("p"))


@query("fisher_2x2", f"WITH {PERSONS}, t AS (SELECT count(*) FILTER (status = 'F') AS m1, count(*) FILTER (status <> 'F') AS m0, count(*) FILTER (status = 'F' AND w > 4) AS k, count(*) FILTER (w > 4) AS n FROM persons), i AS (SELECT *, unnest(generate_series(greatest(0, n - m0), least(n, m1))) AS i FROM t), l AS (SELECT i, k, lgamma(m1 + 1) + lgamma(m0 + 1) + lgamma(n + 1) + lgamma(m1 + m0 - n + 1) - lgamma(m1 + m0 + 1) - lgamma(i + 1) - lgamma(m1 - i + 1) - lgamma(n - i + 1) - lgamma(m0 - n + i + 1) AS l FROM i) SELECT round(sum(exp(l)) FILTER (l <= (SELECT l FROM l WHERE i = k) + 1e-7), 8) AS p FROM l")
def _(spark, d):
    """Two-sided exact p of a 2 x 2 table of all persons: the sum of the chances of all tables no likelier than the one seen."""
    yes, own = c("status") == "F", c("w") > 4
    t = persons(spark, d).agg(F.count_if(yes).alias("m1"), F.count_if(~yes).alias("m0"), F.count_if(yes & own).alias("k"), F.count_if(own).alias("n"))
    return fisher_exact(t).select(r("p", 8).alias("p"))


RISK = "t AS (SELECT count(*) FILTER (w > 4 AND status = 'F') AS a, count(*) FILTER (w > 4) AS na, count(*) FILTER (w <= 4 AND status = 'F') AS b, count(*) FILTER (w <= 4) AS nb FROM persons), u AS (SELECT CAST(a AS DOUBLE) / na AS ra, CAST(b AS DOUBLE) / nb AS rb FROM t)"


@query("risk_measures", f"WITH {PERSONS}, {RISK} SELECT round(ra, 6) AS risk_a, round(rb, 6) AS risk_b, round(ra - rb, 6) AS difference, round(ra / rb, 6) AS relative, round(ra / (1 - ra) / (rb / (1 - rb)), 6) AS odds_ratio FROM u")
def _(spark, d):
    t = persons(spark, d).agg((F.count_if((c("w") > 4) & (c("status") == "F")) / F.count_if(c("w") > 4)).alias("a"), (F.count_if((c("w") <= 4) & (c("status") == "F")) / F.count_if(c("w") <= 4)).alias("b"))
    a, b = c("a"), c("b")
    return t.select(r(a, 6).alias("risk_a"), r(b, 6).alias("risk_b"), r(a - b, 6).alias("difference"), r(a / b, 6).alias("relative"), r(a / (1 - a) / (b / (1 - b)), 6).alias("odds_ratio"))


JOINT = "t AS (SELECT seg AS a, status AS b, CAST(sum(w) AS DOUBLE) AS n FROM persons GROUP BY ALL), j AS (SELECT a, b, n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM t)"


@query("joint_marginal_conditional", f"WITH {PERSONS}, {JOINT} SELECT a, b, round(p, 6) AS joint, round(pa, 6) AS marginal_a, round(pb, 6) AS marginal_b, round(p / pa, 6) AS b_given_a, round(p / pb, 6) AS a_given_b, round(pa * pb, 6) AS independent, round(pa + pb - p, 6) AS either FROM j")
def _(spark, d):
    t = K.contingency(persons(spark, d), "seg", "status", "w")
    p, pa, pb = c("n") / c("total"), c("row_n") / c("total"), c("col_n") / c("total")
    return t.select("a", "b", r(p, 6).alias("joint"), r(pa, 6).alias("marginal_a"), r(pb, 6).alias("marginal_b"), r(p / pa, 6).alias("b_given_a"), r(p / pb, 6).alias("a_given_b"), r(pa * pb, 6).alias("independent"), r(pa + pb - p, 6).alias("either"))


@query("diagnostic_measures", f"WITH {PERSONS}, t AS (SELECT CAST(count(*) FILTER (x > 250 AND status = 'F') AS DOUBLE) AS tp, count(*) FILTER (x > 250 AND status <> 'F') AS fp, count(*) FILTER (x <= 250 AND status = 'F') AS fn, count(*) FILTER (x <= 250 AND status <> 'F') AS tn FROM persons) SELECT round((tp + fn) / (tp + fp + fn + tn), 6) AS prevalence, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp + 0.0::DOUBLE), 6) AS specificity, round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn + 0.0::DOUBLE), 6) AS npv FROM t")
def _(spark, d):
    y, hit = c("status") == "F", c("x") > 250
    t = persons(spark, d).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (c(k) for k in ("tp", "fp", "fn", "tn"))
    return t.select(r((tp + fn) / (tp + fp + fn + tn), 6).alias("prevalence"), r(tp / (tp + fn), 6).alias("sensitivity"), r(tn / (tn + fp), 6).alias("specificity"), r(tp / (tp + fp), 6).alias("ppv"), r(tn / (tn + fn), 6).alias("npv"))


@query("bayes_total_probability", f"WITH {PERSONS}, t AS (SELECT seg, CAST(sum(w) AS DOUBLE) AS n, CAST(sum(w) FILTER (status = 'F') AS DOUBLE) / sum(w) AS rate FROM persons GROUP BY 1), p AS (SELECT seg, n / sum(n) OVER () AS prior, rate FROM t) SELECT seg, round(prior, 6) AS prior, round(rate, 6) AS rate, round(sum(prior * rate) OVER (), 6) AS total, round(prior * rate / sum(prior * rate) OVER (), 6) AS posterior FROM p")
def _(spark, d):
    t = persons(spark, d).groupBy("seg").agg(F.sum("w").alias("n"), (F.sum(F.when(c("status") == "F", c("w"))) / F.sum("w")).alias("rate"))
    t = t.withColumn("prior", c("n") / F.sum("n").over(D.whole())).withColumn("total", F.sum(c("prior") * c("rate")).over(D.whole()))
    return t.select("seg", *[r(k, 6).alias(k) for k in ("prior", "rate", "total")], r(c("prior") * c("rate") / c("total"), 6).alias("posterior"))


@query("simpson_check", f"WITH {PERSONS}, t AS (SELECT seg, avg(x) FILTER (w > 4) - avg(x) FILTER (w <= 4) AS diff FROM persons GROUP BY GROUPING SETS ((), (seg))) SELECT round(max(diff) FILTER (seg IS NULL), 4) AS overall, round(min(diff) FILTER (seg IS NOT NULL), 4) AS low, round(max(diff) FILTER (seg IS NOT NULL), 4) AS high, coalesce(bool_and(sign(diff) <> (SELECT sign(diff) FROM t WHERE seg IS NULL)) FILTER (seg IS NOT NULL), false) AS reversed FROM t")
def _(spark, d):
    diff = F.avg(F.when(c("w") > 4, c("x"))) - F.avg(F.when(c("w") <= 4, c("x")))
    t = persons(spark, d).rollup("seg").agg(diff.alias("diff")).withColumn("overall", F.max(F.when(c("seg").isNull(), c("diff"))).over(D.whole()))
    own = c("seg").isNotNull()
    return t.agg(r(F.max("overall")).alias("overall"), r(F.min(F.when(own, c("diff")))).alias("low"), r(F.max(F.when(own, c("diff")))).alias("high"), F.bool_and(F.when(own, F.signum("diff") != F.signum("overall"))).alias("reversed"))


@query("shape_normality", f"WITH {PERSONS}, m AS (SELECT avg(x) AS m, stddev_pop(x) AS s, avg(ln(x)) AS lm, stddev_pop(ln(x)) AS ls FROM persons) SELECT round(avg(pow((x - m) / s, 3)), 6) AS skew, round(avg(pow((x - m) / s, 4)) - 3, 6) AS kurtosis, round(avg(pow((ln(x) - lm) / ls, 3)), 6) AS log_skew FROM persons, m")
def _(spark, d):
    p = persons(spark, d).withColumn("lx", F.ln("x"))
    m = F.broadcast(p.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.avg("lx").alias("lm"), F.stddev_pop("lx").alias("ls")))
    z, lz = (c("x") - c("m")) / c("s"), (c("lx") - c("lm")) / c("ls")
    return p.crossJoin(m).agg(r(F.avg(F.pow(z, 3)), 6).alias("skew"), r(F.avg(F.pow(z, 4)) - 3, 6).alias("kurtosis"), r(F.avg(F.pow(lz, 3)), 6).alias("log_skew"))


@query("ks_two_sample", f"WITH {PERSONS}, t AS (SELECT x, count(*) FILTER (grp = '1-URGENT') AS a, count(*) FILTER (grp = '5-LOW') AS b FROM persons WHERE grp IN ('1-URGENT', '5-LOW') GROUP BY x), s AS (SELECT sum(a) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) / CAST(sum(a) OVER () AS DOUBLE) AS fa, sum(b) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) / CAST(sum(b) OVER () AS DOUBLE) AS fb FROM t) SELECT round(max(abs(fa - fb)), 6) AS d FROM s")
def _(spark, d):
    return rounded(K.ks_two_sample(persons(spark, d), "x", "grp", *AB), 6)


@query("ks_one_sample_normal", f"WITH {PERSONS}, m AS (SELECT avg(x) AS m, stddev_samp(x) AS sd FROM persons), t AS (SELECT x, count(*) AS n FROM persons GROUP BY x), k AS (SELECT x, n, CAST(sum(n) OVER (ORDER BY x) AS DOUBLE) AS upto, sum(n) OVER () AS total FROM t), f AS (SELECT n, upto, total, {Q.normal_lower('((x - m) / sd)')} AS f FROM k, m) SELECT round(max(greatest(abs(f - (upto - n) / total), abs(f - upto / total))), 6) AS d FROM f")
def _(spark, d):
    """d: the largest gap to the fitted normal."""
    p = persons(spark, d)
    m = F.broadcast(p.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")))
    s = O.prefix_sums(p, [], "x", {"n": F.lit(1)}).crossJoin(m).withColumn("f", 1 - P.normal_upper((c("x") - c("m")) / c("sd")))
    return s.agg(r(F.max(F.greatest(F.abs(c("f") - c("n_before") / c("n_all")), F.abs(c("f") - (c("n_before") + c("n")) / c("n_all")))), 6).alias("d"))


@query("lognormal_fit", f"WITH {PERSONS}, m AS (SELECT sum(w * ln(x)) / sum(w) AS mu, sqrt(sum(w * ln(x) * ln(x)) / sum(w) - pow(sum(w * ln(x)) / sum(w), 2)) AS s FROM persons WHERE x > 0) SELECT round(mu, 6) AS mu, round(s, 6) AS sigma, round(exp(mu + s * s / 2), 4) AS mean, round(exp(mu), 4) AS median, round(exp(mu - s * s), 4) AS mode, round(sqrt(exp(s * s) - 1), 6) AS cv, round((exp(s * s) + 2) * sqrt(exp(s * s) - 1), 6) AS skew FROM m")
def _(spark, d):
    lx, w = F.ln("x"), c("w")
    m = persons(spark, d).filter("x > 0").agg((F.sum(w * lx) / F.sum(w)).alias("mu"), (F.sum(w * lx * lx) / F.sum(w)).alias("q")).withColumn("s", F.sqrt(c("q") - c("mu") * c("mu")))
    mu, s = c("mu"), c("s")
    return m.select(r(mu, 6).alias("mu"), r(s, 6).alias("sigma"), r(F.exp(mu + s * s / 2)).alias("mean"), r(F.exp(mu)).alias("median"), r(F.exp(mu - s * s)).alias("mode"), r(F.sqrt(F.exp(s * s) - 1), 6).alias("cv"), r((F.exp(s * s) + 2) * F.sqrt(F.exp(s * s) - 1), 6).alias("skew"))


SHARES = {0.01: -2.3263478740408408, 0.05: -1.6448536269514722, 0.1: -1.2815515655446004, 0.25: -0.6744897501960817, 0.5: 0.0, 0.75: 0.6744897501960817, 0.9: 1.2815515655446004, 0.95: 1.6448536269514722, 0.99: 2.3263478740408408}


@query("lognormal_quantiles", f"WITH {PERSONS}, m AS (SELECT sum(w * ln(x)) / sum(w) AS mu, sqrt(sum(w * ln(x) * ln(x)) / sum(w) - pow(sum(w * ln(x)) / sum(w), 2)) AS s, sum(w * x) / sum(w) AS mean, sqrt(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2)) AS sd FROM persons WHERE x > 0), k AS (SELECT x, sum(w) OVER (ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER () AS total FROM persons WHERE x > 0), o AS (SELECT p, z, min(x) AS seen FROM k, (VALUES {', '.join(f'({p}::DOUBLE, {z}::DOUBLE)' for p, z in SHARES.items())}) t(p, z) WHERE cum >= p * total GROUP BY ALL) SELECT p, round(seen, 4) AS observed, round(exp(mu + z * s), 4) AS lognormal, round(mean + z * sd, 4) AS normal, round(exp(mu + z * s) / seen - 1, 6) AS gap_lognormal, round((mean + z * sd) / seen - 1, 6) AS gap_normal FROM o, m")
def _(spark, d):
    """Weighted quantiles beside those of the fitted lognormal and of a normal with the same mean and deviation."""
    p, w = persons(spark, d).filter("x > 0"), c("w")
    lx = F.ln("x")
    m = p.agg((F.sum(w * lx) / F.sum(w)).alias("mu"), (F.sum(w * lx * lx) / F.sum(w)).alias("ql"), (F.sum(w * c("x")) / F.sum(w)).alias("mean"), (F.sum(w * c("x") * c("x")) / F.sum(w)).alias("qx"))
    seen = O.quantiles_step(p, "x", "w", list(SHARES))
    z = F.create_map(*[F.lit(v) for pair in SHARES.items() for v in pair])[c("p")]
    log, flat = F.exp(c("mu") + z * F.sqrt(c("ql") - c("mu") * c("mu"))), c("mean") + z * F.sqrt(c("qx") - c("mean") * c("mean"))
    return seen.crossJoin(F.broadcast(m)).select("p", r("q").alias("observed"), r(log).alias("lognormal"), r(flat).alias("normal"), r(log / c("q") - 1, 6).alias("gap_lognormal"), r(flat / c("q") - 1, 6).alias("gap_normal"))


def anova_sql(source: str, x: str, g: str) -> str:
    return f"s AS (SELECT {g} AS g, count(*) AS n, avg({x}) AS m, var_samp({x}) AS v FROM {source} GROUP BY 1), a AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS sb, sum((n - 1) * v) AS sw FROM s)"


AOV = "round(sb, 4) AS ss_between, round(sw, 2) AS ss_within, k - 1 AS df1, CAST(nn - k AS BIGINT) AS df2, round(sb / (k - 1) / (sw / (nn - k)), 6) AS f, round(sb / (sb + sw), 6) AS eta2, round((sb - (k - 1) * sw / (nn - k)) / (sb + sw + sw / (nn - k)), 6) AS omega2, round(" + Q.f_upper("(sb / (k - 1) / (sw / (nn - k)))", "(k - 1)", "(nn - k)") + ", 6) AS p"


def _aov(df):
    return df.select(r("ss_between").alias("ss_between"), r("ss_within", 2).alias("ss_within"), "df1", c("df2").cast("long").alias("df2"), r("f", 6).alias("f"), r("eta2", 6).alias("eta2"), r("omega2", 6).alias("omega2"), r("p", 6).alias("p"))


@query("anova_one_way", f"WITH {PERSONS}, {anova_sql('persons', 'x', 'grp')} SELECT {AOV} FROM a")
def _(spark, d):
    return _aov(K.anova(persons(spark, d), "x", "grp"))


@query("levene_bf", f"WITH {PERSONS}, q AS (SELECT grp, quantile_cont(x, 0.5) AS med FROM persons GROUP BY 1), z AS (SELECT persons.grp, abs(x - med) AS z FROM persons JOIN q USING (grp)), {anova_sql('z', 'z', 'grp')} SELECT {AOV} FROM a")
def _(spark, d):
    return _aov(K.levene(persons(spark, d), "x", "grp"))


@query("welch_anova", f"WITH {PERSONS}, s AS (SELECT grp, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM persons GROUP BY 1), w AS (SELECT *, n / v AS w, sum(n / v) OVER () AS sw, sum(n / v * m) OVER () / sum(n / v) OVER () AS g FROM s), t AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(w * pow(m - g, 2)) AS a, sum(pow(1 - w / sw, 2) / (n - 1)) AS b FROM w), h AS (SELECT a / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * b) AS f, k - 1 AS df1, (k * k - 1) / (3 * b) AS df2 FROM t) SELECT round(f, 6) AS f, CAST(df1 AS BIGINT) AS df1, round(df2, 4) AS df2, round({Q.f_upper('f', 'df1', 'df2')}, 6) AS p FROM h")
def _(spark, d):
    return K.welch_anova(persons(spark, d), "x", "grp").select(r("f", 6).alias("f"), "df1", r("df2").alias("df2"), r("p", 6).alias("p"))


@query("alexander_govern", f"WITH {PERSONS}, s AS (SELECT grp, CAST(count(*) AS DOUBLE) AS n, avg(x) AS m, var_samp(x) AS v FROM persons GROUP BY 1), g AS (SELECT *, sum(n / v * m) OVER () / sum(n / v) OVER () AS grand FROM s), t AS (SELECT n - 1.5 AS a, (m - grand) / sqrt(v / n) AS t, n - 1 AS v FROM g), q AS (SELECT 48 * a * a AS b, sqrt(a * ln(1 + t * t / v)) AS q FROM t), z AS (SELECT q + (q ** 3 + 3 * q) / b - (4 * q ** 7 + 33 * q ** 5 + 240 * q ** 3 + 855 * q) / (10 * b * b + 8 * b * q ** 4 + 1000 * b) AS z FROM q), k AS (SELECT sum(z * z) AS chi2, count(*) - 1 AS df FROM z) SELECT round(chi2, 6) AS chi2, df, round({Q.chi2_upper('chi2', 'df')}, 6) AS p FROM k")
def _(spark, d):
    return rounded(K.alexander_govern(persons(spark, d), "x", "grp"), 6)


@query("bartlett", f"WITH {PERSONS}, s AS (SELECT grp, count(*) AS n, var_samp(x) AS v FROM persons GROUP BY 1), t AS (SELECT sum(n - 1) AS v, count(*) AS k, sum((n - 1) * v) AS ss, sum((n - 1) * ln(v)) AS l, sum(1.0::DOUBLE / (n - 1)) AS rr, max(v) / min(v) AS ratio FROM s), h AS (SELECT (v * ln(ss / v) - l) / (1 + (rr - 1.0::DOUBLE / v) / (3 * (k - 1))) AS chi2, k - 1 AS df, ratio FROM t) SELECT round(chi2, 6) AS chi2, df, round(ratio, 6) AS ratio, round({Q.chi2_upper('chi2', 'df')}, 6) AS p FROM h")
def _(spark, d):
    return rounded(K.bartlett(persons(spark, d), "x", "grp"), 6)


@query("variance_ratio", f"WITH {PERSONS}, s AS (SELECT seg, var_samp(x) AS v FROM persons GROUP BY 1) SELECT round(max(v) / min(v), 6) AS ratio FROM s")
def _(spark, d):
    return K.group_stats(persons(spark, d), "x", "seg").agg(r(F.max("var") / F.min("var"), 6).alias("ratio"))


@query("simple_effects", f"WITH {PERSONS}, s AS (SELECT seg, grp, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM persons GROUP BY ALL), e AS (SELECT sum((n - 1) * v) / sum(n - 1) AS mse, CAST(sum(n - 1) AS BIGINT) AS dfe FROM s), k AS (SELECT seg, (sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (SELECT mse FROM e) AS f, count(*) - 1 AS df1, (SELECT dfe FROM e) AS df2 FROM s GROUP BY seg) SELECT seg, round(f, 6) AS f, df1, df2, round({Q.f_upper('f', 'df1', 'df2')}, 6) AS p FROM k")
def _(spark, d):
    s = persons(spark, d).groupBy("seg", "grp").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    s = s.withColumn("df2", F.sum(c("n") - 1).over(D.whole())).withColumn("mse", F.sum((c("n") - 1) * c("v")).over(D.whole()) / c("df2"))
    s = s.groupBy("seg", "mse", "df2").agg(F.sum(c("n") * c("m") * c("m")).alias("q"), F.sum(c("n") * c("m")).alias("t"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    s = s.withColumn("f", (c("q") - c("t") * c("t") / c("n")) / (c("k") - 1) / c("mse")).withColumn("df1", c("k") - 1)
    return s.select("seg", r("f", 6).alias("f"), "df1", "df2", r(P.f_upper(c("f"), c("df1"), c("df2")), 6).alias("p"))


POST = f"WITH {PERSONS}, s AS (SELECT grp, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM persons GROUP BY 1), e AS (SELECT sum((n - 1) * v) / sum(n - 1) AS mse FROM s)"


def _posthoc(spark, d):
    s = K.group_stats(persons(spark, d), "x", "grp")
    s = s.withColumn("mse", F.sum((c("n") - 1) * c("var")).over(D.whole()) / F.sum(c("n") - 1).over(D.whole())).withColumn("dfe", F.sum(c("n") - 1).over(D.whole())).withColumn("k", F.count(F.lit(1)).over(D.whole()))
    a, b = s.select(c("grp").alias("a"), c("n").alias("na"), c("mean").alias("ma"), "mse", "dfe", "k"), s.select(c("grp").alias("b"), c("n").alias("nb"), c("mean").alias("mb"))
    return a.join(b, c("a") < c("b")).withColumn("diff", c("ma") - c("mb")).withColumn("t", c("diff") / F.sqrt(c("mse") * (1 / c("na") + 1 / c("nb"))))


def _adjusted(p):
    """Pairs with raw, Bonferroni, Scheffe and Holm p-values."""
    p = p.withColumn("raw", P.t_two_sided(c("t"), c("dfe"))).withColumn("bonferroni", F.least(F.lit(1.0), c("k") * (c("k") - 1) / 2 * c("raw")))
    return K.holm(p.withColumn("scheffe", P.f_upper(c("t") * c("t") / (c("k") - 1), c("k") - 1, c("dfe"))), "raw", ["a", "b"])


@query("posthoc_pairs", f"{POST}, f AS (SELECT mse, (SELECT sum(n - 1) FROM s) AS dfe, (SELECT count(*) FROM s) AS k FROM e), t AS (SELECT a.grp AS a, b.grp AS b, a.m - b.m AS diff, (a.m - b.m) / sqrt(mse * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS t, dfe, k, k * (k - 1) / 2 AS m FROM s a JOIN s b ON a.grp < b.grp, f), p AS (SELECT *, {Q.t_two_sided('t', 'dfe')} AS raw, {Q.f_upper('(t * t / (k - 1))', '(k - 1)', 'dfe')} AS scheffe FROM t), h AS (SELECT *, row_number() OVER (ORDER BY raw, a, b) AS i FROM p), w AS (SELECT *, max(least(1, (m - i + 1) * raw)) OVER (ORDER BY i) AS holm FROM h) SELECT a, b, round(diff, 4) AS diff, round(t, 6) AS t, round(abs(t) * sqrt(2), 6) AS q, round(raw, 6) AS raw, round(least(1, m * raw), 6) AS bonferroni, round(holm, 6) AS p_holm, round(scheffe, 6) AS scheffe FROM w")
def _(spark, d):
    p = _adjusted(_posthoc(spark, d))
    return p.select("a", "b", r("diff").alias("diff"), r("t", 6).alias("t"), r(F.abs("t") * F.sqrt(F.lit(2.0)), 6).alias("q"), *[r(k, 6).alias(k) for k in ("raw", "bonferroni", "p_holm", "scheffe")])


@query("posthoc_adjusted")
def _(spark, d):
    """raw, Bonferroni, Holm, Scheffe and Tukey p-values of each pair, and whether they disagree at 0.05."""
    tukey = F.udf(lambda t, k, v: max(0.0, 1 - P.studentized_range_cdf(abs(t) * 2**0.5, int(k), float(v))), "double")  # ten pairs
    p = _adjusted(_posthoc(spark, d)).withColumn("tukey", tukey("t", "k", "dfe"))
    five = [c(k) < 0.05 for k in ("raw", "bonferroni", "p_holm", "scheffe", "tukey")]
    return p.select("a", "b", *[r(k, 6).alias(k) for k in ("raw", "bonferroni", "p_holm", "scheffe", "tukey")], (F.least(*[x.cast("int") for x in five]) != F.greatest(*[x.cast("int") for x in five])).alias("disagree"))


RANK = "rk AS (SELECT {cols}, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY x) AS ties FROM {src})"
TIES = "(SELECT sum(CAST(t AS DOUBLE) * t * t - t) FROM (SELECT count(*) AS t FROM {src} GROUP BY x))"


@query("mann_whitney", f"WITH {PERSONS}, q AS (SELECT grp, x FROM persons WHERE grp IN ('1-URGENT', '5-LOW')), {RANK.format(cols='grp, x', src='q')}, s AS (SELECT count(*) FILTER (grp = '1-URGENT') AS na, CAST(count(*) FILTER (grp = '5-LOW') AS DOUBLE) AS nb, sum(rk) FILTER (grp = '1-URGENT') AS ra, {TIES.format(src='q')} AS ties FROM rk), u AS (SELECT *, ra - na * (na + 1) / 2.0::DOUBLE AS u, na + nb AS n FROM s), z AS (SELECT u, na * nb AS m, sign(u - na * nb / 2) * greatest(abs(u - na * nb / 2) - 0.5, 0) / sqrt(na * nb / 12.0::DOUBLE * (n + 1 - ties / (n * (n - 1)))) AS z FROM u) SELECT u, round(z, 6) AS z, round(u / m, 6) AS p_greater, round({Q.normal_two_sided('z')}, 6) AS p FROM z")
def _(spark, d):
    return rounded(K.mann_whitney(persons(spark, d), "x", "grp", *AB), 6).withColumn("u", c("u").cast("double"))


@query("kruskal_wallis", f"WITH {PERSONS}, q AS (SELECT grp, x FROM persons), {RANK.format(cols='grp, x', src='q')}, k AS (SELECT grp, count(*) AS n, sum(rk) AS r FROM rk GROUP BY 1), s AS (SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS k, sum(r * r / n) AS q, {TIES.format(src='q')} AS ties FROM k), h AS (SELECT *, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM s) SELECT round(h, 6) AS h, k - 1 AS df, round(greatest(0, (h - k + 1) / (n - k)), 6) AS epsilon2, round({Q.chi2_upper('h', '(k - 1)')}, 6) AS p FROM h")
def _(spark, d):
    return rounded(K.kruskal_wallis(persons(spark, d), "x", "grp"), 6)


PAIRED = "y AS (SELECT psu, round(avg(x) FILTER (year(day) = 1996) - avg(x) FILTER (year(day) = 1997), 6) AS d FROM persons GROUP BY psu HAVING d IS NOT NULL)"


def paired(spark, d):
    """psu, d, a, b: the difference of two years' means of a dwelling, and both.

    A sum of numbers depends on their order, and a mean of four may lie half way between two sixth decimals; so rows are
    summed in the order of their ids, wherever they come from, and d is the same in every run.
    """
    y = F.year("day")
    return persons(spark, d).select("psu", "id", "day", "x").repartition("psu").sortWithinPartitions("psu", "id").groupBy("psu").agg(F.round(F.avg(F.when(y == 1996, c("x"))) - F.avg(F.when(y == 1997, c("x"))), 6).alias("d"), F.avg(F.when(y == 1996, c("x"))).alias("a"), F.avg(F.when(y == 1997, c("x"))).alias("b")).filter("d IS NOT NULL")


@query("wilcoxon_signed", f"WITH {PERSONS}, {PAIRED}, q AS (SELECT abs(d) AS x, d > 0 AS up FROM y WHERE d <> 0), {RANK.format(cols='up, x', src='q')}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(rk) FILTER (up) AS wp, sum(rk) FILTER (NOT up) AS wm, {TIES.format(src='q')} AS ties FROM rk) SELECT n, zeros, w_plus, w_minus, round(z, 6) AS z, round({Q.normal_two_sided('z')}, 6) AS p FROM (SELECT CAST(n AS BIGINT) AS n, (SELECT count(*) FROM y WHERE d = 0) AS zeros, wp AS w_plus, wm AS w_minus, sign(wp - n * (n + 1) / 4) * greatest(abs(wp - n * (n + 1) / 4) - 0.5, 0) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s)")
def _(spark, d):
    return rounded(K.wilcoxon_signed(paired(spark, d), c("d")), 6).withColumns({k: c(k).cast("double") for k in ("w_plus", "w_minus")})


@query("sign_test", f"WITH {PERSONS}, {PAIRED}, k AS (SELECT count(*) FILTER (d > 0) AS ups, count(*) FILTER (d < 0) AS downs FROM y) SELECT ups, downs, round(least(1, 2 * list_sum(list_transform(generate_series(0, least(ups, downs)), lambda i: exp(lgamma(ups + downs + 1) - lgamma(i + 1) - lgamma(ups + downs - i + 1) - (ups + downs) * ln(2))))), 6) AS p FROM k")
def _(spark, d):
    k = paired(spark, d).agg(F.count_if(c("d") > 0).alias("ups"), F.count_if(c("d") < 0).alias("downs"))
    return k.withColumn("p", r(F.least(F.lit(1.0), 2 * P.binomial_lower(F.least("ups", "downs"), c("ups") + c("downs"), F.lit(0.5))), 6))


@query("paired_vs_independent", f"WITH {PERSONS}, p AS (SELECT psu, avg(x) FILTER (year(day) = 1996) AS a, avg(x) FILTER (year(day) = 1997) AS b FROM persons GROUP BY psu HAVING a IS NOT NULL AND b IS NOT NULL), k AS (SELECT count(*) AS n, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS tp, (avg(a) - avg(b)) / sqrt(var_samp(a) / count(*) + var_samp(b) / count(*)) AS ti FROM p) SELECT round(tp, 6) AS t_paired, round({Q.t_two_sided('tp', '(n - 1)')}, 6) AS p_paired, round(ti, 6) AS t_independent, round({Q.t_two_sided('ti', '(2 * n - 2)')}, 6) AS p_independent FROM k")
def _(spark, d):
    n, e = F.count(F.lit(1)), c("a") - c("b")
    k = paired(spark, d).agg(n.alias("n"), (F.avg(e) / (F.stddev_samp(e) / F.sqrt(n))).alias("tp"), ((F.avg("a") - F.avg("b")) / F.sqrt(F.var_samp("a") / n + F.var_samp("b") / n)).alias("ti"))
    return k.select(r("tp", 6).alias("t_paired"), r(P.t_two_sided(c("tp"), c("n") - 1), 6).alias("p_paired"), r("ti", 6).alias("t_independent"), r(P.t_two_sided(c("ti"), 2 * c("n") - 2), 6).alias("p_independent"))


@query("pair_association", f"WITH {PERSONS} SELECT seg, round(covar_samp(x, age), 4) AS cov, round(corr(x, age), 6) AS r, round(regr_slope(x, age), 6) AS slope, round(regr_intercept(x, age), 4) AS intercept, round(regr_r2(x, age), 8) AS r2 FROM persons GROUP BY seg")
def _(spark, d):
    return persons(spark, d).groupBy("seg").agg(r(F.covar_samp("x", "age")).alias("cov"), r(F.corr("x", "age"), 6).alias("r"), r(F.regr_slope("x", "age"), 6).alias("slope"), r(F.regr_intercept("x", "age")).alias("intercept"), r(F.regr_r2("x", "age"), 8).alias("r2"))


@query("spearman", f"WITH {PERSONS}, k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY age) + (count(*) OVER (PARTITION BY age) - 1) / 2.0::DOUBLE AS b FROM (SELECT x, age FROM persons)) SELECT round(rho, 6) AS rho, round({Q.t_two_sided('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)')}, 6) AS p FROM (SELECT corr(a, b) AS rho, CAST(count(*) AS DOUBLE) AS n FROM k)")
def _(spark, d):
    return rounded(K.spearman(persons(spark, d), "x", "age"), 6)


@query("auc_exact", f"WITH {PERSONS}, q AS (SELECT status = 'F' AS y, x FROM persons), {RANK.format(cols='y, x', src='q')} SELECT round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (CAST(count(*) FILTER (y) AS DOUBLE) * count(*) FILTER (NOT y)), 6) AS auc FROM rk")
def _(spark, d):
    p = persons(spark, d).withColumn("y", F.when(c("status") == "F", "1").otherwise("0"))
    return K.mann_whitney(p, "x", "y", "1", "0").select(r("p_greater", 6).alias("auc"))


@query("classification_table", f"WITH {PERSONS}, t AS (SELECT count(*) FILTER (x > 200 AND status = 'F') AS tp, count(*) FILTER (x > 200 AND status <> 'F') AS fp, count(*) FILTER (x <= 200 AND status = 'F') AS fn, count(*) FILTER (x <= 200 AND status <> 'F') AS tn FROM persons) SELECT tp, fp, fn, tn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy, round(CAST(greatest(tp + fn, fp + tn) AS DOUBLE) / (tp + fp + fn + tn), 6) AS trivial FROM t")
def _(spark, d):
    y, hit = c("status") == "F", c("x") > 200
    t = persons(spark, d).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    n = c("tp") + c("fp") + c("fn") + c("tn")
    return t.select("tp", "fp", "fn", "tn", r((c("tp") + c("tn")) / n, 6).alias("accuracy"), r(F.greatest(c("tp") + c("fn"), c("fp") + c("tn")) / n, 6).alias("trivial"))


#: Where an effect begins to be small, medium and large, by measure.
CUTS = {"d": (0.2, 0.5, 0.8), "g": (0.2, 0.5, 0.8), "r": (0.1, 0.3, 0.5), "eta2": (0.01, 0.06, 0.14), "omega2": (0.01, 0.06, 0.14), "epsilon2": (0.01, 0.06, 0.14), "v": (0.1, 0.3, 0.5)}
LABELS = ("negligible", "small", "medium", "large")


def label(measure, value):
    """The label of an effect, from its measure's cuts."""
    out = None
    for k, cuts in CUTS.items():
        one = F.when(F.abs(value) < cuts[0], LABELS[0]).when(F.abs(value) < cuts[1], LABELS[1]).when(F.abs(value) < cuts[2], LABELS[2]).otherwise(LABELS[3])
        out = F.when(measure == k, one) if out is None else out.when(measure == k, one)
    return out


def effects(spark, d):
    """measure, value: effects of two groups (d, g, r), of all groups (eta2, omega2, epsilon2) and of two labels (v)."""
    p = persons(spark, d)
    n = p.filter(c("grp").isin(*AB)).agg(F.count("x").alias("n"))
    parts = [K.t_test(two(spark, d)).select("d", "g"), K.mann_whitney(p, "x", "grp", *AB).crossJoin(n).select(F.least(F.lit(1.0), F.abs(F.round("z", 6)) / F.sqrt("n")).alias("r")), K.anova(p, "x", "grp").select("eta2", "omega2"),
             K.kruskal_wallis(p, "x", "grp").select("epsilon2"), K.chi2_independence(K.contingency(p, "seg", "grp")).select(c("cramer_v").alias("v"))]
    out = None
    for t in parts:
        one = t.select(*[F.round(k, 6).alias(k) if k != "r" else c(k) for k in t.columns]).unpivot([], t.columns, "measure", "value")  # to the digits of the tests' own tables
        out = one if out is None else out.union(one)
    return out


_LABEL = "CASE measure " + " ".join(f"WHEN '{k}' THEN CASE WHEN abs(value) < {a} THEN '{LABELS[0]}' WHEN abs(value) < {b} THEN '{LABELS[1]}' WHEN abs(value) < {e} THEN '{LABELS[2]}' ELSE '{LABELS[3]}' END" for k, (a, b, e) in CUTS.items()) + " END"
EFFECTS = f"""WITH t2 AS ({{t_two_sample}}), mw AS ({{mann_whitney}}), ao AS ({{anova_one_way}}), kw AS ({{kruskal_wallis}}), ch AS ({{chi2_independence}}),
ef AS (SELECT 'd' AS measure, d AS value FROM t2 UNION ALL SELECT 'g', g FROM t2 UNION ALL SELECT 'r', least(1, abs(z) / sqrt((SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN {AB}))) FROM mw UNION ALL SELECT 'eta2', eta2 FROM ao UNION ALL SELECT 'omega2', omega2 FROM ao UNION ALL SELECT 'epsilon2', epsilon2 FROM kw UNION ALL SELECT 'v', cramer_v FROM ch)"""


@query("effect_sizes")
def _(spark, d):
    return effects(spark, d).select("measure", r("value", 5).alias("value"), label(c("measure"), c("value")).alias("label"))


# the choice of a test, as a table of rules: an empty cell holds for any case, the first rule that fits decides
RULES = [
    # kind, two groups, normal, equal variances, cells expected over 5, test, alternative, effect, reason
    ("numeric", True, True, None, None, "welch t", "mann-whitney", "g", "two groups, both normal"),
    ("numeric", True, False, None, None, "mann-whitney", "welch t", "r", "two groups, one of them not normal"),
    ("numeric", False, True, True, None, "anova", "kruskal-wallis", "eta2", "several normal groups of equal variances"),
    ("numeric", False, True, False, None, "welch anova", "kruskal-wallis", "eta2", "several normal groups of unequal variances"),
    ("numeric", False, False, None, None, "kruskal-wallis", "anova", "epsilon2", "several groups, one of them not normal"),
    ("categorical", True, None, None, False, "fisher", "chi2", "v", "two by two, a cell expected under 5"),
    ("categorical", None, None, None, None, "chi2", "fisher", "v", "a table of counts"),
]
FACTS = ("kind", "two", "normal", "equal", "expected")


def chosen(facts):
    """facts (comparison, kind, two, normal, equal, expected) with the test, alternative, effect and reason of the first rule that fits."""
    rules = facts.sparkSession.createDataFrame([(i, *rule) for i, rule in enumerate(RULES)], "place int, rule_kind string, rule_two boolean, rule_normal boolean, rule_equal boolean, rule_expected boolean, test string, alternative string, effect string, reason string")
    fits = F.lit(True)
    for k in FACTS:
        fits = fits & (c("rule_" + k).isNull() | (c("rule_" + k) == c(k)))
    found = facts.join(F.broadcast(rules), fits).groupBy(*facts.columns).agg(F.min(F.struct("place", "test", "alternative", "effect", "reason")).alias("rule"))  # a row a rule
    return found.select(*facts.columns, "rule.test", "rule.alternative", "rule.effect", "rule.reason")


def normal_groups(df, x: str, g: str):
    """normal: whether skewness and kurtosis of every group agree with a normal at 0.05."""
    s = df.groupBy(g).agg(F.count(x).alias("n"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k"))
    return s.agg(F.coalesce(F.bool_and(c("n") / 6 * (c("s") * c("s") + c("k") * c("k") / 4) / 2 <= F.lit(2.995732273553991)), F.lit(False)).alias("normal"))


_JB = "n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) / 2 <= 2.995732273553991"
_NORMAL = f"nm AS (SELECT bool_and({_JB}) AS normal, bool_and({_JB}) FILTER (grp IN {AB}) AS normal_two FROM (SELECT grp, CAST(count(*) AS DOUBLE) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM persons JOIN (SELECT grp AS gg, avg(x) AS m FROM persons GROUP BY 1) ON grp = gg GROUP BY grp))"
_FIT = " ".join(f"WHEN {' AND '.join(f'{k} = {v!r}' if isinstance(v, str) else (k if v else f'NOT {k}') for k, v in zip(FACTS, rule[:5], strict=True) if v is not None)} THEN {i}" for i, rule in enumerate(RULES))
CHOSEN = f"""{EFFECTS}, {PERSONS}, {_NORMAL}, lv AS ({{levene_bf}}), wa AS ({{welch_anova}}), fi AS ({{fisher_2x2}}),
rs AS (SELECT status = 'F' AS a, w > 4 AS b, CAST(count(*) AS DOUBLE) AS n FROM persons GROUP BY ALL), fx AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM rs), c2 AS (SELECT sum(pow(n - e, 2) / e) AS chi2, min(e) AS least, sum(n) AS total FROM fx),
cl AS (SELECT seg, grp, CAST(count(*) AS DOUBLE) AS n FROM persons GROUP BY ALL), cx AS (SELECT min(ra * cb / total) AS least FROM (SELECT sum(n) OVER (PARTITION BY seg) AS ra, sum(n) OVER (PARTITION BY grp) AS cb, sum(n) OVER () AS total FROM cl)),
fa AS (SELECT 'income of two groups' AS comparison, 'numeric' AS kind, true AS two, normal_two AS normal, true AS equal, true AS expected FROM nm UNION ALL SELECT 'income of all groups', 'numeric', false, normal, (SELECT p >= 0.05 FROM lv), true FROM nm
  UNION ALL SELECT 'segment by group', 'categorical', false, true, true, least >= 5 FROM cx UNION ALL SELECT 'status by weight', 'categorical', true, true, true, least >= 5 FROM c2),
ru(place, test, alternative, effect, reason) AS (VALUES {', '.join(f"({i}, '{x[5]}', '{x[6]}', '{x[7]}', '{x[8]}')" for i, x in enumerate(RULES))}),
ps AS (SELECT 'income of two groups' AS comparison, 'welch t' AS test, p_welch AS p FROM t2 UNION ALL SELECT 'income of two groups', 'mann-whitney', p FROM mw UNION ALL SELECT 'income of all groups', 'anova', p FROM ao UNION ALL SELECT 'income of all groups', 'welch anova', p FROM wa UNION ALL SELECT 'income of all groups', 'kruskal-wallis', p FROM kw
  UNION ALL SELECT 'segment by group', 'chi2', p FROM ch UNION ALL SELECT 'status by weight', 'fisher', p FROM fi UNION ALL SELECT 'status by weight', 'chi2', {Q.chi2_upper('chi2', '1')} FROM c2),
ev AS (SELECT 'income of two groups' AS comparison, measure, value FROM ef WHERE measure IN ('g', 'r') UNION ALL SELECT 'income of all groups', measure, value FROM ef WHERE measure IN ('eta2', 'epsilon2') UNION ALL SELECT 'segment by group', measure, value FROM ef WHERE measure = 'v' UNION ALL SELECT 'status by weight', 'v', sqrt(chi2 / total) FROM c2)
SELECT comparison, test, reason, round(a.p, 6) AS p, alternative, round(b.p, 6) AS p_alternative, (a.p < 0.05) <> (b.p < 0.05) AS conclusion_changes, effect, round(ev.value, 5) AS value
FROM (SELECT *, CASE {_FIT} END AS place FROM fa) f JOIN ru USING (place) LEFT JOIN ps a USING (comparison, test) LEFT JOIN (SELECT comparison, test AS alternative, p FROM ps) b USING (comparison, alternative) LEFT JOIN ev ON ev.comparison = f.comparison AND ev.measure = effect"""


@query("choose_test_rules")
def _(spark, d):
    """For each comparison the test that the rules choose, why, its p, that of the alternative where there is one, and the effect."""
    p = persons(spark, d)
    ab = p.filter(c("grp").isin(*AB))
    cells, square = K.contingency(p, "seg", "grp"), K.contingency(p.select((c("status") == "F").alias("f"), (c("w") > 4).alias("h")), "f", "h")
    true, text = F.lit(True), lambda v: F.lit(v)
    facts = normal_groups(ab, "x", "grp").select(text("income of two groups").alias("comparison"), text("numeric").alias("kind"), true.alias("two"), "normal", true.alias("equal"), true.alias("expected"))
    facts = facts.union(normal_groups(p, "x", "grp").crossJoin(K.levene(p, "x", "grp").select((c("p") >= 0.05).alias("equal"))).select(text("income of all groups"), text("numeric"), ~true, "normal", "equal", true))
    for name, t, two_by_two in (("segment by group", cells, ~true), ("status by weight", square, true)):
        facts = facts.union(t.agg((F.min("expected") >= 5).alias("e")).select(text(name), text("categorical"), two_by_two, true, true, "e"))
    chi = K.chi2_independence(square)
    yes, own = c("status") == "F", c("w") > 4
    exact = fisher_exact(p.agg(F.count_if(yes).alias("m1"), F.count_if(~yes).alias("m0"), F.count_if(yes & own).alias("k"), F.count_if(own).alias("n")))
    ps = None
    for name, test, t in (("income of two groups", "welch t", K.t_test(two(spark, d)).select(c("p_welch").alias("p"))), ("income of two groups", "mann-whitney", K.mann_whitney(p, "x", "grp", *AB)), ("income of all groups", "anova", K.anova(p, "x", "grp")),
                          ("income of all groups", "welch anova", K.welch_anova(p, "x", "grp")), ("income of all groups", "kruskal-wallis", K.kruskal_wallis(p, "x", "grp")), ("segment by group", "chi2", K.chi2_independence(cells)), ("status by weight", "fisher", exact), ("status by weight", "chi2", chi)):
        one = t.select(F.lit(name).alias("of"), F.lit(test).alias("by"), c("p").alias("p"))
        ps = one if ps is None else ps.union(one)
    values = effects(spark, d).select(F.when(c("measure").isin("g", "r"), "income of two groups").when(c("measure") == "v", "segment by group").otherwise("income of all groups").alias("of"), "measure", "value")
    values = values.union(chi.select(F.lit("status by weight"), F.lit("v"), c("cramer_v")))
    t = chosen(facts)
    second = ps.select(c("of").alias("of2"), c("by").alias("by2"), c("p").alias("p_alternative"))
    t = t.join(F.broadcast(ps), (c("comparison") == c("of")) & (c("test") == c("by")), "left").drop("of", "by").join(F.broadcast(second), (c("comparison") == c("of2")) & (c("alternative") == c("by2")), "left")  # a row a test
    t = t.join(F.broadcast(values), (c("comparison") == c("of")) & (c("effect") == c("measure")), "left")
    return t.select("comparison", "test", "reason", r("p", 6).alias("p"), "alternative", r("p_alternative", 6).alias("p_alternative"), ((c("p") < 0.05) != (c("p_alternative") < 0.05)).alias("conclusion_changes"), "effect", r("value", 5).alias("value"))


CHOOSE = f"""WITH {PERSONS}, f AS (SELECT CAST(count(DISTINCT grp) AS BIGINT) AS groups, abs(avg(pow((x - m) / s, 3))) AS skew FROM persons, (SELECT avg(x) AS m, stddev_pop(x) AS s FROM persons)),
small AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM persons GROUP BY grp)), {{tests}},
k AS (SELECT groups, CASE WHEN skew > 1 AND least < 15 THEN 'kruskal-wallis' WHEN lp < 0.05 THEN 'welch anova' ELSE 'anova' END AS test, CASE WHEN skew > 1 AND least < 15 THEN 'skewed, small groups' WHEN lp < 0.05 THEN 'unequal variances' ELSE 'equal variances' END AS reason FROM f, small, (SELECT p AS lp FROM tl))
SELECT groups, k.test, reason, round(a.p, 6) AS p, b.test AS alternative, round(b.p, 6) AS p_alternative, (a.p < 0.05) <> (b.p < 0.05) AS conclusion_changes FROM k JOIN tp a ON a.test = k.test JOIN tp b ON b.test = CASE k.test WHEN 'kruskal-wallis' THEN 'anova' ELSE 'kruskal-wallis' END"""


@query("choose_test")
def _(spark, d):
    """The test that fits, why, its p, an alternative with its p, and whether the conclusion at 0.05 depends on the choice.

    Skewed values in groups under 15 ask for ranks, unequal variances (Brown-Forsythe under 0.05) for Welch's form; the
    alternative to a test of means is that of ranks, and the other way round.
    """
    p = persons(spark, d)
    tests = None
    for name, df in (("anova", K.anova(p, "x", "grp")), ("welch anova", K.welch_anova(p, "x", "grp")), ("kruskal-wallis", K.kruskal_wallis(p, "x", "grp"))):
        one = df.select(F.lit(name).alias("name"), c("p").alias("p_of"))
        tests = one if tests is None else tests.union(one)
    least = p.groupBy("grp").agg(F.count("x").alias("n")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("groups"))
    t = p.agg(F.abs(F.skewness("x")).alias("skew")).crossJoin(least).crossJoin(K.levene(p, "x", "grp").select(c("p").alias("lp")))
    ranks, uneven = (c("skew") > 1) & (c("least") < 15), c("lp") < 0.05
    t = t.select("groups", F.when(ranks, "kruskal-wallis").when(uneven, "welch anova").otherwise("anova").alias("test"), F.when(ranks, "skewed, small groups").when(uneven, "unequal variances").otherwise("equal variances").alias("reason"))
    t = t.withColumn("alternative", F.when(c("test") == "kruskal-wallis", "anova").otherwise("kruskal-wallis"))
    own, other = tests.select(c("name").alias("n1"), c("p_of").alias("p")), tests.select(c("name").alias("n2"), c("p_of").alias("p_alternative"))
    t = t.join(F.broadcast(own), c("test") == c("n1")).join(F.broadcast(other), c("alternative") == c("n2"))  # three rows each
    return t.select("groups", "test", "reason", r("p", 6).alias("p"), "alternative", r("p_alternative", 6).alias("p_alternative"), ((c("p") < 0.05) != (c("p_alternative") < 0.05)).alias("conclusion_changes"))


# the text of a table of tests is that of each test
ORACLES["with_p_values"] = ORACLES["with_p_values"].format(**{k: ORACLES[k] for k in ("t_two_sample", "anova_one_way", "kruskal_wallis", "mann_whitney", "alexander_govern")})
ORACLES["choose_test"] = CHOOSE.format(tests="tl AS ({levene_bf}), tp AS (SELECT 'anova' AS test, p FROM ({anova_one_way}) UNION ALL SELECT 'welch anova', p FROM ({welch_anova}) UNION ALL SELECT 'kruskal-wallis', p FROM ({kruskal_wallis}))".format(**{k: ORACLES[k] for k in ("levene_bf", "anova_one_way", "welch_anova", "kruskal_wallis")}))
ORACLES["effect_sizes"] = f"{EFFECTS} SELECT measure, round(value, 5) AS value, {_LABEL} AS label FROM ef".format(**ORACLES)
ORACLES["choose_test_rules"] = CHOSEN.replace("WITH t2", "WITH RECURSIVE t2", 1).format(**ORACLES)
