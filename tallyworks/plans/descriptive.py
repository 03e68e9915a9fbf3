"""Descriptive statistics, inequality and ranks: over orders as persons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import describe as D
from ..operators import order as O
from .registry import PERSONS, persons, query, r, rounded, table

SKEW = "CASE WHEN count(x) > 2 AND stddev_samp(x) > 0 THEN CAST(count(x) AS DOUBLE) * count(x) / ((CAST(count(x) AS DOUBLE) - 1) * (count(x) - 2)) * (avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) * avg(x) * avg(x)) / pow(stddev_samp(x), 3) END"
DESCRIBE = f"count(x) AS n, count(*) - count(x) AS missing, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.75), 4) AS q3, round(max(x), 4) AS max, round({SKEW}, 4) AS skew, CASE WHEN abs({SKEW}) > 1 THEN 'skewed' ELSE 'symmetric' END AS shape"
W = "w AS (SELECT count(x) AS n, CAST(sum(w) AS BIGINT) AS sum_w, sum(w * x) AS total, min(x) AS min, max(x) AS max, sum(w * x) / sum(w) AS mean, sum(w * x * x) / sum(w) AS r2, sum(w * x * x * x) / sum(w) AS r3, sum(w * x * x * x * x) / sum(w) AS r4 FROM persons WHERE w > 0)"
# midpoint quantiles: rows in order of value and weight
MID = "s AS (SELECT x, w, (sum(w) OVER (ORDER BY x, w, id ROWS UNBOUNDED PRECEDING) - w / 2.0::DOUBLE) / sum(w) OVER () AS p FROM persons)"


def mid(p: float) -> str:
    return f"(SELECT coalesce((SELECT min(x) FROM s WHERE p = {p}), CASE WHEN {p} < min(p) THEN min(x) WHEN {p} > max(p) THEN max(x) ELSE arg_max(x, p) FILTER (p < {p}) + (arg_min(x, p) FILTER (p > {p}) - arg_max(x, p) FILTER (p < {p})) * ({p} - max(p) FILTER (p < {p})) / (min(p) FILTER (p > {p}) - max(p) FILTER (p < {p})) END) FROM s)"


@query("describe_numeric", f"WITH {PERSONS}, t AS (SELECT CASE WHEN p21 >= 0 THEN p21 END AS x FROM persons) SELECT {DESCRIBE} FROM t")
def _(spark, d):
    return rounded(D.describe_numeric(persons(spark, d).select(F.when(F.col("p21") >= 0, F.col("p21")).alias("x")), "x"))


@query("describe_by_group", f"WITH {PERSONS} SELECT grp, {DESCRIBE} FROM persons GROUP BY grp")
def _(spark, d):
    return rounded(D.describe_numeric(persons(spark, d), "x", ["grp"]))


@query("describe_weighted", f"""WITH {PERSONS}, {W}, {MID}, q AS (SELECT {mid(0.25)} AS q1, {mid(0.5)} AS median, {mid(0.75)} AS q3),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence, r2 - mean * mean AS v FROM w, q),
g AS (SELECT sum(p.w * abs(x - mean)) / sum(p.w) AS mad, 100 * sum(CASE WHEN x < low_fence OR x > high_fence THEN p.w ELSE 0 END) / sum(p.w) AS o, 100 * sum(CASE WHEN x < mean THEN p.w ELSE 0 END) / sum(p.w) AS b FROM persons p, f)
SELECT n, sum_w, round(total, 2) AS total, round(min, 4) AS min, round(max, 4) AS max, round(max - min, 4) AS "range", round(mean, 4) AS mean, round(v, 4) AS variance, round(sqrt(v), 4) AS sd, round(sqrt(v) / mean, 4) AS cv,
round((r3 - 3 * mean * r2 + 2 * pow(mean, 3)) / pow(v, 1.5), 4) AS skew, round((r4 - 4 * mean * r3 + 6 * mean * mean * r2 - 3 * pow(mean, 4)) / (v * v) - 3, 4) AS kurtosis, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(low_fence, 4) AS low_fence, round(high_fence, 4) AS high_fence, round(mad, 4) AS mad, round(o, 4) AS pct_outliers, round(b, 4) AS pct_below_mean FROM f, g""")
def _(spark, d):
    return rounded(D.describe_weighted(persons(spark, d), "x", "w")).withColumn("total", F.round("total", 2))


@query("top_share", f"WITH {PERSONS}, {MID}, q AS (SELECT {mid(0.9)} AS cut) SELECT round(sum(CASE WHEN x >= cut THEN w * x ELSE 0 END) / sum(w * x), 6) AS share_top, round(sum(CASE WHEN x >= 200 THEN w * x ELSE 0 END) / sum(w * x), 6) AS share_above FROM persons, q")
def _(spark, d):
    p = persons(spark, d)
    cut = F.broadcast(O.quantiles_midpoint(p, "x", "w", [0.9]).select(F.col("q").alias("cut")))  # one row
    wx = F.col("w") * F.col("x")
    return p.crossJoin(cut).agg(r(F.sum(F.when(F.col("x") >= F.col("cut"), wx).otherwise(0)) / F.sum(wx), 6).alias("share_top"), r(F.sum(F.when(F.col("x") >= 200, wx).otherwise(0)) / F.sum(wx), 6).alias("share_above"))


@query("weighted_geometric_harmonic", f"WITH {PERSONS} SELECT round(exp(sum(w * ln(x)) / sum(w)), 4) AS geometric, round(sum(w) / sum(w / x), 4) AS harmonic FROM persons WHERE x > 0")
def _(spark, d):
    return persons(spark, d).filter("x > 0").agg(r(F.exp(F.sum(F.col("w") * F.ln("x")) / F.sum("w"))).alias("geometric"), r(F.sum("w") / F.sum(F.col("w") / F.col("x"))).alias("harmonic"))


@query("weighted_mode", f"WITH {PERSONS}, t AS (SELECT round(x, -1) AS v, sum(w) AS sw FROM persons GROUP BY 1) SELECT arg_max(v, {{'s': sw, 'v': -v}}) AS mode, round(max(sw) / sum(sw), 6) AS share FROM t")
def _(spark, d):
    return rounded(D.weighted_mode(persons(spark, d).withColumn("x", F.round("x", -1)), "x", "w"), 6)


@query("coverage_k_sd", f"WITH {PERSONS}, s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM persons) SELECT k, round(100.0::DOUBLE * sum(CASE WHEN abs(x - m) <= k * sd THEN 1 ELSE 0 END) / count(*), 4) AS inside, round(100 * (1 - 1.0::DOUBLE / (k * k)), 4) AS chebyshev FROM persons, s, (VALUES (1), (2), (3)) t(k) GROUP BY k")
def _(spark, d):
    p = persons(spark, d)
    s = F.broadcast(p.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd")))
    k = p.crossJoin(s).withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return k.groupBy("k").agg(r(100.0 * F.sum((F.abs(F.col("x") - F.col("m")) <= F.col("k") * F.col("sd")).cast("int")) / F.count(F.lit(1))).alias("inside")).withColumn("chebyshev", r(100 * (1 - 1 / (F.col("k") * F.col("k")))))


@query("z_scores", f"WITH {PERSONS}, s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM persons) SELECT id, round((x - m) / sd, 6) AS z FROM persons, s")
def _(spark, d):
    p = persons(spark, d)
    return p.crossJoin(F.broadcast(p.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd")))).select("id", r((F.col("x") - F.col("m")) / F.col("sd"), 6).alias("z"))


FREQ = "SELECT category, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share, CAST(sum(n) OVER (ORDER BY category ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_n, round(CAST(sum(n) OVER (ORDER BY category ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER (), 6) AS cum_share"


@query("frequency_table", f"WITH {PERSONS}, t AS (SELECT grp AS category, count(*) AS n FROM persons GROUP BY 1) {FREQ} FROM t")
def _(spark, d):
    return rounded(D.frequency_table(persons(spark, d), "grp"), 6)


@query("weighted_frequency_cumulative", f"WITH {PERSONS}, t AS (SELECT grp AS category, CAST(sum(w) AS BIGINT) AS n FROM persons GROUP BY 1), u AS ({FREQ} FROM t) SELECT *, cum_share >= 0.5 AND cum_share - share < 0.5 AS holds_median FROM u")
def _(spark, d):
    return rounded(D.frequency_table(persons(spark, d), "grp", "w"), 6).withColumn("holds_median", (F.col("cum_share") >= 0.5) & (F.col("cum_share") - F.col("share") < 0.5))


@query("top_coded_counts", f"WITH {PERSONS}, k AS (SELECT psu, least(count(*), 7) AS category FROM persons GROUP BY 1), t AS (SELECT category, count(*) AS n FROM k GROUP BY 1) {FREQ} FROM t")
def _(spark, d):
    k = persons(spark, d).groupBy("psu").agg(F.least(F.count(F.lit(1)), F.lit(7)).cast("long").alias("category"))
    return rounded(D.frequency_table(k, "category"), 6)


@query("grouped_classes", f"WITH {PERSONS}, c AS (SELECT CAST(range AS INTEGER) AS class_no FROM range(12)), t AS (SELECT CAST(least(floor(x / 50), 11) AS INTEGER) AS class_no, sum(w) AS n FROM persons WHERE x BETWEEN 0 AND 600 GROUP BY 1) SELECT class_no, class_no * 50.0::DOUBLE AS low, class_no * 50.0::DOUBLE + 50 AS high, class_no * 50.0::DOUBLE + 25 AS mark, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY class_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_n FROM c LEFT JOIN t USING (class_no)")
def _(spark, d):
    return D.grouped_classes(persons(spark, d), "x", 0, 50, 12, "w")


@query("freedman_diaconis_histogram", f"""WITH {PERSONS}, s AS (SELECT min(x) AS lo, max(x) AS hi, CAST(greatest(4, least(25, ceil((max(x) - min(x)) / (2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) * pow(count(x), -1.0::DOUBLE / 3))))) AS INTEGER) AS k FROM persons),
t AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / k)), k - 1) AS INTEGER) AS class_no, count(*) AS n FROM persons, s GROUP BY 1), c AS (SELECT CAST(unnest(range(k)) AS INTEGER) AS class_no, lo, (hi - lo) / k AS step FROM s) SELECT class_no, round(lo + class_no * step, 4) AS low, round(lo + (class_no + 1) * step, 4) AS high, coalesce(n, 0) AS n FROM c LEFT JOIN t USING (class_no)""")
def _(spark, d):
    return rounded(D.histogram_fd(persons(spark, d), "x"))


@query("sturges_classes", f"WITH {PERSONS} SELECT grp, count(*) AS n, CAST(ceil(1 + 3.322::DOUBLE * log10(count(*))) AS BIGINT) AS k FROM persons GROUP BY grp")
def _(spark, d):
    return persons(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.ceil(1 + 3.322 * F.log10(F.count(F.lit(1)))).alias("k"))


@query("histogram_density", f"WITH {PERSONS}, e AS (SELECT least(0, floor(min(x))) AS least, greatest(600, floor(max(x)) + 1) AS most FROM persons), c(lo, hi) AS (SELECT least, 0 FROM e WHERE least < 0 UNION ALL VALUES (0, 20), (20, 100), (100, 250), (250, 600) UNION ALL SELECT 600, most FROM e WHERE most > 600) SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (hi - lo), 6) AS height FROM persons JOIN c ON x >= lo AND x < hi GROUP BY lo, hi")
def _(spark, d):
    """Rows and density of uneven classes; the first and the last reach as far as the values do."""
    p, cuts = persons(spark, d), [0, 20, 100, 250, 600]
    ends = F.broadcast(p.agg(F.least(F.lit(0), F.floor(F.min("x"))).alias("least"), F.greatest(F.lit(600), F.floor(F.max("x")) + 1).alias("most")))
    lo, hi = F.when(F.col("x") < 0, F.col("least")), F.when(F.col("x") < 0, 0)
    for a, b in zip(cuts, cuts[1:], strict=False):
        lo, hi = lo.when(F.col("x") < b, a), hi.when(F.col("x") < b, b)
    t = p.crossJoin(ends).groupBy(lo.otherwise(600).cast("long").alias("lo"), hi.otherwise(F.col("most")).cast("long").alias("hi")).agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("height", r(F.col("n") / (F.col("hi") - F.col("lo")), 6))


@query("ogive_grouped_median", f"WITH {PERSONS}, t AS (SELECT floor(x / 50) * 50 AS low, count(*) AS n FROM persons GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY low ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM t) SELECT round(low + 50 * (total / 2.0::DOUBLE - (cum - n)) / n, 4) AS median FROM c WHERE cum >= total / 2.0 AND cum - n < total / 2.0")
def _(spark, d):
    t = persons(spark, d).groupBy((F.floor(F.col("x") / 50) * 50).alias("low")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(F.lit(0)).orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    c = t.withColumn("cum", F.sum("n").over(run)).withColumn("total", F.sum("n").over(D.whole()))
    return c.filter("cum >= total / 2 AND cum - n < total / 2").select(r(F.col("low") + 50 * (F.col("total") / 2 - (F.col("cum") - F.col("n"))) / F.col("n")).alias("median"))


@query("box_summary", f"WITH {PERSONS}, f AS (SELECT grp, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM persons GROUP BY 1) SELECT grp, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS low_whisker, round(max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS high_whisker, count(*) FILTER (x NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM persons JOIN f USING (grp) GROUP BY grp, f.q1, f.median, f.q3")
def _(spark, d):
    return rounded(D.box_summary(persons(spark, d), "x", "grp"))


@query("class_breaks", f"WITH {PERSONS}, u AS (SELECT stratum, avg(x) AS v FROM persons GROUP BY 1), s AS (SELECT min(v) AS lo, max(v) AS hi FROM u) SELECT stratum, round(v, 4) AS value, CAST(least(floor((v - lo) / ((hi - lo) / 5)), 4) + 1 AS INTEGER) AS equal_class, CAST(floor((row_number() OVER (ORDER BY v, stratum) - 1) * 5 / count(*) OVER ()) + 1 AS INTEGER) AS quantile_class FROM u, s")
def _(spark, d):
    u = persons(spark, d).groupBy("stratum").agg(F.avg("x").alias("v"))
    u = u.withColumn("lo", F.min("v").over(D.whole())).withColumn("hi", F.max("v").over(D.whole())).withColumn("n", F.count(F.lit(1)).over(D.whole())).withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("v", "stratum")))
    return u.select("stratum", r("v").alias("value"), (F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 5)), F.lit(4)) + 1).cast("int").alias("equal_class"), (F.floor((F.col("rn") - 1) * 5 / F.col("n")) + 1).cast("int").alias("quantile_class"))


@query("quantile_conventions", f"""WITH {PERSONS}, t AS (SELECT grp, list_sort(list(x)) AS v, count(*) AS n FROM persons GROUP BY 1), h AS (SELECT grp, v, n, p, (n - 1) * p + 1 AS h7, greatest(1, least(n, (n + 1) * p)) AS h6, greatest(ceil(n * p), 1) AS a, least(floor(n * p) + 1, n) AS b FROM t, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) q(p))
SELECT grp, p, round(v[CAST(floor(h7) AS BIGINT)] * (1 - (h7 - floor(h7))) + CASE WHEN floor(h7) < n THEN v[CAST(floor(h7) + 1 AS BIGINT)] * (h7 - floor(h7)) ELSE 0 END, 4) AS type7, round(v[CAST(floor(h6) AS BIGINT)] * (1 - (h6 - floor(h6))) + CASE WHEN floor(h6) < n THEN v[CAST(floor(h6) + 1 AS BIGINT)] * (h6 - floor(h6)) ELSE 0 END, 4) AS type6, round((v[CAST(a AS BIGINT)] + v[CAST(b AS BIGINT)]) / 2, 4) AS type2 FROM h""")
def _(spark, d):
    return rounded(D.quantile_conventions(persons(spark, d), "x", "grp", [0.1, 0.5, 0.9]))


@query("count_distinct_units", f"WITH {PERSONS} SELECT count(DISTINCT id) AS persons, count(DISTINCT psu) AS dwellings, count(DISTINCT stratum) AS areas, count(DISTINCT round(x)) AS amounts FROM persons")
def _(spark, d):
    return persons(spark, d).agg(F.count_distinct("id").alias("persons"), F.count_distinct("psu").alias("dwellings"), F.count_distinct("stratum").alias("areas"), F.count_distinct(F.round("x")).alias("amounts"))


@query("heaping", f"WITH {PERSONS}, t AS (SELECT round(x, -1) AS v, count(*) AS c FROM persons GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS n, round((SELECT sum(c) FROM (SELECT c FROM t ORDER BY c DESC, v LIMIT 6)) / sum(c), 6) AS share_top, round(sum(CASE WHEN v % 100 = 0 THEN c ELSE 0 END) / sum(c), 6) AS share_multiple FROM t")
def _(spark, d):
    return rounded(D.heaping(persons(spark, d).withColumn("x", F.round("x", -1)), "x", 6, 100.0), 6)


@query("nonresponse_profile", f"WITH {PERSONS} SELECT p21 <> -9 AS answered, count(*) AS n, round(avg(age), 4) AS mean_age, round(100.0::DOUBLE * count(*) FILTER (status = 'F') / count(*), 4) AS pct_f, CAST(sum(w) AS BIGINT) AS w, CAST(coalesce(sum(w) FILTER (p21 > 0), 0) AS BIGINT) AS w_positive FROM persons GROUP BY 1")
def _(spark, d):
    return persons(spark, d).groupBy((F.col("p21") != -9).alias("answered")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("age")).alias("mean_age"), r(100.0 * F.count_if(F.col("status") == "F") / F.count(F.lit(1))).alias("pct_f"), F.sum("w").alias("w"), F.sum(F.when(F.col("p21") > 0, F.col("w")).otherwise(0)).alias("w_positive"))


@query("weighted_group_means", f"WITH {PERSONS} SELECT grp, round(sum(w * x) / sum(w), 4) AS mean, round(sum(w) / sum(sum(w)) OVER (), 6) AS share FROM persons GROUP BY grp")
def _(spark, d):
    return persons(spark, d).groupBy("grp").agg(F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum("w").alias("sw")).select("grp", r(F.col("wx") / F.col("sw")).alias("mean"), r(F.col("sw") / F.sum("sw").over(D.whole()), 6).alias("share"))


CASES = {"income weight, income > 0": ("w2", "p21 > 0"), "person weight": ("w", "p21 > 0"), "with zeros": ("w", "p21 >= 0"), "with sentinels": ("w", "true"), "no weight": ("1", "p21 > 0")}


@query("weight_choice_contrast", f"WITH {PERSONS}, t AS (SELECT *, CASE WHEN p21 = -9 THEN 0 ELSE w * 9 END AS w2 FROM persons), u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS choice, sum({w} * p21) / sum({w}) AS m FROM t WHERE {c}" for k, (w, c) in CASES.items()) + ") SELECT choice, round(m, 4) AS mean, round(m - (SELECT m FROM u WHERE choice LIKE 'income%'), 4) AS difference FROM u")
def _(spark, d):
    t = persons(spark, d).withColumn("w2", F.when(F.col("p21") == -9, 0).otherwise(F.col("w") * 9))
    a = t.agg(*[(F.sum(F.when(F.expr(c), F.expr(f"{w} * p21"))) / F.sum(F.when(F.expr(c), F.expr(w)))).alias(k) for k, (w, c) in CASES.items()])
    return a.withColumn("right_one", F.col(f"`{next(iter(CASES))}`")).unpivot(["right_one"], [f"`{k}`" for k in CASES], "choice", "m").select("choice", r("m").alias("mean"), r(F.col("m") - F.col("right_one")).alias("difference"))


@query("weighted_vs_unweighted", f"WITH {PERSONS} SELECT grp, round(avg(x), 4) AS plain, round(sum(w * x) / sum(w), 4) AS weighted, round(avg(x) / (sum(w * x) / sum(w)) - 1, 6) AS relative FROM persons GROUP BY grp")
def _(spark, d):
    m = F.sum(F.col("w") * F.col("x")) / F.sum("w")
    return persons(spark, d).groupBy("grp").agg(r(F.avg("x")).alias("plain"), r(m).alias("weighted"), r(F.avg("x") / m - 1, 6).alias("relative"))


@query("total_and_groups", f"WITH {PERSONS} SELECT coalesce(seg, 'Total') AS grp, count(*) AS n, round(sum(w * x) / sum(w), 4) AS mean FROM persons GROUP BY GROUPING SETS ((), (seg))")
def _(spark, d):
    p = persons(spark, d)
    return p.groupingSets([(), ("seg",)], "seg").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean")).select(F.coalesce("seg", F.lit("Total")).alias("grp"), "n", "mean")


@query("several_cuts", f"WITH {PERSONS}, u AS (SELECT 'group' AS cut, grp AS g, x, w FROM persons UNION ALL SELECT 'segment', seg, x, w FROM persons UNION ALL SELECT 'status', status, x, w FROM persons) SELECT cut, g, count(*) AS n, round(sum(w * x) / sum(w), 4) AS mean FROM u GROUP BY ALL")
def _(spark, d):
    cuts = F.explode(F.array(*[F.struct(F.lit(k).alias("cut"), F.col(c).alias("g")) for k, c in (("group", "grp"), ("segment", "seg"), ("status", "status"))]))
    return persons(spark, d).select(cuts.alias("c"), "x", "w").select("c.*", "x", "w").groupBy("cut", "g").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))


@query("table_one", f"WITH {PERSONS} SELECT seg, count(*) AS n, printf('%.2f (%.2f)', avg(x), stddev_samp(x)) AS x, round(100.0::DOUBLE * count(*) FILTER (status = 'F') / count(*), 4) AS pct_f FROM persons GROUP BY seg")
def _(spark, d):
    return persons(spark, d).groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.format_string("%.2f (%.2f)", F.avg("x"), F.stddev_samp("x")).alias("x"), r(100.0 * F.count_if(F.col("status") == "F") / F.count(F.lit(1))).alias("pct_f"))


# what needs a global order

@query("running_weight", f"WITH {PERSONS}, t AS (SELECT round(x) AS v, sum(w) AS w FROM persons GROUP BY 1) SELECT v, CAST(w AS BIGINT) AS w, CAST(sum(w) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM t")
def _(spark, d):
    s = O.prefix_sums(persons(spark, d).withColumn("v", F.round("x")), [], "v", {"w": F.col("w")})
    return s.select("v", F.col("w"), (F.col("w_before") + F.col("w")).cast("long").alias("running"))


@query("weighted_quantiles_midpoint", f"WITH {PERSONS}, {MID} " + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, round({mid(p)}, 6) AS q" for p in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)))
def _(spark, d):
    return rounded(O.quantiles_midpoint(persons(spark, d), "x", "w", [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]), 6)


STEP = "s AS (SELECT {by} AS g, x, sum(w) OVER (PARTITION BY {by} ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY {by}) AS total FROM persons)"


@query("weighted_quantiles_step", f"WITH {PERSONS}, {STEP.format(by='grp')} SELECT g AS grp, p, round(min(x), 6) AS q FROM s, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(p) WHERE cum >= p * total GROUP BY ALL")
def _(spark, d):
    return rounded(O.quantiles_step(persons(spark, d), "x", "w", [0.1, 0.5, 0.9], ["grp"]), 6)


@query("average_ranks", f"WITH {PERSONS}, t AS (SELECT round(x) AS v, count(*) AS n FROM persons GROUP BY 1) SELECT v, n, sum(n) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - n + (n + 1) / 2.0::DOUBLE AS rank FROM t")
def _(spark, d):
    return O.average_ranks(persons(spark, d).withColumn("v", F.round("x")), "v").select("v", "n", F.col("rank").cast("double").alias("rank"))


@query("ordered_rank_by_name", "WITH t AS (SELECT n_name, count(*) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT n_name, v, CAST(row_number() OVER (ORDER BY v DESC, n_name) AS INTEGER) AS place FROM t")
def _(spark, d):
    t = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("v"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("v"), "n_name")))


@query("lorenz_curve", f"""WITH {PERSONS}, t AS (SELECT x, sum(w) AS w, sum(w * x) AS y FROM persons GROUP BY 1), c AS (SELECT x, sum(w) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS p, sum(y) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) / sum(y) OVER () AS q FROM t),
l AS (SELECT p, q, coalesce(lag(p) OVER (ORDER BY p), 0) AS p0, coalesce(lag(q) OVER (ORDER BY p), 0) AS q0 FROM c), g AS (SELECT CAST(range AS INTEGER) AS k, range / 100.0::DOUBLE AS pt FROM range(101))
SELECT k, round(pt, 6) AS p, round(CASE WHEN k = 0 THEN 0 ELSE q0 + (q - q0) * (pt - p0) / (p - p0) END, 6) AS q FROM g LEFT JOIN l ON pt > p0 AND pt <= p""")
def _(spark, d):
    return rounded(O.lorenz_grid(persons(spark, d), "x", "w"), 6)


GINI = "c AS (SELECT {by} AS g, x, sum(w) AS w, sum(w * x) AS y FROM persons GROUP BY ALL), l AS (SELECT g, x, sum(w) OVER (PARTITION BY g ORDER BY x ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY g) AS p, sum(y) OVER (PARTITION BY g ORDER BY x ROWS UNBOUNDED PRECEDING) / sum(y) OVER (PARTITION BY g) AS q FROM c), k AS (SELECT g, p, q, coalesce(lag(p) OVER (PARTITION BY g ORDER BY x), 0) AS p0, coalesce(lag(q) OVER (PARTITION BY g ORDER BY x), 0) AS q0 FROM l)"


@query("gini", f"WITH {PERSONS}, {GINI.format(by='seg')} SELECT g AS seg, round(1 - sum((q + q0) * (p - p0)), 6) AS gini FROM k GROUP BY g")
def _(spark, d):
    return rounded(O.gini(persons(spark, d), "x", "w", ["seg"]), 6)


@query("gini_from_shares", f"WITH {PERSONS}, d AS (SELECT x * w AS y, ntile(5) OVER (ORDER BY x, id) AS k FROM persons), s AS (SELECT k, sum(y) / (SELECT sum(y) FROM d) AS s FROM d GROUP BY k), c AS (SELECT k, s, sum(s) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS q FROM s) SELECT round(1 - sum(0.2 * (q + q - s)), 6) AS gini, round(sum(s) FILTER (k <= 2), 6) AS low_40, round(sum(s) FILTER (k = 5) / sum(s) FILTER (k = 1), 6) AS extreme_ratio, round(sum(s) FILTER (k = 5) / sum(s) FILTER (k <= 2), 6) AS palma_type FROM c")
def _(spark, d):
    p = O.index_rows(persons(spark, d), ["x", "id"])
    n = F.broadcast(p.agg(F.count(F.lit(1)).alias("n")))
    # fifths as equal as may be, the larger ones first
    size, more = F.floor(F.col("n") / 5), F.col("n") % 5
    i = F.col("row_index") - 1
    k = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / size)) + 1
    s = p.crossJoin(n).groupBy(k.cast("int").alias("k")).agg(F.sum(F.col("x") * F.col("w")).alias("y"))
    s = s.withColumn("s", F.col("y") / F.sum("y").over(D.whole())).withColumn("q", F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    part = lambda c: F.sum(F.when(c, F.col("s")))
    return s.agg(r(1 - F.sum(0.2 * (2 * F.col("q") - F.col("s"))), 6).alias("gini"), r(part(F.col("k") <= 2), 6).alias("low_40"), r(part(F.col("k") == 5) / part(F.col("k") == 1), 6).alias("extreme_ratio"), r(part(F.col("k") == 5) / part(F.col("k") <= 2), 6).alias("palma_type"))


@query("income_deciles", f"""WITH {PERSONS}, {STEP.format(by="'a'")}, c AS (SELECT p, min(x) AS cut FROM s, (SELECT range / 10.0::DOUBLE AS p FROM range(1, 10)) WHERE cum >= p * total GROUP BY p), t AS (SELECT x, w, 1 + (SELECT count(*) FROM c WHERE cut < x) AS decile FROM persons)
SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n, CAST(sum(w) AS BIGINT) AS w, round(sum(w * x) / sum(w), 4) AS mean, round(sum(w * x) / sum(sum(w * x)) OVER (), 6) AS share FROM t GROUP BY decile""")
def _(spark, d):
    p = persons(spark, d)
    cuts = F.broadcast(O.quantiles_step(p, "x", "w", [k / 10 for k in range(1, 10)]).agg(F.array_sort(F.collect_list("q")).alias("cuts")))  # nine numbers
    t = p.crossJoin(cuts).withColumn("decile", (1 + F.size(F.filter("cuts", lambda c: c < F.col("x")))).cast("int")).groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"))
    return t.select("decile", "n", "w", r(F.col("wx") / F.col("w")).alias("mean"), r(F.col("wx") / F.sum("wx").over(D.whole()), 6).alias("share"))


@query("income_by_group", f"WITH {PERSONS}, {STEP.format(by='seg')}, m AS (SELECT g, min(x) AS median FROM s WHERE cum >= 0.5 * total GROUP BY g) SELECT seg, count(*) AS n, CAST(sum(w) AS BIGINT) AS w, round(sum(w * x) / sum(w), 4) AS mean, round(median, 6) AS median, round((sum(w * x) / sum(w)) / (SELECT sum(w * x) / sum(w) FROM persons), 6) AS ratio FROM persons JOIN m ON seg = g GROUP BY seg, median")
def _(spark, d):
    p = persons(spark, d)
    m = O.quantiles_step(p, "x", "w", [0.5], ["seg"]).select(F.col("seg").alias("s"), F.col("q").alias("median"))
    g = p.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"))
    mean = F.col("wx") / F.col("w")
    return g.withColumn("all", F.sum("wx").over(D.whole()) / F.sum("w").over(D.whole())).join(m, F.col("seg") == F.col("s")).select("seg", "n", "w", r(mean).alias("mean"), r("median", 6).alias("median"), r(mean / F.col("all"), 6).alias("ratio"))
