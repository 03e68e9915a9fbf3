"""Labour rates, standardisation, sampling and design-based estimates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import describe as D
from ..operators import order as O
from ..operators import rates as T
from ..operators import survey as V
from .registry import PERSONS, persons, query, r, rounded, table

A, E, U = "status IN ('F', 'O')", "status = 'F'", "status = 'O'"


def _s(cond: str):
    return F.sum(F.when(F.expr(cond), F.col("w")).otherwise(0))


@query("labour_rates", f"WITH {PERSONS} SELECT round(sum(w) FILTER ({A}) / sum(w), 6) AS activity, round(sum(w) FILTER ({E}) / sum(w), 6) AS employment, round(sum(w) FILTER ({U}) / sum(w) FILTER ({A}), 6) AS unemployment, round(CAST(count(*) FILTER ({U}) AS DOUBLE) / count(*) FILTER ({A}), 6) AS unemployment_plain FROM persons")
def _(spark, d):
    return persons(spark, d).agg(r(_s(A) / F.sum("w"), 6).alias("activity"), r(_s(E) / F.sum("w"), 6).alias("employment"), r(_s(U) / _s(A), 6).alias("unemployment"), r(F.count_if(F.expr(U)) / F.count_if(F.expr(A)), 6).alias("unemployment_plain"))


@query("labour_identity", f"WITH {PERSONS} SELECT seg, abs(sum(w) FILTER ({E}) / sum(w) - sum(w) FILTER ({A}) / sum(w) * (1 - sum(w) FILTER ({U}) / sum(w) FILTER ({A}))) < 1e-12 AS holds FROM persons GROUP BY seg")
def _(spark, d):
    return persons(spark, d).groupBy("seg").agg((F.abs(_s(E) / F.sum("w") - _s(A) / F.sum("w") * (1 - _s(U) / _s(A))) < 1e-12).alias("holds"))


@query("population_by_status", f"WITH {PERSONS} SELECT status, count(*) AS n, CAST(sum(w) AS BIGINT) AS w, round(sum(w) / sum(sum(w)) OVER (), 6) AS share FROM persons GROUP BY status")
def _(spark, d):
    return persons(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).withColumn("share", r(F.col("w") / F.sum("w").over(D.whole()), 6))


@query("informality_rate", f"WITH {PERSONS} SELECT grp, round(coalesce(sum(w) FILTER ({E} AND id % 3 = 0), 0) / sum(w) FILTER ({E}), 6) AS informality FROM persons GROUP BY grp")
def _(spark, d):
    return persons(spark, d).groupBy("grp").agg(r(_s(E + " AND id % 3 = 0") / _s(E), 6).alias("informality"))


@query("ratio_proportion_rate", f"WITH {PERSONS} SELECT stratum, round(CAST(count(*) FILTER ({E}) AS DOUBLE) / count(*) FILTER ({U}), 6) AS ratio, round(CAST(count(*) FILTER ({E}) AS DOUBLE) / count(*) FILTER ({A}), 6) AS proportion, round(1000.0::DOUBLE * count(*) FILTER (status = 'P') / count(*), 4) AS per_1000 FROM persons GROUP BY stratum")
def _(spark, d):
    n = lambda c: F.count_if(F.expr(c))
    return persons(spark, d).groupBy("stratum").agg(r(n(E) / F.nullif(n(U), F.lit(0)), 6).alias("ratio"), r(n(E) / F.nullif(n(A), F.lit(0)), 6).alias("proportion"), r(1000.0 * n("status = 'P'") / F.count(F.lit(1))).alias("per_1000"))


@query("counts_vs_rates", f"WITH {PERSONS}, t AS (SELECT stratum, count(*) AS pop, count(*) FILTER (status = 'P') AS cases FROM persons GROUP BY 1), k AS (SELECT *, 1000.0::DOUBLE * cases / pop AS rate FROM t), s AS (SELECT *, (rank() OVER (ORDER BY cases DESC) + count(*) OVER (PARTITION BY cases) / 2.0::DOUBLE - 0.5) AS by_count, (rank() OVER (ORDER BY round(rate, 9) DESC) + count(*) OVER (PARTITION BY round(rate, 9)) / 2.0::DOUBLE - 0.5) AS by_rate FROM k) SELECT round(avg(abs(by_count - by_rate)), 6) AS mean_move, round(corr(cases, pop), 6) AS corr_count, round(corr(rate, pop), 6) AS corr_rate FROM s")
def _(spark, d):
    t = persons(spark, d).groupBy("stratum").agg(F.count(F.lit(1)).alias("pop"), F.count_if(F.col("status") == "P").alias("cases")).withColumn("rate", 1000.0 * F.col("cases") / F.col("pop"))
    place = lambda c: F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(c))) + F.count(F.lit(1)).over(Window.partitionBy(c)) / 2 - 0.5
    s = t.withColumn("rr", F.round("rate", 9)).withColumn("by_count", place("cases")).withColumn("by_rate", place("rr"))
    return s.agg(r(F.avg(F.abs(F.col("by_count") - F.col("by_rate"))), 6).alias("mean_move"), r(F.corr("cases", "pop"), 6).alias("corr_count"), r(F.corr("rate", "pop"), 6).alias("corr_rate"))


@query("age_sex_pyramid", f"WITH {PERSONS}, t AS (SELECT CAST(greatest(age, 0) // 5 * 5 AS INTEGER) AS band, id % 2 = 0 AS man, w FROM persons) SELECT band, CAST(coalesce(sum(w) FILTER (man), 0) AS BIGINT) AS men, CAST(coalesce(sum(w) FILTER (NOT man), 0) AS BIGINT) AS women FROM t GROUP BY band")
def _(spark, d):
    t = persons(spark, d).select((F.floor(F.greatest("age", F.lit(0)) / 5) * 5).cast("int").alias("band"), F.when(F.col("id") % 2 == 0, "men").otherwise("women").alias("sex"), "w")
    return t.groupBy("band").pivot("sex", ["men", "women"]).agg(F.sum("w")).fillna(0)


@query("age_indices", f"WITH {PERSONS} SELECT round(sum(w) FILTER (age < 15) / sum(w), 6) AS young, round(sum(w) FILTER (age >= 65) / sum(w), 6) AS old, round(100.0 * sum(w) FILTER (age >= 65) / sum(w) FILTER (age < 15), 4) AS ageing, round(100.0 * (sum(w) FILTER (age < 15) + sum(w) FILTER (age >= 65)) / sum(w) FILTER (age BETWEEN 15 AND 64), 4) AS dependency FROM persons")
def _(spark, d):
    y, o = _s("age < 15"), _s("age >= 65")
    return persons(spark, d).agg(r(y / F.sum("w"), 6).alias("young"), r(o / F.sum("w"), 6).alias("old"), r(100.0 * o / y).alias("ageing"), r(100.0 * (y + o) / _s("age BETWEEN 15 AND 64")).alias("dependency"))


@query("deaths_by_age_group", f"WITH {PERSONS} SELECT count(*) AS n, round(CAST(count(*) FILTER (age >= 65) AS DOUBLE) / count(*), 6) AS share_old, count(*) FILTER (age < 1) AS under_one FROM persons WHERE status = 'P'")
def _(spark, d):
    return persons(spark, d).filter("status = 'P'").agg(F.count(F.lit(1)).alias("n"), r(F.count_if(F.col("age") >= 65) / F.count(F.lit(1)), 6).alias("share_old"), F.count_if(F.col("age") < 1).alias("under_one"))


# populations by age groups: suppliers' nations by part size

CELLS = """cells AS (SELECT s_nationkey AS pop, CAST((p_size - 1) // 10 AS INTEGER) AS grp, count(*) AS exposed, count(*) FILTER (l_returnflag = 'R') AS cases FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
std AS (SELECT 'world' AS standard, grp, CAST(sum(exposed) AS DOUBLE) AS weight FROM cells GROUP BY grp UNION ALL SELECT 'young', g, v FROM (VALUES (0, 5.0::DOUBLE), (1, 4.0::DOUBLE), (2, 3.0::DOUBLE), (3, 2.0::DOUBLE), (4, 1.0::DOUBLE)) t(g, v) UNION ALL SELECT 'equal', g, 1.0::DOUBLE FROM range(5) t(g)),
direct AS (SELECT standard, pop, sum(weight * cases / exposed) / sum(weight) AS rate, sum(weight * weight * cases / (CAST(exposed AS DOUBLE) * exposed)) / (sum(weight) * sum(weight)) AS variance, max(weight / exposed) AS top, CAST(sum(cases) AS DOUBLE) / sum(exposed) AS crude FROM cells JOIN std USING (grp) GROUP BY ALL)"""


def cells(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("s_nationkey").alias("pop"), F.floor((F.col("p_size") - 1) / 10).cast("int").alias("grp")).agg(F.count(F.lit(1)).alias("exposed"), F.count_if(F.col("l_returnflag") == "R").alias("cases"))


def standards(spark, d):
    world = cells(spark, d).groupBy("grp").agg(F.sum("exposed").cast("double").alias("weight")).select(F.lit("world").alias("standard"), "grp", "weight")
    return world.unionByName(spark.createDataFrame([("young", k, 5.0 - k) for k in range(5)] + [("equal", k, 1.0) for k in range(5)], "standard string, grp int, weight double"))


def direct(spark, d):
    """Rates under each standard structure, as rates.direct gives them."""
    return T.direct(cells(spark, d), standards(spark, d))


def place(col: str, by: str | None = None):
    return F.row_number().over(Window.partitionBy(by if by else F.lit(0)).orderBy(F.desc(F.round(col, 12)), "pop"))


@query("crude_and_specific_rates", f"WITH {CELLS} SELECT pop, grp, round(1000.0::DOUBLE * cases / exposed, 4) AS rate, round(CAST(exposed AS DOUBLE) / sum(exposed) OVER (PARTITION BY pop), 6) AS share, round(1000.0::DOUBLE * cases / sum(exposed) OVER (PARTITION BY pop), 4) AS contribution FROM cells")
def _(spark, d):
    total = F.sum("exposed").over(Window.partitionBy("pop"))
    return cells(spark, d).select("pop", "grp", r(1000.0 * F.col("cases") / F.col("exposed")).alias("rate"), r(F.col("exposed") / total, 6).alias("share"), r(1000.0 * F.col("cases") / total).alias("contribution"))


@query("join_standard_weights", f"WITH {CELLS} SELECT standard, pop, grp, cases, exposed, round(weight, 4) AS weight FROM cells JOIN std USING (grp)")
def _(spark, d):
    return cells(spark, d).join(F.broadcast(standards(spark, d).withColumnRenamed("grp", "g")), F.col("grp") == F.col("g")).select("standard", "pop", "grp", "cases", "exposed", r("weight").alias("weight"))


@query("direct_standardization", f"WITH {CELLS} SELECT pop, round(1000 * rate, 4) AS adjusted, round(1000 * crude, 4) AS crude, round(1000 * sqrt(variance), 6) AS se, round(top * 1000 / (SELECT sum(weight) FROM std WHERE standard = 'young'), 6) AS top, round(rate / crude - 1, 6) AS change, CAST(row_number() OVER (ORDER BY round(crude, 12) DESC, pop) AS INTEGER) AS crude_place, CAST(row_number() OVER (ORDER BY round(rate, 12) DESC, pop) AS INTEGER) AS adjusted_place FROM direct WHERE standard = 'young'")
def _(spark, d):
    t = direct(spark, d).filter("standard = 'young'")
    return t.select("pop", r(1000 * F.col("rate")).alias("adjusted"), r(1000 * F.col("crude")).alias("crude"), r(1000 * F.sqrt("variance"), 6).alias("se"), r(F.col("top") * 1000 / 15.0, 6).alias("top"), r(F.col("rate") / F.col("crude") - 1, 6).alias("change"), place("crude").alias("crude_place"), place("rate").alias("adjusted_place"))


@query("rank_shift", f"WITH {CELLS} SELECT pop, CAST(row_number() OVER (ORDER BY round(crude, 12) DESC, pop) - row_number() OVER (ORDER BY round(rate, 12) DESC, pop) AS INTEGER) AS shift FROM direct WHERE standard = 'young'")
def _(spark, d):
    t = direct(spark, d).filter("standard = 'young'").withColumn("a", place("crude")).withColumn("b", place("rate"))
    return t.select("pop", (F.col("a") - F.col("b")).alias("shift"))


INDIRECT = f"{CELLS}, ref AS (SELECT grp, CAST(sum(cases) AS DOUBLE) / sum(exposed) AS m FROM cells GROUP BY grp)"


@query("join_reference_rates", f"WITH {INDIRECT} SELECT pop, grp, cases, round(exposed * m, 6) AS expected FROM cells JOIN ref USING (grp)")
def _(spark, d):
    return T.expected(cells(spark, d)).select("pop", "grp", "cases", r("expected", 6).alias("expected"))


@query("indirect_standardization", f"WITH {INDIRECT}, e AS (SELECT pop, CAST(sum(cases) AS BIGINT) AS observed, sum(exposed * m) AS expected FROM cells JOIN ref USING (grp) GROUP BY pop) SELECT pop, observed, round(expected, 4) AS expected, round(observed / expected, 6) AS ratio, round(1000 * observed / expected * (SELECT CAST(sum(cases) AS DOUBLE) / sum(exposed) FROM cells), 4) AS rate, CAST(row_number() OVER (ORDER BY round(observed / expected, 12) DESC, pop) AS INTEGER) AS place FROM e")
def _(spark, d):
    e = T.indirect(cells(spark, d))
    return e.select("pop", "observed", r("expected").alias("expected"), r("ratio", 6).alias("ratio"), r(1000 * F.col("rate")).alias("rate"), place("ratio").alias("place"))


@query("by_standard", f"WITH {CELLS} SELECT standard, pop, round(1000 * rate, 4) AS rate FROM direct")
def _(spark, d):
    return direct(spark, d).select("standard", "pop", r(1000 * F.col("rate")).alias("rate"))


REV = "SELECT a.pop AS a, b.pop AS b, a.standard AS s, b2.standard AS t FROM direct a JOIN direct b ON a.standard = b.standard AND a.pop < b.pop JOIN direct a2 ON a2.pop = a.pop AND a2.standard > a.standard JOIN direct b2 ON b2.pop = b.pop AND b2.standard = a2.standard WHERE (a.rate - b.rate) * (a2.rate - b2.rate) < -1e-18"


def _reversals(spark, d):
    t = direct(spark, d).select("standard", "pop", "rate")
    k = lambda n: t.select(F.col("standard").alias(f"s{n}"), F.col("pop").alias(f"p{n}"), F.col("rate").alias(f"r{n}"))
    j = k(1).join(k(2), (F.col("s1") == F.col("s2")) & (F.col("p1") < F.col("p2"))).join(k(3), (F.col("p3") == F.col("p1")) & (F.col("s3") > F.col("s1"))).join(k(4), (F.col("p4") == F.col("p2")) & (F.col("s4") == F.col("s3")))
    return j.filter((F.col("r1") - F.col("r2")) * (F.col("r3") - F.col("r4")) < -1e-18).select(F.col("p1").alias("a"), F.col("p2").alias("b"), F.col("s1").alias("s"), F.col("s3").alias("t"))


@query("rank_reversals", f"WITH {CELLS} {REV}")
def _(spark, d):
    return _reversals(spark, d)


@query("standards_pairs", f"WITH {CELLS}, v AS ({REV}) SELECT s, t, count(*) AS reversals FROM v GROUP BY ALL")
def _(spark, d):
    return _reversals(spark, d).groupBy("s", "t").agg(F.count(F.lit(1)).alias("reversals"))


@query("rate_levels", f"WITH {CELLS} SELECT pop, round(1000 * min(rate), 4) AS low, round(1000 * max(rate), 4) AS high, round(max(rate) / min(rate), 6) AS ratio, arg_max(standard, {{'r': round(rate, 12), 's': standard}}) AS highest FROM direct GROUP BY pop")
def _(spark, d):
    return direct(spark, d).groupBy("pop").agg(r(1000 * F.min("rate")).alias("low"), r(1000 * F.max("rate")).alias("high"), r(F.max("rate") / F.min("rate"), 6).alias("ratio"), F.max_by("standard", F.struct(F.round("rate", 12), "standard")).alias("highest"))


PARTS = f"{CELLS}, t AS (SELECT pop, grp, CAST(cases AS DOUBLE) / exposed AS m, CAST(exposed AS DOUBLE) / sum(exposed) OVER (PARTITION BY pop) AS c FROM cells), k AS (SELECT a.pop AS a, b.pop AS b, a.grp AS grp, (a.c - b.c) * (a.m + b.m) / 2 AS s, (a.m - b.m) * (a.c + b.c) / 2 AS r, a.c * a.m - b.c * b.m AS d FROM t a JOIN t b ON a.grp = b.grp AND a.pop < b.pop)"


def kitagawa(spark, d):
    return T.kitagawa(cells(spark, d))


@query("kitagawa_decomposition", f"WITH {PARTS} SELECT a, b, round(1000 * sum(s), 6) AS structure, round(1000 * sum(r), 6) AS rates, round(1000 * sum(d), 6) AS difference, abs(sum(s) + sum(r) - sum(d)) < 1e-12 AS adds_up FROM k GROUP BY ALL")
def _(spark, d):
    """The difference of every pair of populations by structure and rates, and whether the two add up to it."""
    whole = [r(1000 * F.sum(k), 6).alias(n) for k, n in (("s", "structure"), ("r", "rates"), ("d", "difference"))]
    return kitagawa(spark, d).groupBy("a", "b").agg(*whole, (F.abs(F.sum("s") + F.sum("r") - F.sum("d")) < 1e-12).alias("adds_up"))


@query("kitagawa_by_group", f"WITH {PARTS} SELECT a, b, grp, round(1000 * s, 6) AS structure, round(1000 * r, 6) AS rates, round(1000 * d, 6) AS difference FROM k")
def _(spark, d):
    return kitagawa(spark, d).select("a", "b", "grp", *[r(1000 * F.col(k), 6).alias(n) for k, n in (("s", "structure"), ("r", "rates"), ("d", "difference"))])


@query("overlap_flags", f"WITH {CELLS}, t AS (SELECT pop, rate, rate - 1.96::DOUBLE * sqrt(variance) AS lo, rate + 1.96::DOUBLE * sqrt(variance) AS hi FROM direct WHERE standard = 'young') SELECT pop, lo <= lead(hi) OVER w AND lead(lo) OVER w <= hi AS overlaps_next FROM t WINDOW w AS (ORDER BY rate DESC, pop)")
def _(spark, d):
    t = direct(spark, d).filter("standard = 'young'").withColumn("lo", F.col("rate") - 1.96 * F.sqrt("variance")).withColumn("hi", F.col("rate") + 1.96 * F.sqrt("variance"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("rate"), "pop")
    return t.select("pop", ((F.col("lo") <= F.lead("hi").over(w)) & (F.lead("lo").over(w) <= F.col("hi"))).alias("overlaps_next"))


@query("province_indicators", "WITH c AS (SELECT c_nationkey AS k, round(100.0::DOUBLE * count(*) FILTER (c_acctbal < 0) / count(*), 4) AS pct_debt, round(avg(c_acctbal), 4) AS mean_balance FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT n_name, pct_debt, mean_balance, suppliers FROM nation JOIN c ON n_nationkey = c.k JOIN s ON n_nationkey = s.k")
def _(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("a")).agg(r(100.0 * F.count_if(F.col("c_acctbal") < 0) / F.count(F.lit(1))).alias("pct_debt"), r(F.avg("c_acctbal")).alias("mean_balance"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("suppliers"))
    return table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("a")).join(s, F.col("n_nationkey") == F.col("b")).select("n_name", "pct_debt", "mean_balance", "suppliers")


@query("agglomerate_indicators", f"WITH {PERSONS} SELECT stratum, count(*) AS n, round(sum(w) FILTER ({A}) / sum(w), 6) AS activity, round(sum(w) FILTER ({U}) / sum(w) FILTER ({A}), 6) AS unemployment, round(sum(w * x) / sum(w), 4) AS mean, round(sum(w) FILTER (age >= 65) / sum(w), 6) AS old FROM persons GROUP BY stratum HAVING count(*) >= 100")
def _(spark, d):
    return persons(spark, d).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), r(_s(A) / F.sum("w"), 6).alias("activity"), r(_s(U) / _s(A), 6).alias("unemployment"), r(F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"), r(_s("age >= 65") / F.sum("w"), 6).alias("old")).filter("n >= 100")


# complex design

def design_sql(domain: str, y: str, x: str) -> str:
    g = f"{domain} AS g, " if domain else "'all' AS g, "
    return f"""a AS (SELECT stratum, count(DISTINCT psu) AS a FROM persons GROUP BY 1), t AS (SELECT {g}stratum, psu, sum(w * ({y})) AS y, sum(w * ({x})) AS x FROM persons GROUP BY ALL), p AS (SELECT g, sum(y) / sum(x) AS p, sum(x) AS tx FROM t GROUP BY g),
z AS (SELECT g, p, tx, stratum, sum(y - p * x) AS sz, sum((y - p * x) * (y - p * x)) AS szz FROM t JOIN p USING (g) GROUP BY ALL), v AS (SELECT g, p, tx, sum(CASE WHEN a > 1 THEN CAST(a AS DOUBLE) / (a - 1) * (szz - sz * sz / a) ELSE 0 END) AS v FROM z JOIN a USING (stratum) GROUP BY ALL),
est AS (SELECT g, p, sqrt(v) / abs(tx) AS se, (SELECT CAST(greatest(sum(a) - count(*), 1) AS BIGINT) FROM a) AS df, (SELECT CAST(sum(a) AS BIGINT) FROM a) AS n_psu, (SELECT count(*) FROM a WHERE a = 1) AS lonely FROM v)"""


Y, X = f"CASE WHEN {U} THEN 1.0::DOUBLE ELSE 0 END", f"CASE WHEN {A} THEN 1.0::DOUBLE ELSE 0 END"


def _flag(c: str):
    return F.when(F.expr(c), 1.0).otherwise(0.0)


@query("ratio_estimate", f"WITH {PERSONS}, {design_sql('', Y, X)} SELECT round(p, 6) AS p, round(se, 8) AS se, df, n_psu, lonely FROM est")
def _(spark, d):
    return V.ratio_estimate(persons(spark, d), "stratum", "psu", F.col("w"), _flag(U), _flag(A)).select(r("p", 6).alias("p"), r("se", 8).alias("se"), "df", "n_psu", "lonely")


@query("domain_estimates", f"WITH {PERSONS}, {design_sql('seg', Y, X)} SELECT g AS seg, round(p, 6) AS p, round(se, 8) AS se, df, n_psu, lonely FROM est")
def _(spark, d):
    return V.ratio_estimate(persons(spark, d), "stratum", "psu", F.col("w"), _flag(U), _flag(A), ["seg"]).select("seg", r("p", 6).alias("p"), r("se", 8).alias("se"), "df", "n_psu", "lonely")


@query("estimate_by_stratum", f"WITH {PERSONS}, {design_sql('stratum', 'x', '1.0::DOUBLE')} SELECT g AS stratum, round(p, 4) AS mean, round(se, 6) AS se FROM est")
def _(spark, d):
    p = persons(spark, d).withColumn("h", F.col("stratum"))
    return V.ratio_estimate(p, "stratum", "psu", F.col("w"), F.col("x"), F.lit(1.0), ["h"]).select(F.col("h").alias("stratum"), r("p").alias("mean"), r("se", 6).alias("se"))


@query("naive_estimate", f"WITH {PERSONS} SELECT grp, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x) / sqrt(count(*)) * sqrt(1 - 1.0::DOUBLE / 4), 6) AS se FROM persons GROUP BY grp")
def _(spark, d):
    return persons(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), r(F.avg("x")).alias("mean"), r(F.stddev_samp("x") / F.sqrt(F.count(F.lit(1))) * F.sqrt(F.lit(0.75)), 6).alias("se"))


@query("design_effect", f"WITH {PERSONS}, {design_sql('', 'x', '1.0::DOUBLE')}, n AS (SELECT count(*) AS n, var_samp(x) / count(*) AS v0 FROM persons) SELECT round(se * se / v0, 6) AS deff, round(n / (se * se / v0), 4) AS effective_n FROM est, n")
def _(spark, d):
    p = persons(spark, d)
    e = V.ratio_estimate(p, "stratum", "psu", F.col("w"), F.col("x"), F.lit(1.0))
    n = p.agg(F.count(F.lit(1)).alias("n"), (F.var_samp("x") / F.count(F.lit(1))).alias("v0"))
    deff = F.col("se") * F.col("se") / F.col("v0")
    return e.crossJoin(n).select(r(deff, 6).alias("deff"), r(F.col("n") / deff).alias("effective_n"))


@query("estimate_mean_total_prop", f"WITH {PERSONS}, f AS (SELECT stratum, 0.1::DOUBLE + stratum / 100.0::DOUBLE AS f FROM persons GROUP BY 1), t AS (SELECT stratum, psu, sum(w * x) AS z FROM persons GROUP BY ALL), h AS (SELECT stratum, count(*) AS a, sum(z) AS sz, sum(z * z) AS szz FROM t GROUP BY 1) SELECT round(sum(sz), 2) AS total, round(sqrt(sum(CASE WHEN a > 1 THEN (1 - f) * a / (a - 1) * (szz - sz * sz / a) ELSE 0 END)), 2) AS se_total FROM h JOIN f USING (stratum)")
def _(spark, d):
    p = persons(spark, d)
    f = p.select("stratum").distinct().withColumn("f", 0.1 + F.col("stratum") / 100)
    return rounded(V.mean_total(p, "stratum", "psu", F.col("w"), F.col("x"), f), 2)


# selections from a frame: customers by nation, clusters of twenty

FRAME = "frame AS (SELECT c_custkey AS unit, c_nationkey AS stratum, c_custkey // 20 AS psu, c_acctbal AS y, c_mktsegment AS cell FROM customer)"
HASH = "CAST(CAST('0x' || substr(md5('{s}:' || {u}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"


def frame(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("stratum"), F.floor(F.col("c_custkey") / 20).alias("psu"), F.col("c_acctbal").alias("y"), F.col("c_mktsegment").alias("cell"))


@query("srs_fixed_n", f"WITH {FRAME} SELECT unit FROM frame ORDER BY {HASH.format(s='srs', u='unit')}, unit LIMIT 100")
def _(spark, d):
    return V.srs_fixed_n(frame(spark, d), "unit", 100, "srs").select("unit")


@query("systematic", f"WITH {FRAME}, i AS (SELECT unit, row_number() OVER (ORDER BY stratum, unit) AS i, count(*) OVER () AS n FROM frame) SELECT unit FROM i WHERE ceil(i / (n / 100.0::DOUBLE) - 0.37) > ceil((i - 1) / (n / 100.0::DOUBLE) - 0.37)")
def _(spark, d):
    f = O.index_rows(frame(spark, d), ["stratum", "unit"])
    n = F.broadcast(f.agg(F.count(F.lit(1)).alias("n")))
    step = F.col("n") / 100.0
    return f.crossJoin(n).filter(F.ceil(F.col("row_index") / step - 0.37) > F.ceil((F.col("row_index") - 1) / step - 0.37)).select("unit")


def alloc_sql(m: str) -> str:
    return f"m AS (SELECT stratum, count(*) AS n_all, {m} AS m FROM frame GROUP BY 1), s AS (SELECT *, 120 * m / sum(m) OVER () AS share FROM m), b AS (SELECT *, floor(share) AS base FROM s), al AS (SELECT stratum, n_all, CAST(least(n_all, greatest(2, base + CASE WHEN row_number() OVER (ORDER BY round(share - base, 9) DESC, stratum) <= 120 - sum(base) OVER () THEN 1 ELSE 0 END)) AS BIGINT) AS n_h FROM b)"


@query("allocate_proportional", f"WITH {FRAME}, {alloc_sql('CAST(count(*) AS DOUBLE)')} SELECT stratum, n_all AS frame_n, n_h FROM al")
def _(spark, d):
    return V.allocate(frame(spark, d), "stratum", 120)


@query("allocate_neyman", f"WITH {FRAME}, {alloc_sql('count(*) * stddev_samp(y)')} SELECT stratum, n_all AS frame_n, n_h FROM al")
def _(spark, d):
    return V.allocate(frame(spark, d), "stratum", 120, F.col("y"))


@query("stratified_sample", f"WITH {FRAME}, {alloc_sql('CAST(count(*) AS DOUBLE)')}, o AS (SELECT unit, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {HASH.format(s='st', u='unit')}, unit) AS k FROM frame) SELECT unit, round(CAST(n_h AS DOUBLE) / n_all, 6) AS pi FROM o JOIN al USING (stratum) WHERE k <= n_h")
def _(spark, d):
    f = frame(spark, d)
    return V.stratified_sample(f, "stratum", "unit", V.allocate(f, "stratum", 120), "st").select("unit", r("pi", 6).alias("pi"))


@query("two_stage_sample", f"WITH {FRAME}, g AS (SELECT stratum, psu, count(*) AS m FROM frame GROUP BY stratum, psu), c AS (SELECT stratum, psu, m, row_number() OVER (PARTITION BY stratum ORDER BY {HASH.format(s='ts1', u='psu')}, psu) AS k, count(*) OVER (PARTITION BY stratum) AS a FROM g), u AS (SELECT f.unit, c.m, c.a, row_number() OVER (PARTITION BY f.stratum, f.psu ORDER BY {HASH.format(s='ts2', u='f.unit')}, f.unit) AS k FROM frame f JOIN c ON f.stratum = c.stratum AND f.psu = c.psu WHERE c.k <= 5) SELECT unit, round(least(5, a) / CAST(a AS DOUBLE) * least(2, m) / m, 6) AS pi FROM u WHERE k <= 2")
def _(spark, d):
    return V.two_stage_sample(frame(spark, d), "stratum", "psu", "unit", 5, 2, "ts").select("unit", r("pi", 6).alias("pi"))


@query("pps_with_replacement", f"WITH {FRAME}, z AS (SELECT unit, abs(y) + 1 AS w FROM frame), k AS (SELECT unit, sum(w) OVER (ORDER BY unit) / sum(w) OVER () AS hi, w / sum(w) OVER () AS w FROM z), d AS (SELECT draw, {HASH.format(s='pps', u='draw')} AS u FROM (SELECT unnest(range(500)) AS draw)) SELECT draw, unit FROM d JOIN k ON u < hi AND u >= hi - w")
def _(spark, d):
    """Draws with chances in proportion to weight: each draw's uniform falls into the unit's range of the running weight."""
    f = frame(spark, d).withColumn("size", F.abs("y") + 1)
    s = O.prefix_sums(f, [], "unit", {"w": F.col("size")}).select("unit", (F.col("w_before") / F.col("w_all")).alias("lo"), ((F.col("w_before") + F.col("w")) / F.col("w_all")).alias("hi"))
    from ..functions.scalars import hash_uniform

    draws = 500
    # the draws whose uniforms lie in a unit's range, by the hundredths that the range touches
    u = spark.range(draws).select(F.col("id").alias("draw"), hash_uniform("pps", "id").alias("u")).withColumn("slot", F.floor(F.col("u") * 100))
    slots = s.withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo") * 100), F.floor(F.col("hi") * 100))))
    return slots.join(F.broadcast(u), "slot").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", "unit")


SAMPLE = f"{FRAME}, {alloc_sql('CAST(count(*) AS DOUBLE)')}, o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {HASH.format(s='sw', u='unit')}, unit) AS k FROM frame), smp AS (SELECT o.*, CAST(n_all AS DOUBLE) / n_h AS w, unit % 5 <> 0 AS answered FROM o JOIN al USING (stratum) WHERE k <= n_h)"


def sample(spark, d):
    """A stratified sample with its weights; of its units, those divisible by five did not answer."""
    f = frame(spark, d)
    return V.stratified_sample(f, "stratum", "unit", V.allocate(f, "stratum", 120), "sw").withColumn("w", F.col("frame_n") / F.col("n_h")).withColumn("answered", F.col("unit") % 5 != 0)


@query("design_weights", f"WITH {FRAME}, {alloc_sql('CAST(count(*) AS DOUBLE)')} SELECT stratum, round(CAST(n_all AS DOUBLE) / n_h, 6) AS weight FROM al")
def _(spark, d):
    return V.allocate(frame(spark, d), "stratum", 120).select("stratum", r(F.col("frame_n") / F.col("n_h"), 6).alias("weight"))


@query("nonresponse_adjustment", f"WITH {SAMPLE}, c AS (SELECT stratum, sum(w) / sum(w) FILTER (answered) AS f FROM smp GROUP BY 1) SELECT unit, round(w * f, 6) AS weight_nr FROM smp JOIN c USING (stratum) WHERE answered")
def _(spark, d):
    return V.adjust_by_cell(sample(spark, d), "stratum", "w", F.col("answered")).select("unit", r("weight_nr", 6).alias("weight_nr"))


@query("poststratify", f"WITH {SAMPLE}, n AS (SELECT cell, count(*) AS n FROM frame GROUP BY 1), e AS (SELECT cell, sum(w) AS e FROM smp GROUP BY 1) SELECT unit, round(w * n / e, 6) AS weight_ps FROM smp JOIN n USING (cell) JOIN e USING (cell)")
def _(spark, d):
    counts = frame(spark, d).groupBy("cell").agg(F.count(F.lit(1)).alias("N"))
    return V.poststratify(sample(spark, d), "cell", "w", counts).select("unit", r("weight_ps", 6).alias("weight_ps"))


@query("weight_summary", f"WITH {SAMPLE} SELECT count(*) AS n, round(sum(w), 4) AS total, round(min(w), 6) AS min, round(max(w), 6) AS max, round(stddev_samp(w) / avg(w), 6) AS cv, round(max(w) / min(w), 6) AS ratio, round(count(*) * sum(w * w) / (sum(w) * sum(w)), 6) AS deff, round(sum(w) * sum(w) / sum(w * w), 4) AS effective_n FROM smp")
def _(spark, d):
    s = V.weight_summary(sample(spark, d), "w")
    return s.select("n", r("total").alias("total"), r("min", 6).alias("min"), r("max", 6).alias("max"), r("cv", 6).alias("cv"), r("ratio", 6).alias("ratio"), r("deff", 6).alias("deff"), r("effective_n").alias("effective_n"))


@query("design_fractions", f"WITH {SAMPLE}, a AS (SELECT stratum, count(DISTINCT psu) AS a FROM frame GROUP BY 1), s2 AS (SELECT stratum, count(DISTINCT psu) AS b FROM smp GROUP BY 1) SELECT stratum, round(CAST(b AS DOUBLE) / a, 6) AS f FROM a JOIN s2 USING (stratum)")
def _(spark, d):
    a = frame(spark, d).groupBy("stratum").agg(F.count_distinct("psu").alias("a"))
    b = sample(spark, d).groupBy("stratum").agg(F.count_distinct("psu").alias("b"))
    return a.join(b, "stratum").select("stratum", r(F.col("b") / F.col("a"), 6).alias("f"))


# replicates: draws come from hashes, so SQL makes the same ones

def drawn_sql(source: str, seed: str, unit: str, n: int) -> str:
    """source with rep and times, for text unit parts joined by colons."""
    u = HASH.format(s=seed, u=f"{unit} || ':' || rep")
    times = " + ".join(f"(u >= {edge!r})::INTEGER" for edge in V.poisson_edges())
    return f"(SELECT * FROM (SELECT *, {times} AS times FROM (SELECT *, {u} AS u FROM {source}, (SELECT unnest(generate_series(1, {n})) AS rep))) WHERE times > 0)"


@query("cluster_bootstrap", f"WITH {PERSONS}, c AS (SELECT psu, sum(w * x) AS y, CAST(sum(w) AS DOUBLE) AS n FROM persons GROUP BY 1), t AS (SELECT rep, sum(times * y) / sum(times * n) AS t FROM {drawn_sql('c', 'cb', 'psu', 200)} GROUP BY rep) SELECT round(avg(t), 4) AS mean, round(stddev_samp(t), 6) AS se, count(*) AS replicates FROM t")
def _(spark, d):
    """mean, se: dwellings drawn whole, 200 replicates."""
    c = persons(spark, d).groupBy("psu").agg(F.sum(F.col("w") * F.col("x")).alias("y"), F.sum("w").alias("n"))
    t = V.replicates(c, "psu", 200, "cb").groupBy("rep").agg((F.sum(F.col("times") * F.col("y")) / F.sum(F.col("times") * F.col("n"))).alias("t"))
    return t.agg(r(F.avg("t")).alias("mean"), r(F.stddev_samp("t"), 6).alias("se"), F.count(F.lit(1)).alias("replicates"))


@query("stratified_cluster_bootstrap", f"WITH {PERSONS}, c AS (SELECT stratum, psu, sum(w * x) AS y, CAST(sum(w) AS DOUBLE) AS n FROM persons GROUP BY ALL), h AS (SELECT stratum, sum(n) AS n0 FROM c GROUP BY 1), b AS (SELECT rep, stratum, sum(times * y) / sum(times * n) AS m FROM {drawn_sql('c', 'sb', 'stratum || chr(58) || psu', 200)} GROUP BY ALL), t AS (SELECT rep, sum(m * n0) / sum(n0) AS t FROM b JOIN h USING (stratum) GROUP BY rep) SELECT round(avg(t), 4) AS mean, round(stddev_samp(t), 6) AS se, count(*) AS replicates FROM t")
def _(spark, d):
    c = persons(spark, d).groupBy("stratum", "psu").agg(F.sum(F.col("w") * F.col("x")).alias("y"), F.sum("w").alias("n"))
    t = V.replicates(c, "psu", 200, "sb", ["stratum"]).groupBy("rep", "stratum").agg(F.sum(F.col("times") * F.col("y")).alias("y"), F.sum(F.col("times") * F.col("n")).alias("n"))
    true = c.groupBy(F.col("stratum").alias("h")).agg(F.sum("n").alias("n0"))
    t = t.join(F.broadcast(true), F.col("stratum") == F.col("h")).groupBy("rep").agg((F.sum(F.col("y") / F.col("n") * F.col("n0")) / F.sum("n0")).alias("t"))
    return t.agg(r(F.avg("t")).alias("mean"), r(F.stddev_samp("t"), 6).alias("se"), F.count(F.lit(1)).alias("replicates"))


@query("subpopulation_bootstrap", f"WITH {PERSONS}, c AS (SELECT psu, sum(CASE WHEN seg = 'BUILDING' THEN w * x ELSE 0 END) AS y, CAST(sum(CASE WHEN seg = 'BUILDING' THEN w ELSE 0 END) AS DOUBLE) AS n FROM persons GROUP BY 1), b AS (SELECT * FROM {drawn_sql('c', 'sp', 'psu', 200)}), t AS (SELECT way, rep, sum(times * y) / sum(times * n) AS t FROM b, (VALUES ('domain'), ('filter')) v(way) WHERE way = 'domain' OR n > 0 GROUP BY ALL) SELECT way, round(stddev_samp(t), 6) AS se FROM t GROUP BY way")
def _(spark, d):
    """way, se: a group's mean with all clusters kept (zero-filled), and after filtering first."""
    own = F.col("seg") == "BUILDING"
    c = persons(spark, d).groupBy("psu").agg(F.sum(F.when(own, F.col("w") * F.col("x")).otherwise(0)).alias("y"), F.sum(F.when(own, F.col("w")).otherwise(0)).alias("n"))
    ways = V.replicates(c, "psu", 200, "sp").withColumn("way", F.explode(F.array(F.lit("domain"), F.lit("filter")))).filter("way = 'domain' OR n > 0")
    t = ways.groupBy("way", "rep").agg((F.sum(F.col("times") * F.col("y")) / F.sum(F.col("times") * F.col("n"))).alias("t"))
    return t.groupBy("way").agg(r(F.stddev_samp("t"), 6).alias("se"))


@query("rank_uncertainty_bootstrap", f"WITH {PERSONS}, c AS (SELECT stratum, psu, sum(w * x) AS y, CAST(sum(w) AS DOUBLE) AS n FROM persons GROUP BY ALL), t AS (SELECT rep, stratum, sum(times * y) / sum(times * n) AS t FROM {drawn_sql('c', 'rk', 'stratum || chr(58) || psu', 100)} GROUP BY ALL), p AS (SELECT stratum, row_number() OVER (PARTITION BY rep ORDER BY t DESC, stratum) AS place FROM t) SELECT stratum, quantile_cont(CAST(place AS DOUBLE), 0.05) AS low, quantile_cont(CAST(place AS DOUBLE), 0.95) AS high FROM p GROUP BY stratum")
def _(spark, d):
    """stratum, low, high: the 5th and 95th percentile of its place over 100 replicates."""
    c = persons(spark, d).groupBy("stratum", "psu").agg(F.sum(F.col("w") * F.col("x")).alias("y"), F.sum("w").alias("n"))
    t = V.replicates(c, "psu", 100, "rk", ["stratum"]).groupBy("rep", "stratum").agg((F.sum(F.col("times") * F.col("y")) / F.sum(F.col("times") * F.col("n"))).alias("t"))
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("t"), "stratum")))
    return t.groupBy("stratum").agg(F.percentile("place", 0.05).alias("low"), F.percentile("place", 0.95).alias("high"))


@query("sampling_plan_replicates", f"WITH {FRAME}, c AS (SELECT stratum, psu, sum(y) AS y, sum(y * y) AS yy, count(*) AS n FROM frame GROUP BY ALL), r AS (SELECT *, {HASH.format(s='plan', u="rep || ':' || stratum || ':' || psu")} AS u FROM c, (SELECT unnest(generate_series(1, 100)) AS rep)), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep, stratum ORDER BY u, psu) AS k FROM r) WHERE k <= 6), m AS (SELECT rep, sum(y) AS sy, sum(n) AS sn, sum(yy) AS syy, sum(y) / sum(n) AS m FROM s GROUP BY rep), h AS (SELECT rep, stratum, count(*) AS a, sum(y - m * n) AS sz, sum((y - m * n) * (y - m * n)) AS szz FROM s JOIN m USING (rep) GROUP BY ALL), v AS (SELECT rep, sum(CASE WHEN a > 1 THEN CAST(a AS DOUBLE) / (a - 1) * (szz - sz * sz / a) ELSE 0 END) AS v FROM h GROUP BY rep), e AS (SELECT m, sqrt(v) / sn AS se, sqrt((syy - sy * sy / sn) / (sn - 1) / sn) AS se0, (SELECT avg(y) FROM frame) AS true_mean FROM v JOIN m USING (rep)) SELECT round(avg(CASE WHEN abs(m - true_mean) <= 1.96 * se THEN 1.0::DOUBLE ELSE 0 END), 4) AS coverage_design, round(avg(CASE WHEN abs(m - true_mean) <= 1.96 * se0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS coverage_naive, round(avg(se), 4) AS mean_se, count(*) AS replicates FROM e")
def _(spark, d):
    """coverage of the design interval and of the naive one over 100 selections of the real frame."""
    from ..functions.scalars import hash_uniform

    f = frame(spark, d)
    true = F.broadcast(f.agg(F.avg("y").alias("true")))
    c = f.groupBy("stratum", "psu").agg(F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).alias("n"))
    a = c.groupBy(F.col("stratum").alias("h")).agg(F.count(F.lit(1)).alias("a"))
    c = c.join(F.broadcast(a), F.col("stratum") == F.col("h")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(100)))).withColumn("_u", hash_uniform("plan", "rep", "stratum", "psu"))
    pick = Window.partitionBy("rep", "stratum").orderBy("_u", "psu")
    s = c.filter(V.likely(F.col("a"), F.lit(6))).withColumn("k", F.row_number().over(pick)).filter("k <= 6").drop("h", "a", "_u")
    mean = s.groupBy("rep").agg(F.sum("y").alias("sy"), F.sum("n").alias("sn"), F.sum("yy").alias("syy")).withColumn("m", F.col("sy") / F.col("sn"))
    z = s.select("rep", "stratum", F.col("y").alias("cy"), F.col("n").alias("cn")).join(mean.withColumnRenamed("rep", "q"), F.col("rep") == F.col("q")).withColumn("z", F.col("cy") - F.col("m") * F.col("cn"))
    h = z.groupBy("rep", "stratum", "m", "sn", "syy", "sy").agg(F.count(F.lit(1)).alias("a"), F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("szz"))
    v = h.groupBy("rep", "m", "sn", "syy", "sy").agg(F.sum(F.when(F.col("a") > 1, F.col("a") / (F.col("a") - 1) * (F.col("szz") - F.col("sz") * F.col("sz") / F.col("a"))).otherwise(0)).alias("v"))
    e = v.withColumn("se", F.sqrt("v") / F.col("sn")).withColumn("se0", F.sqrt((F.col("syy") - F.col("sy") * F.col("sy") / F.col("sn")) / (F.col("sn") - 1) / F.col("sn"))).crossJoin(true)
    hit = lambda se: F.avg((F.abs(F.col("m") - F.col("true")) <= 1.96 * F.col(se)).cast("int"))
    return e.agg(r(hit("se")).alias("coverage_design"), r(hit("se0")).alias("coverage_naive"), r(F.avg("se"), 4).alias("mean_se"), F.count(F.lit(1)).alias("replicates"))
