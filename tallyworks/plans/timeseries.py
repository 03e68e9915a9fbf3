"""Monthly series and price indices from lines and their ship dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series as T
from .registry import query, r, rounded, table

M = "m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / 1000 AS value, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS qty FROM lineitem GROUP BY 1)"
I = f"{M}, i AS (SELECT month, value / qty * 100 AS value FROM m)"
B = "m AS (SELECT p_brand AS brand, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / 1000 AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def monthly(spark, d):
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return table(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("month")).agg((dec("l_extendedprice") / 1000).alias("value"), dec("l_quantity").alias("qty"))


def index(spark, d):
    return monthly(spark, d).select("month", (F.col("value") / F.col("qty") * 100).alias("value"))


def brands(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_brand").alias("brand"), F.trunc("l_shipdate", "month").alias("month")).agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / 1000).alias("value"))


@query("read_monthly_series", f"WITH {M} SELECT month, round(value, 6) AS value FROM m ORDER BY month")
def _(spark, d):
    return monthly(spark, d).select("month", r("value", 6).alias("value")).orderBy("month")


@query("monthly_totals", "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY 1 HAVING sum(l_quantity) <> 0")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("total")).filter("total <> 0")


@query("monthly_change", f"WITH {B} SELECT brand, month, round(value / lag(value) OVER (PARTITION BY brand ORDER BY month) - 1, 6) AS change FROM m")
def _(spark, d):
    return T.changes(brands(spark, d), ["brand"]).select("brand", "month", r("monthly", 6).alias("change"))


@query("yearly_change", f"WITH {B} SELECT brand, month, round(value / lag(value, 12) OVER (PARTITION BY brand ORDER BY month) - 1, 6) AS change FROM m")
def _(spark, d):
    return T.changes(brands(spark, d), ["brand"]).select("brand", "month", r("yearly", 6).alias("change"))


@query("year_to_date_change", f"WITH {I} SELECT a.month, round(a.value / b.value - 1, 6) AS change FROM i a LEFT JOIN i b ON year(b.month) = year(a.month) - 1 AND month(b.month) = 12")
def _(spark, d):
    return T.changes(index(spark, d), []).select("month", r("year_to_date", 6).alias("change"))


@query("december_to_december", f"WITH {I} SELECT CAST(year(month) AS INTEGER) AS y, round(value / lag(value) OVER (ORDER BY month) - 1, 6) AS change FROM i WHERE month(month) = 12")
def _(spark, d):
    w = Window.partitionBy(F.lit(0)).orderBy("month")
    return index(spark, d).filter(F.month("month") == 12).select(F.year("month").alias("y"), r(F.col("value") / F.lag("value").over(w) - 1, 6).alias("change"))


@query("chained_vs_summed", f"WITH {I}, c AS (SELECT month, value / lag(value) OVER (ORDER BY month) - 1 AS g FROM i) SELECT CAST(year(month) AS INTEGER) AS y, round(exp(sum(ln(1 + g))) - 1, 6) AS chained, round(sum(g), 6) AS summed FROM c WHERE g IS NOT NULL GROUP BY 1")
def _(spark, d):
    c = T.changes(index(spark, d), []).filter("monthly IS NOT NULL")
    return c.groupBy(F.year("month").alias("y")).agg(r(F.exp(F.sum(F.ln(1 + F.col("monthly")))) - 1, 6).alias("chained"), r(F.sum("monthly"), 6).alias("summed"))


@query("series_gap_check", f"WITH {M}, k AS (SELECT month FROM m WHERE month(month) <> 5), e AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM k) SELECT month AS missing FROM e ANTI JOIN k USING (month)")
def _(spark, d):
    k = monthly(spark, d).filter(F.month("month") != 5).select(F.col("month").alias("m"))
    e = k.agg(F.min("m").alias("a"), F.max("m").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("missing"))
    return e.join(k, F.col("missing") == F.col("m"), "left_anti")


@query("series_falls", f"WITH {I}, c AS (SELECT month, value < lag(value) OVER (ORDER BY month) AS falls FROM i) SELECT month FROM c WHERE falls")
def _(spark, d):
    return T.changes(index(spark, d), []).filter("monthly < 0").select("month")


@query("rebase_index", f"WITH {I} SELECT month, round(100 * value / (SELECT value FROM i WHERE month = DATE '1997-12-01'), 6) AS rebased FROM i")
def _(spark, d):
    return T.rebase(index(spark, d), "1997-12-01").select("month", r("rebased", 6).alias("rebased"))


@query("splice_index", f"WITH {I}, n AS (SELECT month, value * 3 + 1 AS value FROM i) SELECT month, round(value, 6) AS value FROM i WHERE month <= DATE '1998-01-01' UNION ALL SELECT month, round(value * (SELECT value FROM i WHERE month = DATE '1998-01-01') / (SELECT value FROM n WHERE month = DATE '1998-01-01'), 6) FROM n WHERE month > DATE '1998-01-01'")
def _(spark, d):
    i = index(spark, d)
    return rounded(T.splice(i, i.withColumn("value", F.col("value") * 3 + 1), "1998-01-01"), 6)


@query("period_mean_index", f"WITH {I} SELECT CAST(date_trunc('quarter', month) AS DATE) AS quarter, round(avg(value), 6) AS mean FROM i GROUP BY 1")
def _(spark, d):
    return index(spark, d).groupBy(F.trunc("month", "quarter").alias("quarter")).agg(r(F.avg("value"), 6).alias("mean"))


DEFLATE = f"WITH {I}, k AS (SELECT m.month, m.value AS nominal, m.value * (SELECT value FROM i WHERE month = DATE '1996-01-01') / i.value AS real FROM m JOIN i USING (month))"


def _deflated(spark, d):
    i = index(spark, d).withColumnRenamed("value", "ix")
    base = F.broadcast(i.filter(F.col("month") == F.lit("1996-01-01").cast("date")).select(F.col("ix").alias("i0")))
    return monthly(spark, d).select("month", F.col("value").alias("nominal")).join(i, "month").crossJoin(base).withColumn("real", F.col("nominal") * F.col("i0") / F.col("ix"))


@query("join_index_month", f"{DEFLATE} SELECT month, round(real, 4) AS real FROM k")
def _(spark, d):
    return _deflated(spark, d).select("month", r("real").alias("real"))


@query("deflate", f"{DEFLATE} SELECT CAST(year(month) AS INTEGER) AS y, round(sum(nominal), 2) AS nominal, round(sum(real), 2) AS real FROM k GROUP BY 1")
def _(spark, d):
    return _deflated(spark, d).groupBy(F.year("month").alias("y")).agg(r(F.sum("nominal"), 2).alias("nominal"), r(F.sum("real"), 2).alias("real"))


@query("laspeyres_paasche_fisher", "WITH t AS (SELECT p_type AS kind, p_brand, year(l_shipdate) AS y, sum(l_extendedprice) / sum(l_quantity) AS p, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) IN (1996, 1999) GROUP BY ALL), j AS (SELECT a.kind, a.p AS p0, a.q AS q0, b.p AS p1, b.q AS q1 FROM t a JOIN t b ON a.kind = b.kind AND a.p_brand = b.p_brand AND a.y = 1996 AND b.y = 1999) SELECT kind, round(sum(p1 * q0) / sum(p0 * q0), 6) AS laspeyres, round(sum(p1 * q1) / sum(p0 * q1), 6) AS paasche, round(sqrt(sum(p1 * q0) / sum(p0 * q0) * sum(p1 * q1) / sum(p0 * q1)), 6) AS fisher, round(sum(p1 * q1) / sum(p0 * q0), 6) AS value_index FROM j GROUP BY kind")
def _(spark, d):
    y = F.year("l_shipdate")
    t = table(spark, d, "lineitem").filter(y.isin(1996, 1999)).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("kind"), "p_brand").agg(
        *[F.sum(F.when(y == k, F.col(c))).alias(f"{n}{i}") for i, k in ((0, 1996), (1, 1999)) for n, c in (("v", "l_extendedprice"), ("q", "l_quantity"))])
    t = t.dropna()
    return rounded(T.price_indices(t, F.col("v0") / F.col("q0"), F.col("q0"), F.col("v1") / F.col("q1"), F.col("q1"), ["kind"]), 6)


MA = "a AS (SELECT *, CASE WHEN count(value) OVER (PARTITION BY brand ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) = 12 THEN avg(value) OVER (PARTITION BY brand ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) END AS m1 FROM m), c AS (SELECT brand, month, value, (m1 + lead(m1) OVER (PARTITION BY brand ORDER BY month)) / 2 AS ma FROM a)"
SEASON = f"{MA}, k AS (SELECT brand, CAST(month(month) AS INTEGER) AS month_no, quantile_cont(value / ma, 0.5) AS k FROM c WHERE ma IS NOT NULL GROUP BY ALL), s AS (SELECT brand, month_no, k / avg(k) OVER (PARTITION BY brand) AS seasonal FROM k)"


@query("centered_ma_2x12", f"WITH {B}, {MA} SELECT brand, month, round(ma, 4) AS ma FROM c")
def _(spark, d):
    return T.centred_ma(brands(spark, d), ["brand"]).select("brand", "month", r("ma").alias("ma"))


@query("seasonal_indices", f"WITH {B}, {SEASON} SELECT brand, month_no, round(seasonal, 6) AS seasonal FROM s")
def _(spark, d):
    return rounded(T.seasonal(brands(spark, d), ["brand"]), 6)


@query("seasonal_ratio", f"WITH {B}, {SEASON} SELECT brand, round(max(seasonal) / min(seasonal), 6) AS ratio FROM s GROUP BY brand")
def _(spark, d):
    return T.seasonal(brands(spark, d), ["brand"]).groupBy("brand").agg(r(F.max("seasonal") / F.min("seasonal"), 6).alias("ratio"))


@query("deseasonalize", f"WITH {B}, {SEASON} SELECT m.brand, month, round(value / seasonal, 4) AS adjusted FROM m JOIN s ON m.brand = s.brand AND month(m.month) = s.month_no")
def _(spark, d):
    b = brands(spark, d)
    s = T.seasonal(b, ["brand"]).select(F.col("brand").alias("b"), F.col("month_no").alias("n"), "seasonal")
    return b.join(s, (F.col("brand") == F.col("b")) & (F.month("month") == F.col("n"))).select("brand", "month", r(F.col("value") / F.col("seasonal")).alias("adjusted"))


@query("extremes_of_series", f"WITH {B} SELECT brand, arg_max(month, {{'v': value, 'm': month}}) AS top_month, round(max(value), 6) AS top, arg_min(month, {{'v': value, 'm': month}}) AS low_month, round(min(value), 6) AS low FROM m GROUP BY brand")
def _(spark, d):
    return brands(spark, d).groupBy("brand").agg(F.max_by("month", F.struct("value", "month")).alias("top_month"), r(F.max("value"), 6).alias("top"), F.min_by("month", F.struct("value", "month")).alias("low_month"), r(F.min("value"), 6).alias("low"))


@query("latest_row", f"WITH {B} SELECT brand, max(month) AS month, round(arg_max(value, month), 6) AS value FROM m GROUP BY brand")
def _(spark, d):
    return brands(spark, d).groupBy("brand").agg(F.max("month").alias("month"), r(F.max_by("value", "month"), 6).alias("value"))


@query("selected_years", f"WITH {B} SELECT CAST(year(month) AS INTEGER) AS y, round(sum(value), 2) AS value FROM m WHERE year(month) IN (1995, 1998, 2001) GROUP BY 1")
def _(spark, d):
    return brands(spark, d).filter(F.year("month").isin(1995, 1998, 2001)).groupBy(F.year("month").alias("y")).agg(r(F.sum("value"), 2).alias("value"))
