"""Descriptive statistics: frequencies, moments, quantiles, classes, boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import at_place, places, quantiles, quantiles_midpoint

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def whole():
    """All rows of a result: only over tables of a few rows."""
    return Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)



def skew_adjusted(x: str) -> Column:
    """Sample-adjusted skewness n/((n-1)(n-2)) * sum z^3."""
    n, m = F.count(x), F.avg(x)
    m3 = F.avg(F.pow(F.col(x), 3)) - 3 * m * F.avg(F.pow(F.col(x), 2)) + 2 * m * m * m
    return F.when((n > 2) & (F.stddev_samp(x) > 0), n * n / ((n - 1) * (n - 2)) * m3 / F.pow(F.stddev_samp(x), 3))


def describe_numeric(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """n, missing, mean, sd, min, q1, median, q3, max, skew, shape; quartiles of type 7."""
    by = by or []
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.count_if(F.col(x).isNull()).alias("missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), skew_adjusted(x).alias("skew"))
    q = quantiles(df, x, QUARTILES, by)  # a row a group, like out
    if by:
        q = q.select(*[F.col(b).alias(f"_{b}") for b in by], *QUARTILES)
        out = out.join(q, reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]), "left")
    else:
        out = out.crossJoin(q)
    return out.select(*by, "n", "missing", "mean", "sd", "min", *QUARTILES, "max", "skew", F.when(F.abs("skew") > 1, "skewed").otherwise("symmetric").alias("shape"))


def weighted_moments(df: DataFrame, x: str, w: str, by: list[str] | None = None) -> DataFrame:
    """n, sum_w, total, mean, variance, sd, cv, skew, kurtosis (excess), all by weight (population)."""
    X, W = F.col(x), F.col(w)
    s = [F.sum(W * F.pow(X, k)).alias(f"s{k}") for k in (2, 3, 4)]
    d = df.filter(W > 0).groupBy(*(by or [])).agg(F.count(x).alias("n"), F.sum(W).alias("sum_w"), F.sum(W * X).alias("total"), F.min(x).alias("min"), F.max(x).alias("max"), *s)
    m = F.col("total") / F.col("sum_w")
    r = lambda k: F.col(f"s{k}") / F.col("sum_w")
    d = d.withColumn("mean", m).withColumn("variance", r(2) - m * m).withColumn("m3", r(3) - 3 * m * r(2) + 2 * m**3).withColumn("m4", r(4) - 4 * m * r(3) + 6 * m * m * r(2) - 3 * m**4)
    sd = F.sqrt("variance")
    return d.select(*(by or []), "n", "sum_w", "total", "min", "max", (F.col("max") - F.col("min")).alias("range"), "mean", "variance", sd.alias("sd"), (sd / F.col("mean")).alias("cv"), (F.col("m3") / F.pow(sd, 3)).alias("skew"), (F.col("m4") / F.pow("variance", 2) - 3).alias("kurtosis"))


def describe_weighted(df: DataFrame, x: str, w: str) -> DataFrame:
    """weighted_moments with mean absolute deviation, quartiles, fences, % of outliers and % below the mean."""
    d = df.filter((F.col(w) > 0) & F.col(x).isNotNull())
    q = quantiles_midpoint(d, x, w, [0.25, 0.5, 0.75]).groupBy().agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    one = weighted_moments(d, x, w).crossJoin(q).withColumn("low_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("high_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    X, W = F.col("_x"), F.col("_w")
    far = d.select(F.col(x).alias("_x"), F.col(w).alias("_w")).crossJoin(F.broadcast(one.select("mean", "low_fence", "high_fence"))).groupBy().agg(
        (F.sum(W * F.abs(X - F.col("mean"))) / F.sum(W)).alias("mad"), (100 * F.sum(F.when((X < F.col("low_fence")) | (X > F.col("high_fence")), W).otherwise(0)) / F.sum(W)).alias("pct_outliers"), (100 * F.sum(F.when(X < F.col("mean"), W).otherwise(0)) / F.sum(W)).alias("pct_below_mean"))
    return one.crossJoin(far)


def frequency_table(df: DataFrame, x: str, w: str | None = None) -> DataFrame:
    """category, n, share of the non-empty, cumulative n and share in order of the category."""
    amount = F.sum(w) if w else F.count(F.lit(1))
    run = Window.partitionBy(F.lit(0)).orderBy("category").rowsBetween(Window.unboundedPreceding, 0)
    t = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("category")).agg(amount.alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(whole())).withColumn("cum_n", F.sum("n").over(run)).withColumn("cum_share", F.col("cum_n") / F.sum("n").over(whole()))


def grouped_classes(df: DataFrame, x: str, start: float, width: float, k: int, w: str | None = None) -> DataFrame:
    """class_no, low, high, mark, n, cum_n: classes closed left, the last also right; empty ones kept."""
    no = F.least(F.floor((F.col(x) - start) / width), F.lit(k - 1)).cast("int")
    inside = df.filter(F.col(x).between(start, start + k * width)).groupBy(no.alias("class_no")).agg((F.sum(w) if w else F.count(F.lit(1))).alias("n"))
    run = Window.partitionBy(F.lit(0)).orderBy("class_no").rowsBetween(Window.unboundedPreceding, 0)
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("class_no"))
    t = every.join(inside, "class_no", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    low = F.lit(float(start)) + F.col("class_no") * F.lit(float(width))
    return t.select("class_no", low.alias("low"), (low + width).alias("high"), (low + width / 2).alias("mark"), "n", F.sum("n").over(run).alias("cum_n"))


def box_summary(df: DataFrame, x: str, by: str) -> DataFrame:
    """by, q1, median, q3, whiskers at the last values inside 1.5 IQR, and the number of outliers."""
    f = quantiles(df, x, QUARTILES, [by]).withColumnRenamed(by, "g")
    f = f.withColumn("lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    d = df.select(F.col(by).alias("b"), F.col(x).alias("v")).join(F.broadcast(f), F.col("b").eqNullSafe(F.col("g")), "left")
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    return d.groupBy("b", *QUARTILES).agg(F.min(F.when(inside, F.col("v"))).alias("low_whisker"), F.max(F.when(inside, F.col("v"))).alias("high_whisker"), F.count_if(~inside).alias("outliers")).withColumnRenamed("b", by)


def quantile_conventions(df: DataFrame, x: str, by: str, ps: list[float]) -> DataFrame:
    """by, p, type7, type6, type2: three conventions side by side, from places in the order of each group."""
    n = F.col("_n_all")
    np_ = n * F.col("p")
    inside = lambda h: F.greatest(F.lit(1.0), F.least(h, n.cast("double")))
    first, second = F.greatest(F.ceil(np_), F.lit(1)), F.least(F.floor(np_) + 1, n)
    d = places(df, x, [by]).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    return d.groupBy(by, "p").agg(at_place(x, inside((n - 1) * F.col("p") + 1)).alias("type7"), at_place(x, inside((n + 1) * F.col("p"))).alias("type6"), ((at_place(x, first) + at_place(x, second)) / 2).alias("type2"))


def weighted_mode(df: DataFrame, x: str, w: str) -> DataFrame:
    """mode, share: the value of the greatest total weight, the smallest on ties."""
    t = df.groupBy(F.col(x).alias("v")).agg(F.sum(w).alias("sw"))
    return t.agg(F.max_by("v", F.struct("sw", -F.col("v"))).alias("mode"), (F.max("sw") / F.sum("sw")).alias("share"))


def heaping(df: DataFrame, x: str, k: int, multiple: float) -> DataFrame:
    """n, share_top (of the k most repeated values), share_multiple."""
    t = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    top = t.orderBy(F.desc("c"), "v").limit(k).agg(F.sum("c").alias("top"))
    return t.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("v") % multiple == 0, F.col("c")).otherwise(0)).alias("m")).crossJoin(top).select("n", (F.col("top") / F.col("n")).alias("share_top"), (F.col("m") / F.col("n")).alias("share_multiple"))


def histogram_fd(df: DataFrame, x: str) -> DataFrame:
    """class_no, low, high, n: equal classes, as many as Freedman and Diaconis ask, 4 to 25."""
    s = df.agg(F.count(x).alias("cnt"), F.min(x).alias("lo"), F.max(x).alias("hi")).crossJoin(quantiles(df, x, {"_q1": 0.25, "_q3": 0.75}))  # one row each
    width = 2 * (F.col("_q3") - F.col("_q1")) * F.pow(F.col("cnt").cast("double"), F.lit(-1 / 3))
    s = s.select("lo", "hi", F.greatest(F.lit(4), F.least(F.lit(25), F.ceil((F.col("hi") - F.col("lo")) / width))).cast("int").alias("k"))
    d = df.select(F.col(x).alias("v")).filter("v is not null").crossJoin(F.broadcast(s))
    no = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("k"))), F.col("k") - 1).cast("int")
    n = d.groupBy(no.alias("class_no")).agg(F.count(F.lit(1)).alias("n"))
    every = s.withColumn("class_no", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    step = (F.col("hi") - F.col("lo")) / F.col("k")
    return every.join(n, "class_no", "left").select("class_no", (F.col("lo") + F.col("class_no") * step).alias("low"), (F.col("lo") + (F.col("class_no") + 1) * step).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
