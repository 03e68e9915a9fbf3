"""Rates of populations by groups: standardisation, exact intervals and the parts of a difference.

cells has a row per population and group: pop, grp, cases, exposed. Standards have a row per standard and group: standard, grp, weight.
Both are results of aggregates, so what is joined here has as many rows as there are populations, groups and standards. A group
without anyone exposed has no rate and adds nothing to an adjusted one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as P

c = F.col
#: Standard normal quantile of an interval at 95 %.
Z95 = 1.959963984540054


def direct(cells: DataFrame, standards: DataFrame) -> DataFrame:
    """standard, pop, rate, variance, top (largest weight of one case), whole (sum of weights), crude."""
    t = cells.join(F.broadcast(standards.withColumnRenamed("grp", "_g")), c("grp") == c("_g"))
    w, n, k = c("weight"), c("exposed"), c("cases")
    whole = F.sum(w)
    return t.groupBy("standard", "pop").agg((F.sum(w * k / n) / whole).alias("rate"), (F.sum(w * w * k / (n.cast("double") * n)) / (whole * whole)).alias("variance"), F.max(w / n).alias("top"), whole.alias("whole"), (F.sum(k) / F.sum(n)).alias("crude"))


def expected(cells: DataFrame) -> DataFrame:
    """cells with expected: what each cell would have at the rate of its group in all populations together."""
    ref = cells.groupBy(c("grp").alias("_g")).agg((F.sum("cases") / F.sum("exposed")).alias("_m"))
    return cells.join(F.broadcast(ref), c("grp") == c("_g")).withColumn("expected", c("exposed") * c("_m")).drop("_g", "_m")  # a row a group


def indirect(cells: DataFrame) -> DataFrame:
    """pop, observed, expected, ratio, rate: the crude rate of all populations together times the ratio."""
    all_ = F.broadcast(cells.agg((F.sum("cases") / F.sum("exposed")).alias("_all")))
    e = expected(cells).groupBy("pop").agg(F.sum("cases").alias("observed"), F.sum("expected").alias("expected")).withColumn("ratio", c("observed") / c("expected"))
    return e.crossJoin(all_).withColumn("rate", c("ratio") * c("_all")).drop("_all")


def gamma_quantile(level: float, shape: Column) -> Column:
    """The quantile of a gamma law with scale 1."""
    top = 2 * shape + 120 * F.sqrt(shape + 1) + 120
    return P.quantile(lambda q: P.chi2_upper(q, 2 * shape), 1 - level, 0, top) / 2


def poisson_interval(k: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Exact limits of the mean of a count; the lower one of no cases is 0."""
    tail = (1 - level) / 2
    k = k.cast("double")
    return F.when(k > 0, gamma_quantile(tail, F.greatest(k, F.lit(1.0)))).otherwise(0.0), gamma_quantile(1 - tail, k + 1)


def with_gamma_interval(rates: DataFrame, level: float = 0.95) -> DataFrame:
    """low and high of rows with rate, variance, top and whole: gamma limits of a weighted sum of counts."""
    tail = (1 - level) / 2
    y, v, w = c("rate"), c("variance"), c("top") / c("whole")
    low = F.when((y > 0) & (v > 0), gamma_quantile(tail, F.try_divide(y * y, v)) * F.try_divide(v, y)).otherwise(0.0)
    high = gamma_quantile(1 - tail, (y + w) * (y + w) / (v + w * w)) * (v + w * w) / (y + w)
    return rates.withColumn("low", low).withColumn("high", high)


def rate_ratios(rates: DataFrame) -> DataFrame:
    """a, b, ratio, low, high of every pair of populations with a before b, on the log scale from the widths of both intervals (of with_gamma_interval)."""
    t = rates.withColumn("s", F.when(c("low") > 0, F.ln("high") - F.ln("low")) / (2 * Z95))
    a, b = (t.select(c("pop").alias(k), c("rate").alias("r" + k), c("s").alias("s" + k)) for k in "ab")
    j = a.join(F.broadcast(b), c("a") < c("b")).withColumn("s", F.sqrt(c("sa") * c("sa") + c("sb") * c("sb"))).withColumn("ratio", F.try_divide("ra", "rb"))
    return j.select("a", "b", "ratio", (c("ratio") * F.exp(-Z95 * c("s"))).alias("low"), (c("ratio") * F.exp(Z95 * c("s"))).alias("high"))


def kitagawa(cells: DataFrame) -> DataFrame:
    """a, b, grp, s, r, d: what structure and rates of a group add to the difference of each pair of populations, and the whole of it."""
    t = cells.withColumn("m", c("cases") / c("exposed")).withColumn("c", c("exposed") / F.sum("exposed").over(Window.partitionBy("pop")))
    a, b = (t.select(c("pop").alias(k), c("grp").alias("g" + k), c("m").alias("m" + k), c("c").alias("c" + k)) for k in "ab")
    return a.join(b, (c("ga") == c("gb")) & (c("a") < c("b"))).select("a", "b", c("ga").alias("grp"), ((c("ca") - c("cb")) * (c("ma") + c("mb")) / 2).alias("s"), ((c("ma") - c("mb")) * (c("ca") + c("cb")) / 2).alias("r"), (c("ca") * c("ma") - c("cb") * c("mb")).alias("d"))
