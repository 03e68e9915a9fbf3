"""Survey estimation and sampling: ratios under a complex design, domains, selections, weights, replicates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform


def psu_sums(df: DataFrame, stratum: str, psu: str, w: Column, ys: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """One row a PSU (and domain): sums of w * y for each y; the only shuffle of persons."""
    return df.groupBy(*(by or []), stratum, psu).agg(*[F.sum(w * y).alias(n) for n, y in ys.items()])


def ratio_estimate(df: DataFrame, stratum: str, psu: str, w: Column, y: Column, x: Column, by: list[str] | None = None) -> DataFrame:
    """by, p, se, df, n_psu, lonely: a weighted ratio by domain, with its linearised variance between PSUs.

    Domains, not filters: PSUs without a member count as zeros, through sum (z - zbar)^2 = sum z^2 - (sum z)^2 / a with
    a from the whole sample. Strata of one PSU add no variance and are counted.
    """
    by = by or []
    every = df.groupBy(stratum).agg(F.count_distinct(psu).alias("a")).select(F.col(stratum).alias("_h"), "a")
    design = every.agg(F.sum("a").alias("n_psu"), F.count(F.lit(1)).alias("n_strata"), F.count_if(F.col("a") == 1).alias("lonely"))
    t = psu_sums(df, stratum, psu, w, {"y": y, "x": x}, by)
    p = t.groupBy(*by).agg((F.sum("y") / F.sum("x")).alias("p"), F.sum("x").alias("total_x"))
    named = p.select(*[F.col(b).alias("_" + b) for b in by], "p", "total_x")
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col("_" + b))
    z = t.join(F.broadcast(named), on) if by else t.crossJoin(F.broadcast(named))
    z = z.withColumn("z", F.col("y") - F.col("p") * F.col("x")).groupBy(*by, "p", "total_x", stratum).agg(F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("szz"))
    v = z.join(F.broadcast(every), F.col(stratum).eqNullSafe(F.col("_h"))).withColumn("v", F.when(F.col("a") > 1, F.col("a") / (F.col("a") - 1) * (F.col("szz") - F.col("sz") * F.col("sz") / F.col("a"))).otherwise(0.0))
    out = v.groupBy(*by, "p", "total_x").agg(F.sum("v").alias("v")).crossJoin(F.broadcast(design))
    return out.select(*by, "p", (F.sqrt(F.greatest("v", F.lit(0.0))) / F.abs("total_x")).alias("se"), F.greatest(F.col("n_psu") - F.col("n_strata"), F.lit(1)).alias("df"), "n_psu", "lonely")


def mean_total(df: DataFrame, stratum: str, psu: str, w: Column, y: Column, fractions: DataFrame | None = None) -> DataFrame:
    """total, se_total: with first-stage fractions (stratum, f), if given, as finite population correction."""
    t = psu_sums(df, stratum, psu, w, {"z": y})
    h = t.groupBy(stratum).agg(F.count(F.lit(1)).alias("a"), F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("szz"))
    if fractions is not None:
        h = h.join(F.broadcast(fractions.withColumnRenamed(stratum, "_h")), F.col(stratum) == F.col("_h"))
    fpc = 1 - F.col("f") if fractions is not None else F.lit(1.0)
    v = F.when(F.col("a") > 1, fpc * F.col("a") / (F.col("a") - 1) * (F.col("szz") - F.col("sz") * F.col("sz") / F.col("a"))).otherwise(0.0)
    return h.agg(F.sum("sz").alias("total"), F.sqrt(F.sum(v)).alias("se_total"))


def srs_fixed_n(frame: DataFrame, unit: str, n: int, seed: str) -> DataFrame:
    """Exactly n units, those of the smallest seeded hash."""
    u = hash_uniform(seed, unit)
    return frame.orderBy(u, unit).limit(n)


def likely(rows: Column, wanted: Column) -> Column:
    """Whether a row's hash _u may be among the wanted smallest of so many rows: ten standard deviations more are let through."""
    return F.col("_u") * rows <= wanted + 10 * F.sqrt(wanted) + 50


def stratified_sample(frame: DataFrame, stratum: str, unit: str, sizes: DataFrame, seed: str) -> DataFrame:
    """sizes (stratum, n_h) units a stratum by smallest hash; pi = n_h / frame_n.

    A threshold on the hash lets through a few more than n_h (ten standard deviations), and only these are ordered.
    """
    s = sizes.select(F.col(stratum).alias("_h"), "n_h", "frame_n")
    f = frame.withColumn("_u", hash_uniform(seed, unit)).join(F.broadcast(s), F.col(stratum) == F.col("_h"))
    few = f.filter(likely(F.col("frame_n"), F.col("n_h")))
    r = F.row_number().over(Window.partitionBy(stratum).orderBy("_u", unit))
    return few.withColumn("_r", r).filter("_r <= n_h").withColumn("pi", F.col("n_h") / F.col("frame_n")).drop("_h", "_r", "_u")


def allocate(frame: DataFrame, stratum: str, n: int, size: Column | None = None, least: int = 2) -> DataFrame:
    """stratum, frame_n, n_h: in proportion to frame_n, or frame_n * S_h of size, by largest remainders; at least least, at most frame_n."""
    a = frame.groupBy(stratum).agg(F.count(F.lit(1)).alias("frame_n"), (F.count(F.lit(1)) * (F.stddev_samp(size) if size is not None else F.lit(1.0))).alias("m"))
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a = a.withColumn("share", n * F.col("m") / F.sum("m").over(whole)).withColumn("base", F.floor("share"))
    a = a.withColumn("left", n - F.sum("base").over(whole)).withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("share") - F.col("base"), 9)), stratum)))
    return a.select(stratum, "frame_n", F.least(F.col("frame_n"), F.greatest(F.lit(least), F.col("base") + (F.col("k") <= F.col("left")).cast("long"))).alias("n_h"))


def two_stage_sample(frame: DataFrame, stratum: str, psu: str, unit: str, a: int, m: int, seed: str) -> DataFrame:
    """a clusters a stratum, then m units a cluster; pi = (a / A)(m / M).

    At both stages a threshold on the hash lets through a few more than asked for, and only these are ordered.
    """
    c = frame.groupBy(stratum, psu).agg(F.count(F.lit(1)).alias("M"))
    c = c.join(c.groupBy(F.col(stratum).alias("_g")).agg(F.count(F.lit(1)).alias("A")), F.col(stratum) == F.col("_g")).withColumn("_u", hash_uniform(seed + "1", psu)).filter(likely(F.col("A"), F.lit(a)))
    c = c.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_u", psu))).filter(F.col("_r") <= a)
    c = c.select(F.col(stratum).alias("_h"), F.col(psu).alias("_c"), "M", "A")
    u = frame.join(F.broadcast(c), (F.col(stratum) == F.col("_h")) & (F.col(psu) == F.col("_c"))).withColumn("_u", hash_uniform(seed + "2", unit)).filter(likely(F.col("M"), F.lit(m)))
    r = F.row_number().over(Window.partitionBy(stratum, psu).orderBy("_u", unit))
    return u.withColumn("_r", r).filter(F.col("_r") <= m).withColumn("pi", F.least(F.lit(a), F.col("A")) / F.col("A") * F.least(F.lit(m), F.col("M")) / F.col("M")).drop("_h", "_c", "_r", "_u", "A", "M")


def adjust_by_cell(df: DataFrame, cell: str, weight: str, answered: Column) -> DataFrame:
    """Respondents with weight_nr: weights of a cell's non-respondents go to its respondents."""
    c = df.groupBy(F.col(cell).alias("_c")).agg((F.sum(weight) / F.sum(F.when(answered, F.col(weight)))).alias("_k"))
    return df.filter(answered).join(F.broadcast(c), F.col(cell).eqNullSafe(F.col("_c"))).withColumn("weight_nr", F.col(weight) * F.col("_k")).drop("_c", "_k")


def poststratify(df: DataFrame, cell: str, weight: str, counts: DataFrame) -> DataFrame:
    """weight_ps: weights scaled to the known counts (cell, N) of each cell."""
    e = df.groupBy(F.col(cell).alias("_c")).agg(F.sum(weight).alias("_e"))
    k = e.join(counts.select(F.col(cell).alias("_d"), "N"), F.col("_c") == F.col("_d")).select("_c", (F.col("N") / F.col("_e")).alias("_k"))
    return df.join(F.broadcast(k), F.col(cell) == F.col("_c")).withColumn("weight_ps", F.col(weight) * F.col("_k")).drop("_c", "_k")


def weight_summary(df: DataFrame, weight: str) -> DataFrame:
    w = F.col(weight)
    a = df.agg(F.count(w).alias("n"), F.sum(w).alias("total"), F.min(w).alias("min"), F.max(w).alias("max"), F.stddev_samp(w).alias("sd"), F.sum(w * w).alias("ww"))
    return a.select("n", "total", "min", "max", (F.col("sd") * F.col("n") / F.col("total")).alias("cv"), (F.col("max") / F.col("min")).alias("ratio"), (F.col("n") * F.col("ww") / (F.col("total") * F.col("total"))).alias("deff"), (F.col("total") * F.col("total") / F.col("ww")).alias("effective_n"))


def poisson_edges() -> list[float]:
    """Chances of at most 0, 1, 2 .. events under Poisson(1), as far as 52 bits of a uniform number tell them from 1."""
    edges, p, total, k = [], math.exp(-1), 0.0, 0
    while total + p < 1 - 2.0**-52:
        total += p
        edges.append(total)
        k += 1
        p /= k
    return edges


def replicates(units: DataFrame, unit: str, n: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """units times n replicates with times: Poisson(1) multiplicities from a seeded hash.

    Poisson counts keep each replicate's draw independent by unit, so no replicate needs its units together; totals
    vary around the sample size, which ratios and means take care of. Units drawn no time are left out.
    """
    r = units.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_u", hash_uniform(seed, *(by or []), unit, "rep"))
    times = F.when(F.col("_u") < poisson_edges()[0], 0)  # the first edge above the number, so that the hash is taken once
    for k, edge in enumerate(poisson_edges()[1:], 1):
        times = times.when(F.col("_u") < edge, k)
    return r.withColumn("times", times.otherwise(len(poisson_edges()))).drop("_u").filter("times > 0")
