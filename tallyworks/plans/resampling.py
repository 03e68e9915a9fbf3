"""Medians, spreads and shifts under resampling and shuffling, and ranks of indices under replicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import differences as X
from ..operators import laws as L
from ..operators import resample as B
from . import sqltext as Q
from .modelling import REPLICATES
from .registry import PERSONS, persons, query, r, rounded
from .surveys import drawn_sql

c = F.col
AB = ("1-URGENT", "5-LOW")
LIMITS = ["observed", "bias", "se", "low", "high", "basic_low", "basic_high", "bca_low", "bca_high"]
U = f"u AS (SELECT id, grp = '{AB[0]}' AS a, x FROM persons WHERE grp IN {AB})"


def _rows(spark, found: dict[str, dict], names: list[str]):
    """A row for each statistic."""
    t = spark.createDataFrame([(k, *[v[n] for n in names]) for k, v in found.items()], "statistic string, " + ", ".join(f"{n} double" for n in names))
    return t.select("statistic", *[r(n, 6 if n in ("bias", "se") else 4).alias(n) for n in names])


# medians of groups, by the law of the middle rows

PERMUTED = f"""WITH {PERSONS}, {U}, o AS (SELECT x, a, CAST(row_number() OVER (ORDER BY x, id) AS DOUBLE) AS i FROM u),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (a) AS DOUBLE) AS na, CAST(count(*) FILTER (NOT a) AS DOUBLE) AS nb, ceil(count(*) FILTER (a) / 2) AS k, ceil(count(*) FILTER (NOT a) / 2) AS m FROM u),
e AS (SELECT max(x) FILTER (a AND j = k) - max(x) FILTER (NOT a AND j = m) AS seen FROM (SELECT x, a, row_number() OVER (PARTITION BY a ORDER BY x, id) AS j FROM u), s),
w AS (SELECT *, 8 * sqrt(k * (na - k + 1) * (n + 1) * (n - na) / (pow(na + 1, 2) * (na + 2))) AS da, 8 * sqrt(m * (nb - m + 1) * (n + 1) * (n - nb) / (pow(nb + 1, 2) * (nb + 2))) AS db FROM s),
p AS (SELECT a.i, b.i AS j, abs(a.x - b.x) AS gap, w.* FROM w, o a, o b WHERE a.i <> b.i AND abs(a.i - k * (n + 1) / (na + 1)) <= da + 2 AND abs(b.i - m * (n + 1) / (nb + 1)) <= db + 2),
l AS (SELECT gap, CASE WHEN i < j THEN {{ij}} ELSE {{ji}} END - (lgamma(n + 1) - lgamma(na + 1) - lgamma(nb + 1)) AS l FROM p
  WHERE CASE WHEN i < j THEN i >= k AND m - 1 - (i - k) BETWEEN 0 AND j - i - 1 AND nb - m <= n - j ELSE j >= m AND k - 1 - (j - m) BETWEEN 0 AND i - j - 1 AND na - k <= n - i END)
SELECT round(any_value(seen), 6) AS seen, round(sum(CASE WHEN gap >= abs(seen) - 1e-9 THEN exp(l) ELSE 0 END), 6) AS p FROM l, e"""


def _log_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"


def _middles(i: str, j: str, k: str, m: str, rest: str) -> str:
    """Log of the number of ways to have the k-th of one group at i and then the m-th of the other at j."""
    return " + ".join([_log_choose(f"({i} - 1)", f"({k} - 1)"), _log_choose(f"({j} - {i} - 1)", f"({m} - 1 - ({i} - {k}))"), _log_choose(f"(n - {j})", f"({rest} - {m})")])


@query("permutation_medians", PERMUTED.format(ij=_middles("i", "j", "k", "m", "nb"), ji=_middles("j", "i", "m", "k", "na")))
def _(spark, d):
    """seen, p: the chance, over all shuffles of the labels, of (lower) medians as far apart as seen; nothing is drawn."""
    p = persons(spark, d).filter(c("grp").isin(*AB))
    x, na, gap = L.pooled_places(p, "x", c("grp") == AB[0])
    return spark.createDataFrame([(-gap, L.shuffled_gap(x, na, gap))], "seen double, p double").select(r("seen", 6).alias("seen"), r("p", 6).alias("p"))


DIFF_MEDIANS = f"""WITH {PERSONS}, t AS (SELECT grp AS g, x, count(*) AS k FROM persons WHERE grp IN {AB} GROUP BY ALL),
s AS (SELECT g, x, CAST(sum(k) OVER (PARTITION BY g ORDER BY x) AS DOUBLE) / sum(k) OVER (PARTITION BY g) AS f, CAST(sum(k) OVER (PARTITION BY g) AS DOUBLE) AS n FROM t),
q AS (SELECT g, x, f, CASE WHEN f >= 1 THEN 1.0::DOUBLE ELSE list_sum(list_transform(generate_series(CAST(ceil(n / 2) AS BIGINT), CAST(n AS BIGINT)), lambda _i: exp(lgamma(n + 1) - lgamma(_i + 1) - lgamma(n - _i + 1) + _i * ln(f) + (n - _i) * ln(1 - f)))) END AS upto FROM s WHERE abs(f - 0.5) < 4.5 / sqrt(n) + 3 / n),
l AS (SELECT g, x, f, upto - coalesce(lag(upto) OVER (PARTITION BY g ORDER BY x), 0) AS p FROM q),
m AS (SELECT g, min(x) FILTER (f >= 0.5) AS seen, sum(x * p) / sum(p) AS mean, sum(x * x * p) / sum(p) - pow(sum(x * p) / sum(p), 2) AS v FROM l GROUP BY g),
d AS (SELECT round(a.x - b.x, 9) AS d, sum(a.p * b.p) AS p FROM l a, l b WHERE a.g = '{AB[0]}' AND b.g = '{AB[1]}' GROUP BY 1), k AS (SELECT d, sum(p) OVER (ORDER BY d) AS upto FROM d),
e AS (SELECT a.seen - b.seen AS seen, a.mean - b.mean AS mean, sqrt(a.v + b.v) AS se, (SELECT min(d) FROM k WHERE upto >= 0.025) AS low, (SELECT min(d) FROM k WHERE upto >= 0.975) AS high FROM m a, m b WHERE a.g = '{AB[0]}' AND b.g = '{AB[1]}')
SELECT 'median' AS statistic, round(seen, 4) AS observed, round(mean - seen, 6) AS bias, round(se, 6) AS se, round(low, 4) AS low, round(high, 4) AS high, round(2 * seen - high, 4) AS basic_low, round(2 * seen - low, 4) AS basic_high FROM e"""


@query("bootstrap_diff_medians", DIFF_MEDIANS)
def _(spark, d):
    """Limits of the difference of two groups' (lower) medians, each group resampled by itself: both laws are known, nothing is drawn."""
    p = persons(spark, d)
    a, b = (L.places_near(p.filter(c("grp") == g), "x", [0.5]) for g in AB)
    return _rows(spark, {"median": L.bootstrap_gap(a, b)}, LIMITS[:7])


@query("bootstrap_quantiles")
def _(spark, d):
    """Percentile, basic and BCa limits of the (lower) median and of the distance of the quartiles, from their laws under resampling."""
    x = L.places_near(persons(spark, d), "x", [0.25, 0.5, 0.75])
    return _rows(spark, {"median": L.bootstrap_quantile(x, 0.5), "quartile distance": L.bootstrap_spread(x)}, LIMITS)


SD = f"""WITH RECURSIVE {PERSONS}, g AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x) AS m, stddev_samp(x) AS sd, var_samp(x) * (count(*) - 1) AS q FROM persons),
b AS (SELECT rep, CAST(sum(times) AS DOUBLE) AS k, sum(times * (x - m)) AS s1, sum(times * pow(x - m, 2)) AS s2 FROM {drawn_sql('(SELECT id, x FROM persons)', 'sd', 'id', REPLICATES)}, g GROUP BY rep), t AS (SELECT sqrt((s2 - s1 * s1 / k) / (k - 1)) AS t FROM b),
j AS (SELECT sqrt((q - pow(x - m, 2) * n / (n - 1)) / (n - 2)) AS v FROM persons, g), jm AS (SELECT avg(v) AS v0 FROM j),
a AS (SELECT 1 AS one, sum(pow(v0 - v, 3)) / (6 * pow(sum(pow(v0 - v, 2)), 1.5)) AS a, (SELECT avg(CASE WHEN t < sd THEN 1.0::DOUBLE ELSE 0 END) FROM t, g) AS share FROM j, jm), {Q.bisected('zq', 'a', ['one'], Q.normal_lower('q') + ' >= share', '-10', '10')},
z AS (SELECT a, q AS z0 FROM a JOIN zq USING (one)), w AS (SELECT {Q.normal_lower('(z0 + (z0 - 1.959963984540054) / (1 - a * (z0 - 1.959963984540054)))')} AS lo, {Q.normal_lower('(z0 + (z0 + 1.959963984540054) / (1 - a * (z0 + 1.959963984540054)))')} AS hi FROM z),
l AS (SELECT list_sort(list(t)) AS v, avg(t) AS mean, stddev_samp(t) AS se, quantile_cont(t, 0.025) AS low, quantile_cont(t, 0.975) AS high FROM t), k AS (SELECT *, lo * {REPLICATES - 1} AS pl, hi * {REPLICATES - 1} AS ph FROM l, w, g)
SELECT 'sd' AS statistic, round(sd, 4) AS observed, round(mean - sd, 6) AS bias, round(se, 6) AS se, round(low, 4) AS low, round(high, 4) AS high, round(2 * sd - high, 4) AS basic_low, round(2 * sd - low, 4) AS basic_high,
  round(v[CAST(floor(pl) AS BIGINT) + 1] + (pl - floor(pl)) * (v[CAST(ceil(pl) AS BIGINT) + 1] - v[CAST(floor(pl) AS BIGINT) + 1]), 4) AS bca_low,
  round(v[CAST(floor(ph) AS BIGINT) + 1] + (ph - floor(ph)) * (v[CAST(ceil(ph) AS BIGINT) + 1] - v[CAST(floor(ph) AS BIGINT) + 1]), 4) AS bca_high FROM k"""


@query("bootstrap_sd", SD)
def _(spark, d):
    """Limits of the standard deviation: replicates from sums of powers, the acceleration from the sums without each row."""
    p = persons(spark, d).select("id", "x")
    sd, accel, drawn = B.bootstrap_sd(p, "id", "x", REPLICATES, "sd")
    found = B.intervals(sd, drawn, accel)
    return _rows(spark, {"sd": {"observed": sd, **found}}, LIMITS)


# shifts of real values

@query("hodges_lehmann_two", f"WITH {PERSONS}, a AS (SELECT x AS v, count(*) AS n FROM persons WHERE grp = '{AB[0]}' GROUP BY 1), b AS (SELECT x AS v, count(*) AS n FROM persons WHERE grp = '{AB[1]}' GROUP BY 1), d AS (SELECT a.v - b.v AS d, sum(a.n * b.n) AS n FROM a, b GROUP BY 1), s AS (SELECT d, sum(n) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM d) SELECT round(min(d), 6) AS shift, CAST(max(total) AS BIGINT) AS pairs FROM s WHERE cum >= total / 2")
def _(spark, d):
    """The (lower) median of all differences a - b, by selection: only the differences around it are formed."""
    p = persons(spark, d)
    shift, pairs = X.median_difference(*[X.counted(p.filter(c("grp") == g), c("x")) for g in AB])
    return spark.createDataFrame([(shift, pairs)], "shift double, pairs long").select(r("shift", 6).alias("shift"), "pairs")


@query("hodges_lehmann_paired", f"WITH {PERSONS}, y AS (SELECT round(avg(x) FILTER (year(day) = 1996) - avg(x) FILTER (year(day) = 1997), 6) AS d FROM persons GROUP BY psu HAVING d IS NOT NULL), k AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM y), w AS (SELECT a.d + b.d AS s, count(*) AS n FROM k a JOIN k b ON a.i <= b.i GROUP BY 1), t AS (SELECT s, sum(n) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM w) SELECT round(min(s) / 2, 6) AS pseudo_median, CAST(max(total) AS BIGINT) AS averages FROM t WHERE cum >= total / 2")
def _(spark, d):
    """The (lower) median of the averages of all pairs of paired differences, each with itself as well."""
    from .comparisons import paired

    found, averages = X.median_average(X.counted(paired(spark, d), c("d")))
    return spark.createDataFrame([(found, averages)], "pseudo_median double, averages long").select(r("pseudo_median", 6).alias("pseudo_median"), "averages")


# ranks of an index

INDEX = f"""WITH {PERSONS}, c AS (SELECT DISTINCT stratum, psu FROM persons), b AS {drawn_sql('c', 'ri', 'stratum || chr(58) || psu', 100)},
q AS (SELECT rep, stratum, x, status, times * w AS k, sum(times * w) OVER (PARTITION BY rep, stratum ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS cum, sum(times * w) OVER (PARTITION BY rep, stratum) AS total FROM persons JOIN b USING (stratum, psu)),
i AS (SELECT rep, stratum, sum(k * x) / sum(k) AS mean, min(x) FILTER (cum >= 0.5 * total) AS median, min(x) FILTER (cum >= 0.9 * total) AS top, CAST(sum(k) FILTER (status = 'F') AS DOUBLE) / sum(k) AS share FROM q GROUP BY ALL),
z AS (SELECT rep, stratum, ({" + ".join(f"coalesce((coalesce({v}, 0) - avg(coalesce({v}, 0)) OVER g) / nullif(stddev_samp(coalesce({v}, 0)) OVER g, 0), 0)" for v in ("mean", "median", "top", "share"))}) / 4 AS t FROM i WINDOW g AS (PARTITION BY rep)),
p AS (SELECT stratum, t, row_number() OVER (PARTITION BY rep ORDER BY round(t, 9) DESC, stratum) AS place FROM z)
SELECT stratum, round(avg(t), 6) AS index, round(quantile_cont(t, 0.05), 6) AS index_low, round(quantile_cont(t, 0.95), 6) AS index_high, quantile_cont(CAST(place AS DOUBLE), 0.05) AS low, quantile_cont(CAST(place AS DOUBLE), 0.95) AS high, count(*) AS replicates FROM p GROUP BY stratum"""


@query("rank_uncertainty_index", INDEX)
def _(spark, d):
    """stratum, index, index_low, index_high, low, high: an index of a mean, two weighted quantiles and a share, and its place, over 100 replicates of dwellings.

    A replicate's quantiles are looked for in the ranges of value that hold them; no row is made for a row and a replicate beyond those.
    """
    p = persons(spark, d)
    i = B.replicate_quantiles(p, "stratum", "psu", "x", "w", [0.5, 0.9], {"y": c("x"), "f": F.when(c("status") == "F", 1.0).otherwise(0.0)}, 100, "ri")
    names = ["mean", "median", "top", "share"]
    i = i.select("rep", "stratum", (c("y") / F.nullif(c("w"), F.lit(0.0))).alias("mean"), c("q0").alias("median"), c("q1").alias("top"), (c("f") / F.nullif(c("w"), F.lit(0.0))).alias("share")).fillna(0.0, names)
    g = Window.partitionBy("rep")
    z = lambda v: F.coalesce((c(v) - F.avg(v).over(g)) / F.nullif(F.stddev_samp(v).over(g), F.lit(0.0)), F.lit(0.0))
    i = i.withColumn("t", sum((z(v) for v in names[1:]), z(names[0])) / 4)
    i = i.withColumn("place", F.row_number().over(g.orderBy(F.round("t", 9).desc(), "stratum")))
    out = i.groupBy("stratum").agg(F.avg("t").alias("index"), F.percentile("t", 0.05).alias("index_low"), F.percentile("t", 0.95).alias("index_high"), F.percentile("place", 0.05).alias("low"), F.percentile("place", 0.95).alias("high"), F.count(F.lit(1)).alias("replicates"))
    return rounded(out, 6)
