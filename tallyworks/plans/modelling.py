"""Regression, multivariate summaries, resampling and checks of results."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform
from ..operators import compare as K
from ..operators import describe as D
from ..operators import models as M
from ..operators import normality as N
from ..functions import distributions as P
from ..operators import order as O
from ..operators import resample as B
from . import sqltext as Q
from .registry import ORACLES, PERSONS, persons, query, r, rounded, table
from .surveys import HASH, drawn_sql

c = F.col
XS = ["l_quantity", "l_discount", "p_size"]
LX = {"l_quantity": "l_quantity", "l_discount": "l_discount", "p_size": "p_size", "y": "y"}
LINES = "li AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS y, l_quantity, l_discount, CAST(p_size AS DOUBLE) AS p_size, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)"


def lines(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey")).select("l_orderkey", "l_linenumber", (c("l_extendedprice") / 1000).alias("y"), "l_quantity", "l_discount", c("p_size").cast("double").alias("p_size"), "l_returnflag")


def fitted_sql(name: str = "g", y: str = "y", source: str = "li", where: str = "true") -> Q.Sweeps:
    """The regression of y on the three columns, swept."""
    return Q.Sweeps(name, source, {**{k: k for k in XS}, "y": y}, where).sweep(*XS)


def linear_sql(g: Q.Sweeps, coef: str = "k") -> str:
    return f"({coef}.c{len(XS)} + " + " + ".join(f"{coef}.{g.at(x, 'y')} * ({x} - {coef}.c{i})" for i, x in enumerate(XS)) + ")"


def one_row(g: Q.Sweeps) -> str:
    """The last sweep beside the centres, as k."""
    return f"(SELECT * FROM {g.last}, {g.name}_c) k"


@query("ols_simple", f"WITH {LINES} SELECT round(regr_intercept(y, l_quantity), 6) AS intercept, round(regr_slope(y, l_quantity), 6) AS slope, round(regr_r2(y, l_quantity), 6) AS r2, count(*) AS n FROM li")
def _(spark, d):
    f = M.ols(M.gram(lines(spark, d), ["l_quantity"], "y"))
    return spark.createDataFrame([(float(f.beta[0]), float(f.beta[1]), f.r2, f.n)], "intercept double, slope double, r2 double, n long").select(r("intercept", 6).alias("intercept"), r("slope", 6).alias("slope"), r("r2", 6).alias("r2"), "n")


_G = fitted_sql()
_S = f"(k.{_G.at('y', 'y')} / (n - {len(XS) + 1}))"
_XX = " + ".join(f"k.c{i} * k.c{j} * -k.{_G.at(a, b)}" for i, a in enumerate(XS) for j, b in enumerate(XS))
OLS = " UNION ALL ".join([f"SELECT '(constant)' AS term, c{len(XS)} - (" + " + ".join(f"{_G.at(x, 'y')} * c{i}" for i, x in enumerate(XS)) + f") AS b, sqrt({_S} * (1 / n + {_XX})) AS se, NULL::DOUBLE AS vif, n - {len(XS) + 1} AS df FROM {one_row(_G)}",
                         *[f"SELECT '{x}', k.{_G.at(x, 'y')}, sqrt({_S} * -k.{_G.at(x, x)}), -k.{_G.at(x, x)} * z.{_G.at(x, x)}, n - {len(XS) + 1} FROM {one_row(_G)}, {_G.name}_0 z" for x in XS]])


@query("ols", f"WITH RECURSIVE {LINES}, {_G.text}, o AS ({OLS}), d AS (SELECT DISTINCT 1 AS one, df FROM o), {Q.bisected('tq', 'd', ['one'], Q.t_two_sided('q', 'df') + ' <= 0.05', '0', '200')} SELECT term, round(b, 6) AS estimate, round(se, 6) AS se, round(b / se, 4) AS t, round({Q.t_two_sided('(b / se)', 'df')}, 6) AS p, round(b - q * se, 5) AS low, round(b + q * se, 5) AS high, round(vif, 6) AS vif FROM o, tq")
def _(spark, d):
    t = M.coefficients(spark, M.gram(lines(spark, d), XS, "y"))
    return t.select("term", r("estimate", 6).alias("estimate"), r("se", 6).alias("se"), r("t").alias("t"), r("p", 6).alias("p"), r("low", 5).alias("low"), r("high", 5).alias("high"), r("vif", 6).alias("vif"))


_N = ["l_quantity", "l_discount", "p_size", "noise0", "noise1", "noise2"]
_NOISE = "nz AS (SELECT *, " + ", ".join(HASH.format(s=f"n{k}", u="l_orderkey || ':' || l_linenumber") + f" AS noise{k}" for k in range(3)) + " FROM li)"
_NG = Q.Sweeps("g", "nz", {**{k: k for k in _N}, "y": "y"}).sweep(*_N)
NESTED = " UNION ALL ".join(f"SELECT {k} AS predictors, {_NG.at('y', 'y').join(['g_%d.' % k, ''])} AS rss, g_0.{_NG.at('y', 'y')} AS tss, n FROM g_{k}, g_0, g_c" for k in range(1, 7))


@query("nested_models", f"WITH {LINES}, {_NOISE}, {_NG.text}, t AS ({NESTED}), u AS (SELECT *, predictors AS k, n - predictors - 1 AS df FROM t) SELECT predictors, n, round(1 - rss / tss, 8) AS r2, round(1 - rss / tss * (n - 1) / df, 8) AS adj_r2, round((tss - rss) / k / (rss / df), 3) AS f, round(sqrt(rss / df), 6) AS sigma, round(n * ln(rss / n) + 2 * (k + 1), 3) AS aic, round(n * ln(rss / n) + ln(n) * (k + 1), 3) AS bic FROM u")
def _(spark, d):
    """Models of growing size, with three columns of hash noise, from one Gram matrix."""
    noisy = lines(spark, d).withColumns({f"noise{k}": hash_uniform(f"n{k}", "l_orderkey", "l_linenumber") for k in range(3)})
    g = M.gram(noisy, _N, "y")
    rows = [(k, *[float(v) for v in M.fit_summary(M.ols(g.drop([x for x in g.names[:-1] if x not in g.names[:k]]))).values()]) for k in range(1, 7)]
    t = spark.createDataFrame(rows, "predictors int, n double, r2 double, adj_r2 double, f double, sigma double, aic double, bic double")
    return t.select("predictors", "n", r("r2", 8).alias("r2"), r("adj_r2", 8).alias("adj_r2"), r("f", 3).alias("f"), r("sigma", 6).alias("sigma"), r("aic", 3).alias("aic"), r("bic", 3).alias("bic"))


_TT = fitted_sql("g", "y", "tt", "u < 0.7")


@query("train_test_r2", f"WITH {LINES}, tt AS (SELECT *, {HASH.format(s='tt', u="l_orderkey || ':' || l_linenumber")} AS u FROM li), {_TT.text}, e AS (SELECT CASE WHEN u < 0.7 THEN 'train' ELSE 'test' END AS part, y, y - {linear_sql(_TT)} AS e FROM tt, {one_row(_TT)}) SELECT part, count(*) AS n, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e GROUP BY part")
def _(spark, d):
    t = lines(spark, d).withColumn("u", hash_uniform("tt", "l_orderkey", "l_linenumber"))
    f = M.ols(M.gram(t.filter("u < 0.7"), XS, "y"))
    out = t.withColumn("part", F.when(c("u") < 0.7, "train").otherwise("test")).withColumn("e", c("y") - M.linear(f))
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), r(1 - F.sum(c("e") * c("e")) / (F.var_pop("y") * F.count(F.lit(1))), 6).alias("r2"))


_LG = fitted_sql("g", "ln(y)")


@query("log_effects", f"WITH {LINES}, {_LG.text} " + " UNION ALL ".join(f"SELECT '{x}' AS term, round({_LG.at(x, 'y')}, 8) AS estimate, round(100 * (exp({_LG.at(x, 'y')}) - 1), 6) AS percent FROM {_LG.last}" for x in XS))
def _(spark, d):
    """Percent effects of a model of the logarithm."""
    f = M.ols(M.gram(lines(spark, d).withColumn("ly", F.ln("y")), XS, "ly"))
    t = spark.createDataFrame([(n, float(b), float(100 * (np.exp(b) - 1))) for n, b in zip(f.names[1:], f.beta[1:], strict=True)], "term string, estimate double, percent double")
    return t.select("term", r("estimate", 8).alias("estimate"), r("percent", 6).alias("percent"))


def _fitted(spark, d):
    t = lines(spark, d)
    return t, M.ols(M.gram(t, XS, "y"))


_H = "(1 / k.n + " + " + ".join(f"-k.{_G.at(a, b)} * ({a} - k.c{i}) * ({b} - k.c{j})" for i, a in enumerate(XS) for j, b in enumerate(XS)) + ")"
DIAG = f"di AS (SELECT l_orderkey, l_linenumber, n, fit, y - fit AS e, h, (y - fit) / sqrt(s2 * (1 - h)) AS z FROM (SELECT li.*, k.n, {linear_sql(_G)} AS fit, {_H} AS h, k.{_G.at('y', 'y')} / (k.n - 4) AS s2 FROM li, {one_row(_G)})), co AS (SELECT *, z * z * h / (1 - h) / 4 AS cook FROM di)"


@query("residual_diagnostics", f"WITH {LINES}, {_G.text}, {DIAG} SELECT l_orderkey, l_linenumber, round(fit, 6) AS fitted, round(e, 6) AS residual, round(h, 9) AS leverage, round(z, 6) AS standardized, round(cook, 9) AS cook, cook > 4 / n AS influential FROM co")
def _(spark, d):
    t, f = _fitted(spark, d)
    return M.diagnostics(t, f, "y").select("l_orderkey", "l_linenumber", r("fitted", 6).alias("fitted"), r("residual", 6).alias("residual"), r("leverage", 9).alias("leverage"), r("standardized", 6).alias("standardized"), r("cook", 9).alias("cook"), (c("cook") > 4 / f.n).alias("influential"))


_BP = fitted_sql("b", "e2", "er")


@query("breusch_pagan", f"WITH {LINES}, {_G.text}, er AS (SELECT li.*, pow(y - {linear_sql(_G)}, 2) AS e2 FROM li, {one_row(_G)}), {_BP.text}, t AS (SELECT b_c.n * (1 - {_BP.last}.{_BP.at('y', 'y')} / b_0.{_BP.at('y', 'y')}) AS lm FROM {_BP.last}, b_0, b_c) SELECT round(lm, 4) AS lm, 3 AS df, round({Q.chi2_upper('lm', '3')}, 6) AS p FROM t")
def _(spark, d):
    t, f = _fitted(spark, d)
    e2 = t.withColumn("e2", F.pow(c("y") - M.linear(f), 2))
    h = M.ols(M.gram(e2, XS, "e2"))
    return spark.createDataFrame([(float(h.n * h.r2), len(XS))], "lm double, df int").select(r("lm").alias("lm"), "df", r(P.chi2_upper(c("lm"), c("df")), 6).alias("p"))


@query("durbin_watson", "WITH o AS (SELECT l_extendedprice / 1000 - avg(l_extendedprice / 1000) OVER () AS e, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem), p AS (SELECT e, lag(e) OVER (ORDER BY i) AS b FROM o) SELECT round(sum(pow(e - b, 2)) / sum(e * e), 6) AS dw FROM p")
def _(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (c("l_extendedprice") / 1000).alias("y"))
    m = F.broadcast(t.agg(F.avg("y").alias("m")))
    e = O.lagged(t, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "y", [1]).crossJoin(m)
    return e.agg(r(F.sum(F.pow(c("y") - c("y_1"), 2)) / F.sum(F.pow(c("y") - c("m"), 2)), 6).alias("dw"))


_WO = fitted_sql("w", "y", "li", "(l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM top)")
_COEF = lambda g, k: "CASE " + " ".join(f"WHEN term = '{x}' THEN {k}.{g.at(x, 'y')}" for x in XS) + f" ELSE {k}.c{len(XS)} - (" + " + ".join(f"{k}.{g.at(x, 'y')} * {k}.c{i}" for i, x in enumerate(XS)) + ") END"


@query("refit_without_top_case", f"WITH {LINES}, {_G.text}, {DIAG}, top AS (SELECT l_orderkey, l_linenumber FROM co ORDER BY cook DESC, l_orderkey, l_linenumber LIMIT 1), {_WO.text} SELECT term, round({_COEF(_G, 'k')}, 6) AS with_case, round({_COEF(_WO, 'v')}, 6) AS without_case FROM (VALUES ('(constant)'), ('l_quantity'), ('l_discount'), ('p_size')) n(term), {one_row(_G)}, (SELECT * FROM {_WO.last}, w_c) v")
def _(spark, d):
    t, f = _fitted(spark, d)
    top = M.diagnostics(t, f, "y").orderBy(F.desc("cook"), "l_orderkey", "l_linenumber").limit(1).select("l_orderkey", "l_linenumber")
    g = M.ols(M.gram(t.join(F.broadcast(top), ["l_orderkey", "l_linenumber"], "left_anti"), XS, "y"))
    return rounded(spark.createDataFrame([(n, float(a), float(b)) for n, a, b in zip(f.names, f.beta, g.beta, strict=True)], "term string, with_case double, without_case double"), 6)


def logistic_sql(steps: int = 12) -> str:
    """Newton steps on standardised columns: each a scan for gradient and information, swept to the next coefficients."""
    k = len(XS)
    names = [f"z{i}" for i in range(k + 1)]
    out = [f"lz AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS y, 1.0::DOUBLE AS z0, " + ", ".join(f"({x} - (SELECT avg({x}) FROM li)) / (SELECT stddev_pop({x}) FROM li) AS z{i}" for i, x in enumerate(XS, 1)) + " FROM li)",
           "b0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(k + 1)) + ")"]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    for t in range(steps):
        mu = "1 / (1 + exp(-(" + " + ".join(f"b{i} * z{i}" for i in range(k + 1)) + ")))"
        sums = ", ".join([f"sum(mu * (1 - mu) * z{i} * z{j}) AS m{i}_{j}" for i, j in pairs] + [f"sum((y - mu) * z{i}) AS m{i}_{k + 1}" for i in range(k + 1)] + [f"0.0::DOUBLE AS m{k + 1}_{k + 1}"])
        out.append(f"s{t}_0 AS (SELECT {sums} FROM (SELECT *, {mu} AS mu FROM lz, b{t}))")
        g = Q.Sweeps.over(f"s{t}", [*names, "y"]).sweep(*names)
        out += g.tables
        out.append(f"b{t + 1} AS (SELECT " + ", ".join(f"b{i} + m{i}_{k + 1} AS b{i}" for i in range(k + 1)) + f" FROM b{t}, {g.last})")
    last = f"s{steps - 1}_{k + 1}"
    eta = " + ".join(f"b{i} * z{i}" for i in range(k + 1))
    out.append(f"ll AS (SELECT sum(-ln(1 + exp(-(CASE WHEN y = 1 THEN {eta} ELSE -({eta}) END)))) AS ll, count(*) AS n, avg(y) AS m FROM lz, b{steps})")
    out.append("sc AS (SELECT " + ", ".join(f"avg({x}) AS a{i}, stddev_pop({x}) AS d{i}" for i, x in enumerate(XS, 1)) + " FROM li)")
    to = ["1", *[f"(-a{i} / d{i})" for i in range(1, k + 1)]]
    var0 = " + ".join(f"{to[i]} * {to[j]} * -v.m{min(i, j)}_{max(i, j)}" for i in range(k + 1) for j in range(k + 1))
    rows = [f"SELECT '(constant)' AS term, " + " + ".join(f"{to[i]} * b{i}" for i in range(k + 1)) + f" AS b, sqrt({var0}) AS se FROM b{steps}, sc, {last} v"]
    rows += [f"SELECT '{x}', b{i} / d{i}, sqrt(-v.m{i}_{i}) / d{i} FROM b{steps}, sc, {last} v" for i, x in enumerate(XS, 1)]
    out.append("lo AS (" + " UNION ALL ".join(rows) + ")")
    return ", ".join(out)


@query("logistic", f"WITH {LINES}, {logistic_sql()} SELECT term, round(b, 6) AS estimate, round(se, 6) AS se, round({Q.normal_two_sided('(b / se)')}, 6) AS p, round(exp(b), 6) AS odds_ratio, round(exp(b - 1.959963984540054 * se), 6) AS low, round(exp(b + 1.959963984540054 * se), 6) AS high, round(1 - ll / (n * (m * ln(m) + (1 - m) * ln(1 - m))), 8) AS mcfadden, n FROM lo, ll")
def _(spark, d):
    """Coefficients, p, odds ratios and McFadden's measure; no rows if it does not settle."""
    t = lines(spark, d).withColumn("k", (c("l_returnflag") == "R").cast("int"))
    f = M.logistic(t, XS, "k")
    schema = "term string, estimate double, se double, mcfadden double, n long"
    rows = [(n, float(b), float(v), float(1 - f["ll"] / f["ll0"]), f["n"]) for n, b, v in zip(f["names"], f["beta"], f["se"], strict=True)] if f else []
    b, se = c("estimate"), c("se")
    odds = {"odds_ratio": F.exp(b), "low": F.exp(b - 1.959963984540054 * se), "high": F.exp(b + 1.959963984540054 * se)}
    return spark.createDataFrame(rows, schema).select("term", r(b, 6).alias("estimate"), r(se, 6).alias("se"), r(P.normal_two_sided(b / se), 6).alias("p"), *[r(e, 6).alias(k) for k, e in odds.items()], r("mcfadden", 8).alias("mcfadden"), "n")


@query("correlation_matrix", f"WITH {LINES} SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(l_quantity, l_discount), 6) AS r FROM li UNION ALL SELECT 'l_quantity', 'p_size', round(corr(l_quantity, p_size), 6) FROM li UNION ALL SELECT 'l_quantity', 'y', round(corr(l_quantity, y), 6) FROM li UNION ALL SELECT 'l_discount', 'p_size', round(corr(l_discount, p_size), 6) FROM li UNION ALL SELECT 'l_discount', 'y', round(corr(l_discount, y), 6) FROM li UNION ALL SELECT 'p_size', 'y', round(corr(p_size, y), 6) FROM li")
def _(spark, d):
    names = [*XS, "y"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    a = lines(spark, d).agg(*[F.corr(x, y).alias(f"{x}|{y}") for x, y in pairs])
    return a.unpivot([], [f"`{k}`" for k in a.columns], "k", "r").select(F.split("k", r"\|")[0].alias("a"), F.split("k", r"\|")[1].alias("b"), r("r", 6).alias("r"))


_PC = Q.Sweeps("g", "li", LX).sweep(*LX)
_PN = list(LX)
PARTIAL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, z.{_PC.at(a, b)} / sqrt(z.{_PC.at(a, a)} * z.{_PC.at(b, b)}) AS r, k.{_PC.at(a, b)} / sqrt(k.{_PC.at(a, a)} * k.{_PC.at(b, b)}) AS partial, -k.{_PC.at(a, a)} * z.{_PC.at(a, a)} AS vif FROM {_PC.last} k, g_0 z" for i, a in enumerate(_PN) for b in _PN[i + 1:])
_DET = " * ".join(f"g_{i}.{_PC.at(x, x)} / g_0.{_PC.at(x, x)}" for i, x in enumerate(_PN))


@query("partial_correlations", f"WITH {LINES}, {_PC.text}, p AS ({PARTIAL}), m AS (SELECT {_DET} AS determinant FROM g_0, g_1, g_2, g_3) SELECT a, b, round(partial, 6) AS partial, round(vif, 6) AS vif_a, round(determinant, 6) AS determinant, round((SELECT sum(r * r) / (sum(r * r) + sum(partial * partial)) FROM p), 6) AS kmo FROM p, m")
def _(spark, d):
    """a, b, partial, with determinant and KMO: from the inverse of the correlation matrix."""
    g = M.gram(lines(spark, d), XS, "y")
    s = np.sqrt(np.diag(g.m))
    cor = g.m / np.outer(s, s)
    inv = np.linalg.inv(cor)
    partial = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(len(g.names), dtype=bool)
    kmo = float((cor[off] ** 2).sum() / ((cor[off] ** 2).sum() + (partial[off] ** 2).sum()))
    rows = [(a, b, float(partial[i, j]), float(inv[i, i]), float(np.linalg.det(cor)), kmo) for i, a in enumerate(g.names) for j, b in enumerate(g.names) if i < j]
    return rounded(spark.createDataFrame(rows, "a string, b string, partial double, vif_a double, determinant double, kmo double"), 6)


UNITS = ["n", "mean", "active", "old", "urgent"]


def units(spark, d):
    """Nations by indicators."""
    return persons(spark, d).groupBy("stratum").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("mean"), F.avg((c("status") != "P").cast("int")).alias("active"), F.avg((c("age") >= 65).cast("int")).alias("old"), F.avg((c("grp") == "1-URGENT").cast("int")).alias("urgent"))


UNITS_SQL = "u AS (SELECT stratum, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mean, avg(CASE WHEN status <> 'P' THEN 1.0::DOUBLE ELSE 0 END) AS active, avg(CASE WHEN age >= 65 THEN 1.0::DOUBLE ELSE 0 END) AS old FROM persons GROUP BY 1)"


UNITS_ALL = "u AS (SELECT stratum, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mean, avg(CASE WHEN status <> 'P' THEN 1.0::DOUBLE ELSE 0 END) AS active, avg(CASE WHEN age >= 65 THEN 1.0::DOUBLE ELSE 0 END) AS old, avg(CASE WHEN grp = '1-URGENT' THEN 1.0::DOUBLE ELSE 0 END) AS urgent FROM persons GROUP BY 1)"
UNIT_PAIRS = [(a, b) for i, a in enumerate(UNITS) for b in UNITS[i + 1:]]


@query("leave_one_group_out", f"WITH {PERSONS}, {UNITS_ALL} " + " UNION ALL ".join(f"SELECT a.stratum AS stratum, '{x}' AS a, '{y}' AS b, round(corr(b.{x}, b.{y}), 6) AS r FROM u a JOIN u b ON a.stratum <> b.stratum GROUP BY a.stratum" for x, y in UNIT_PAIRS))
def _(spark, d):
    """Every correlation without each unit, from totals less the unit's own part."""
    out = M.leave_one_out(units(spark, d), "stratum", UNITS)
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in UNIT_PAIRS])
    return out.select("stratum", F.explode(F.arrays_zip(names.alias("pair"), "r")).alias("q")).select("stratum", "q.pair.a", "q.pair.b", r("q.r", 6).alias("r"))


@query("leave_one_out_component")
def _(spark, d):
    """The first component's share of the variance without each unit, and how far it is from that with all."""
    u = units(spark, d)
    values, *_ = M.pca(u, UNITS)
    whole = float(values[0] / values.sum())
    return M.leave_one_out(u, "stratum", UNITS).select("stratum", r("share", 6).alias("share"), r(c("share") - F.lit(whole), 6).alias("change"))


@query("standardize_columns", f"WITH {PERSONS}, {UNITS_SQL}, s AS (SELECT avg(mean) AS m, stddev_samp(mean) AS sd, min(mean) AS lo, max(mean) AS hi, quantile_cont(mean, 0.5) AS med, quantile_cont(mean, 0.75) - quantile_cont(mean, 0.25) AS iqr FROM u) SELECT stratum, round((mean - m) / sd, 6) AS z, round((mean - lo) / (hi - lo), 6) AS minmax, round((mean - med) / iqr, 6) AS robust FROM u, s")
def _(spark, d):
    u = units(spark, d)
    s = F.broadcast(u.agg(F.avg("mean").alias("m"), F.stddev_samp("mean").alias("sd"), F.min("mean").alias("lo"), F.max("mean").alias("hi"), F.percentile("mean", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")))
    return u.crossJoin(s).select("stratum", r((c("mean") - c("m")) / c("sd"), 6).alias("z"), r((c("mean") - c("lo")) / (c("hi") - c("lo")), 6).alias("minmax"), r((c("mean") - c("q")[1]) / (c("q")[2] - c("q")[0]), 6).alias("robust"))


@query("pca")
def _(spark, d):
    """component, eigenvalue, share, cumulative, kaiser and the loadings as correlations."""
    values, vectors, *_ = M.pca(units(spark, d), UNITS)
    rows = [(k + 1, float(v), float(v / values.sum()), float(values[:k + 1].sum() / values.sum()), bool(v > 1), [float(x) for x in vectors[:, k] * np.sqrt(max(v, 0))]) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "component int, eigenvalue double, share double, cumulative double, kaiser boolean, loadings array<double>")


@query("pca_scores")
def _(spark, d):
    u = units(spark, d)
    _, vectors, centre, scale = M.pca(u, UNITS)
    return M.scores(u, UNITS, vectors, centre, scale, 2).select("stratum", r("pc1", 6).alias("pc1"), r("pc2", 6).alias("pc2"))


_MU = Q.Sweeps("g", "u", {k: k for k in UNITS}, count="rows").sweep(*UNITS)
CUTOFF = P.chi2_ppf(0.975, len(UNITS))


@query("mahalanobis", f"WITH {PERSONS}, {UNITS_ALL}, {_MU.text}, m AS (SELECT stratum, (k.rows - 1) * (" + " + ".join(f"-k.{_MU.at(a, b)} * (u.{a} - k.c{i}) * (u.{b} - k.c{j})" for i, a in enumerate(UNITS) for j, b in enumerate(UNITS)) + f") AS d2 FROM u, (SELECT * FROM {_MU.last}, g_c) k) SELECT stratum, round(d2, 6) AS d2, round({CUTOFF!r}::DOUBLE, 6) AS cutoff, d2 > {CUTOFF!r} AS far, CAST(row_number() OVER (ORDER BY round(d2, 9) DESC, stratum) AS INTEGER) AS place FROM m")
def _(spark, d):
    """Squared distances, whether they are beyond the 97.5 % point of chi-square, and their order."""
    t = M.mahalanobis(units(spark, d), UNITS)
    return t.select("stratum", r("d2", 6).alias("d2"), r(F.lit(CUTOFF), 6).alias("cutoff"), (c("d2") > CUTOFF).alias("far"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("d2", 9)), "stratum")).alias("place"))


@query("composite_index", f"WITH {PERSONS}, {UNITS_SQL}, z AS (SELECT stratum, ((mean - avg(mean) OVER ()) / stddev_samp(mean) OVER () + (active - avg(active) OVER ()) / stddev_samp(active) OVER ()) / 2 AS z, ((mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) + (active - min(active) OVER ()) / (max(active) OVER () - min(active) OVER ())) / 2 AS m FROM u) SELECT stratum, round(z, 6) AS z_mean, round(m, 6) AS minmax_mean, CAST(row_number() OVER (ORDER BY round(z, 9) DESC, stratum) - row_number() OVER (ORDER BY round(m, 9) DESC, stratum) AS INTEGER) AS moves FROM z")
def _(spark, d):
    w = D.whole()
    z = lambda k: (c(k) - F.avg(k).over(w)) / F.stddev_samp(k).over(w)
    m = lambda k: (c(k) - F.min(k).over(w)) / (F.max(k).over(w) - F.min(k).over(w))
    u = units(spark, d).select("stratum", ((z("mean") + z("active")) / 2).alias("z"), ((m("mean") + m("active")) / 2).alias("m"))
    place = lambda k: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(k, 9)), "stratum"))
    return u.select("stratum", r("z", 6).alias("z_mean"), r("m", 6).alias("minmax_mean"), (place("z") - place("m")).alias("moves"))


#: Indicators of an index, and whether more of one is better.
SIGNS = {"mean": 1, "active": 1, "old": -1, "urgent": -1}
_Z = "(({s}) * ({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER ())"
_MM = "(({s} * {v} - min({s} * {v}) OVER ()) / (max({s} * {v}) OVER () - min({s} * {v}) OVER ()))"
_RK = "((row_number() OVER (ORDER BY round({s} * {v}, 12), stratum) - 1) / (count(*) OVER () - 1.0::DOUBLE))"
_MEAN = lambda text: "(" + " + ".join(text.format(s=s, v=v) for v, s in SIGNS.items()) + f") / {len(SIGNS)}"
VARIANTS = f"{UNITS_ALL}, x AS (SELECT stratum, {_MEAN(_Z)} AS z, {_MEAN(_MM)} AS minmax, {_MEAN(_RK)} AS ranks, exp({_MEAN('ln(' + _MM + ' * 0.98 + 0.01)')}) AS geometric, " + ", ".join(f"{_Z.format(s=s, v=v)} AS i_{v}" for v, s in SIGNS.items()) + " FROM u)"
FORMS = ["z", "minmax", "ranks", "geometric"]


def variants(spark, d):
    """stratum, the index as a mean of z-scores, of ranges, of ranks and as a geometric mean of ranges, and the z-score of each indicator."""
    w, one = D.whole(), Window.partitionBy(F.lit(0))  # result rows
    z = lambda v, s: s * (c(v) - F.avg(v).over(w)) / F.stddev_samp(v).over(w)
    mm = lambda v, s: (s * c(v) - F.min(s * c(v)).over(w)) / (F.max(s * c(v)).over(w) - F.min(s * c(v)).over(w))
    rk = lambda v, s: (F.row_number().over(one.orderBy(F.round(s * c(v), 12), "stratum")) - 1) / (F.count(F.lit(1)).over(w) - 1.0)
    mean = lambda f: sum((f(v, F.lit(s)) for v, s in SIGNS.items()), F.lit(0.0)) / len(SIGNS)
    return units(spark, d).select("stratum", mean(z).alias("z"), mean(mm).alias("minmax"), mean(rk).alias("ranks"), F.exp(mean(lambda v, s: F.ln(mm(v, s) * 0.98 + 0.01))).alias("geometric"), *[z(v, F.lit(s)).alias(f"i_{v}") for v, s in SIGNS.items()])


def _placed(t, names):
    return t.withColumns({f"place_{k}": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(k, 9)), "stratum")) for k in names})


_PLACED = f"p AS (SELECT *, " + ", ".join(f"row_number() OVER (ORDER BY round({k}, 9) DESC, stratum) AS place_{k}" for k in FORMS) + " FROM x)"


@query("composite_variants", f"WITH {PERSONS}, {VARIANTS}, {_PLACED} SELECT stratum, " + ", ".join(f"round({k}, 6) AS {k}, CAST(place_{k} AS INTEGER) AS place_{k}" for k in FORMS) + " FROM p")
def _(spark, d):
    return _placed(variants(spark, d), FORMS).select("stratum", *[x for k in FORMS for x in (r(k, 6).alias(k), c(f"place_{k}"))])


@query("composite_sensitivity", f"WITH {PERSONS}, {VARIANTS}, {_PLACED} " + " UNION ALL ".join(f"SELECT '{k}' AS variant, round(corr(place_z, place_{k}), 6) AS spearman, quantile_cont(abs(place_{k} - place_z)::DOUBLE, 0.5) AS median_move, CAST(max(abs(place_{k} - place_z)) AS INTEGER) AS largest_move, bool_or((place_{k} <= 5) <> (place_z <= 5)) AS top_changes FROM p" for k in FORMS[1:]))
def _(spark, d):
    """How far each form of the index moves the places that the mean of z-scores gives."""
    t, out = _placed(variants(spark, d), FORMS), None
    for k in FORMS[1:]:
        move = F.abs(c(f"place_{k}") - c("place_z"))
        one = t.agg(F.lit(k).alias("variant"), r(F.corr("place_z", f"place_{k}"), 6).alias("spearman"), F.percentile(move, 0.5).alias("median_move"), F.max(move).alias("largest_move"), F.bool_or((c(f"place_{k}") <= 5) != (c("place_z") <= 5)).alias("top_changes"))
        out = one if out is None else out.union(one)
    return out


@query("composite_weights", f"WITH {PERSONS}, {VARIANTS}, w AS (" + " UNION ALL ".join(f"SELECT '{v}' AS indicator, corr(i_{v}, z) AS cor FROM x" for v in SIGNS) + f") SELECT indicator, round(1 / {len(SIGNS)}.0::DOUBLE, 6) AS nominal, round(cor, 6) AS correlation, round(cor * cor / sum(cor * cor) OVER (), 6) AS effective FROM w")
def _(spark, d):
    """The weight that each indicator has in effect: its squared correlation with the index, as a share."""
    t = variants(spark, d)
    w = t.agg(*[F.corr(f"i_{v}", "z").alias(v) for v in SIGNS]).unpivot([], list(SIGNS), "indicator", "cor")
    return w.select("indicator", r(F.lit(1.0 / len(SIGNS)), 6).alias("nominal"), r("cor", 6).alias("correlation"), r(c("cor") * c("cor") / F.sum(c("cor") * c("cor")).over(D.whole()), 6).alias("effective"))


@query("composite_first_component")
def _(spark, d):
    """The index as the first component of the oriented z-scores, and its places beside those of their mean."""
    t, names = variants(spark, d), [f"i_{v}" for v in SIGNS]
    _, vectors, centre, scale = M.pca(t, names)
    sign = 1.0 if vectors[:, 0].sum() >= 0 else -1.0
    t = _placed(M.scores(t, names, vectors[:, :1] * sign, centre, scale, 1), ["z", "pc1"])
    return t.select("stratum", r("pc1", 6).alias("pc1"), c("place_pc1").alias("place"), (c("place_z") - c("place_pc1")).alias("moves"), r(F.corr("place_z", "place_pc1").over(D.whole()), 6).alias("spearman"))


_CA = "t AS (SELECT stratum AS a, seg AS b, CAST(count(*) AS DOUBLE) AS n FROM persons GROUP BY ALL), g AS (SELECT a.a, b.b, coalesce(t.n, 0) AS n FROM (SELECT DISTINCT a FROM t) a CROSS JOIN (SELECT DISTINCT b FROM t) b LEFT JOIN t ON t.a = a.a AND t.b = b.b), e AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb, sum(n) OVER () AS nn FROM g), s AS (SELECT *, pow(n - ra * cb / nn, 2) / (ra * cb) AS s2 FROM e)"


@query("correspondence_analysis")
def _(spark, d):
    """Masses, inertias, coordinates, contributions to the first two axes and quality of both sides of nations by segments."""
    return M.correspondence_points(K.contingency(persons(spark, d), "stratum", "seg"))


@query("correspondence_inertias", f"WITH {PERSONS}, {_CA}, p AS (SELECT 'row' AS side, CAST(a AS VARCHAR) AS label, any_value(ra) / any_value(nn) AS mass, sum(s2) AS inertia FROM s GROUP BY a UNION ALL SELECT 'column', b, any_value(cb) / any_value(nn), sum(s2) FROM s GROUP BY b) SELECT side, label, round(mass, 8) AS mass, round(inertia, 8) AS inertia, round(inertia / sum(inertia) OVER (PARTITION BY side), 6) AS share, abs(sum(inertia) OVER (PARTITION BY side) - (SELECT sum(s2) FROM s)) < 1e-9 AS sums_to_chi2 FROM p")
def _(spark, d):
    """The inertia of every point; over either side it is chi-square over n."""
    cells = K.contingency(persons(spark, d), "stratum", "seg")
    points = M.correspondence_points(cells).crossJoin(F.broadcast(cells.agg((F.sum(F.pow(c("n") - c("expected"), 2) / c("expected")) / F.max("total")).alias("all"))))
    side = F.sum("inertia").over(Window.partitionBy("side"))
    return points.select("side", "label", r("mass", 8).alias("mass"), r("inertia", 8).alias("inertia"), r(c("inertia") / side, 6).alias("share"), (F.abs(side - c("all")) < 1e-9).alias("sums_to_chi2"))


def two_way_sql(source: str, a: str, la: list[str], b: str, lb: list[str], x: str) -> tuple[str, dict[str, str]]:
    """Tables, and the residual sum of squares of the full model (full), without each effect, and of the sequential ones."""
    code = lambda v, levels: [f"(CASE {v} WHEN '{k}' THEN 1.0::DOUBLE WHEN '{levels[-1]}' THEN -1.0::DOUBLE ELSE 0 END)" for k in levels[:-1]]
    ca, cb = code(a, la), code(b, lb)
    blocks = {"a": {f"a{i}": e for i, e in enumerate(ca)}, "b": {f"b{i}": e for i, e in enumerate(cb)}, "i": {f"i{i}{j}": f"{e} * {f}" for i, e in enumerate(ca) for j, f in enumerate(cb)}}
    columns = {k: e for v in blocks.values() for k, e in v.items()} | {"y": x}
    own = Q.Sweeps("w", source, columns)
    tables, out = own.tables, {"tss": f"(SELECT {own.at('y', 'y')} FROM w_0)"}
    for name, order in (("full", "abi"), ("without_a", "bi"), ("without_b", "ai"), ("without_i", "ab"), ("only_a", "a"), ("only_b", "b")):
        g = Q.Sweeps.over(f"w{name}", [*columns], "w_0").sweep(*[k for o in order for k in blocks[o]])
        tables = [*tables, *g.tables]
        out[name] = f"(SELECT {g.at('y', 'y')} FROM {g.last})"
    return ", ".join(tables), out


def two_way_rows(a: str, b: str, t: dict[str, str], da: int, db: int) -> str:
    """effect, ss, df of the types of two_way."""
    f = t["full"]
    rows = [(a, f"{t['without_a']} - {f}", da), (b, f"{t['without_b']} - {f}", db), ("interaction", f"{t['without_i']} - {f}", da * db),
            (f"{a} (type I)", f"{t['tss']} - {t['only_a']}", da), (f"{b} (type I)", f"{t['only_a']} - {t['without_i']}", db),
            (f"{b} first (type I)", f"{t['tss']} - {t['only_b']}", db), (f"{a} second (type I)", f"{t['only_b']} - {t['without_i']}", da)]
    return " UNION ALL ".join(f"SELECT '{n}' AS effect, {s} AS ss, {k} AS df" for n, s, k in rows) + f" UNION ALL SELECT 'residual', {f}, CAST((SELECT n FROM w_c) - {(da + 1) * (db + 1)} AS INTEGER)"


_WT, _WR = two_way_sql("persons", "seg", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "status", ["F", "O", "P"], "x")


@query("anova_two_way", f"WITH {PERSONS}, {_WT}, e AS ({two_way_rows('seg', 'status', _WR, 4, 2)}), m AS (SELECT ss / df AS ms, ss AS rss, df AS rdf FROM e WHERE effect = 'residual') SELECT effect, round(ss, 3) AS ss, df, CASE WHEN effect <> 'residual' THEN round(ss / df / ms, 6) END AS f, CASE WHEN effect <> 'residual' THEN round({Q.f_upper('(ss / df / ms)', 'df', 'rdf')}, 6) END AS p, CASE WHEN effect <> 'residual' THEN round(ss / (ss + rss), 8) END AS partial_eta2, false AS singular FROM e, m")
def _(spark, d):
    """Type III and both orders of type I, with p and partial eta squared; singular if a cell is empty."""
    cells = persons(spark, d).groupBy("seg", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sy"), F.sum(c("x") * c("x")).alias("syy"))
    rows, singular = M.two_way(cells, "seg", "status")
    rss, df = rows[-1][1:]
    t = spark.createDataFrame([(n, float(s), k) for n, s, k in rows], "effect string, ss double, df int")
    own = c("effect") != "residual"
    f = c("ss") / c("df") / float(rss / df)
    return t.select("effect", r("ss", 3).alias("ss"), "df", F.when(own, r(f, 6)).alias("f"), F.when(own, r(P.f_upper(f, c("df"), F.lit(df)), 6)).alias("p"), F.when(own, r(c("ss") / (c("ss") + float(rss)), 8)).alias("partial_eta2"), F.lit(singular).alias("singular"))


@query("ss_type_contrast", f"WITH {PERSONS}, {_WT}, e AS ({two_way_rows('seg', 'status', _WR, 4, 2)}) SELECT a.effect, round(a.ss, 3) AS type3, round(b.ss, 3) AS type1, abs(a.ss / b.ss - 1) > 0.05 AS differs FROM e a JOIN e b ON b.effect = a.effect || ' (type I)'")
def _(spark, d):
    """Whether a factor's sum of squares depends on its type."""
    cells = persons(spark, d).groupBy("seg", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sy"), F.sum(c("x") * c("x")).alias("syy"))
    rows = {n: s for n, s, _ in M.two_way(cells, "seg", "status")[0]}
    t = spark.createDataFrame([(k, rows[k], rows[f"{k} (type I)"], abs(rows[k] / rows[f"{k} (type I)"] - 1) > 0.05) for k in ("seg", "status")], "effect string, type3 double, type1 double, differs boolean")
    return rounded(t, 3)


# machine-learning library

def _vectors(df: DataFrame, xs: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=xs, outputCol="features").transform(df)


def _embedded(spark, d):
    """Labelled vectors, all their components."""
    from pyspark.ml.functions import array_to_vector

    t = table(spark, d, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL")
    return t.select("vec_id", "label", array_to_vector(c("embedding").cast("array<double>")).alias("features"))


@query("kmeans")
def _(spark, d):
    """k, cluster, n, inertia: the sizes of the clusters of the best of three starts for each k, and its inertia."""
    v = _embedded(spark, d).select("features").persist()
    rows = []
    for k in (2, 3, 4, 5):
        best = min((KMeans(k=k, seed=s, maxIter=20).fit(v) for s in (1, 2, 3)), key=lambda m: m.summary.trainingCost)
        rows += [(k, i, int(n), float(best.summary.trainingCost)) for i, n in enumerate(sorted(best.summary.clusterSizes, reverse=True))]
    v.unpersist()
    return spark.createDataFrame(rows, "k int, cluster int, n long, inertia double")


@query("kmeans_profile")
def _(spark, d):
    """cluster, n, component, mean, z: how far each cluster's mean of each component is from the whole, in standard deviations."""
    v = _embedded(spark, d)
    t = KMeans(k=4, seed=1, maxIter=20).fit(v).transform(v).join(table(spark, d, "embeddings").select(c("vec_id").alias("id"), "embedding"), c("vec_id") == c("id"))
    t = t.select(c("prediction").alias("cluster"), F.posexplode(c("embedding").cast("array<double>")).alias("component", "x"))
    whole = t.groupBy(c("component").alias("of")).agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    own = t.groupBy("cluster", "component").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    return own.join(whole, c("component") == c("of")).select("cluster", "n", "component", r("mean", 6).alias("mean"), r((c("mean") - c("m")) / F.nullif("sd", F.lit(0.0)), 6).alias("z"))


@query("silhouette")
def _(spark, d):
    v = _embedded(spark, d)
    out = KMeans(k=4, seed=1, maxIter=20).fit(v).transform(v)
    return spark.createDataFrame([(4, float(ClusteringEvaluator().evaluate(out)))], "k int, silhouette double")


def rand_index(t: DataFrame, a: str, b: str) -> DataFrame:
    """ari: the adjusted Rand index of two groupings, from the counts of their cells."""
    t = t.groupBy(c(a).alias("a"), c(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    two = lambda n: F.sum(n * (n - 1) / 2)
    s = t.agg(two(c("n")).alias("i"), F.sum("n").alias("n")).crossJoin(t.groupBy("a").agg(F.sum("n").alias("m")).agg(two(c("m")).alias("ia"))).crossJoin(t.groupBy("b").agg(F.sum("n").alias("m")).agg(two(c("m")).alias("ib")))
    chance = c("ia") * c("ib") / (c("n") * (c("n") - 1) / 2)
    return s.select(((c("i") - chance) / ((c("ia") + c("ib")) / 2 - chance)).alias("ari"))


@query("gaussian_mixture")
def _(spark, d):
    """seed, log_likelihood, smallest component and agreement with the first seed: how far the mixture depends on its start."""
    from pyspark.ml.feature import PCA

    v = _embedded(spark, d)
    v = PCA(k=4, inputCol="features", outputCol="axes").fit(v).transform(v).select("vec_id", "axes").persist()
    rows, first = [], None
    for seed in (1, 2, 3):
        m = GaussianMixture(k=3, seed=seed, maxIter=25, featuresCol="axes").fit(v)
        own = m.transform(v).select("vec_id", c("prediction").alias(f"p{seed}"))
        first = own if first is None else first
        ari = rand_index(first.join(own, "vec_id") if seed > 1 else own.withColumn("p0", c("p1")), "p1", f"p{seed}" if seed > 1 else "p0").first()["ari"]
        rows.append((seed, float(m.summary.logLikelihood), int(min(m.summary.clusterSizes)), float(ari)))
    v.unpersist()
    return spark.createDataFrame(rows, "seed int, log_likelihood double, smallest long, agreement double")


RAND = "t AS (SELECT stratum % 4 AS a, id % 3 AS b, count(*) AS n FROM persons GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM t) AS i, (SELECT sum(m * (m - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS m FROM t GROUP BY a)) AS ia, (SELECT sum(m * (m - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS m FROM t GROUP BY b)) AS ib, (SELECT sum(n) * (sum(n) - 1) / 2.0::DOUBLE FROM t) AS ic)"


@query("adjusted_rand", f"WITH {PERSONS}, {RAND} SELECT round((i - ia * ib / ic) / ((ia + ib) / 2 - ia * ib / ic), 8) AS ari FROM s")
def _(spark, d):
    return rand_index(persons(spark, d).select((c("stratum") % 4).alias("a"), (c("id") % 3).alias("b")), "a", "b").select(r("ari", 8).alias("ari"))


@query("model_comparison_cv")
def _(spark, d):
    """model, columns, accuracy over five folds (mean and lowest), for nested sets of columns."""
    t = persons(spark, d).select("id", (c("status") == "F").cast("double").alias("label"), "x", c("age").cast("double").alias("age"), c("w").cast("double").alias("w")).withColumn("fold", F.floor(hash_uniform("cv", "id") * FOLDS)).persist()
    models = [("logistic", LogisticRegression(maxIter=20), ["x"]), ("logistic", LogisticRegression(maxIter=20), ["x", "age", "w"]), ("forest", RandomForestClassifier(numTrees=10, maxDepth=4, seed=1), ["x", "age", "w"]), ("boosting", GBTClassifier(maxIter=5, maxDepth=3, seed=1), ["x", "age", "w"])]
    rows = []
    for name, m, columns in models:
        v = _vectors(t, columns)
        got = [float(m.fit(v.filter(c("fold") != k)).transform(v.filter(c("fold") == k)).agg(F.avg((c("prediction") == c("label")).cast("int"))).first()[0]) for k in range(FOLDS)]
        rows.append((name, len(columns), sum(got) / FOLDS, min(got)))
    t.unpersist()
    return spark.createDataFrame(rows, "model string, columns int, accuracy double, lowest double")


FOLDS = 5
_DA = f"t AS (SELECT CASE WHEN status = 'F' THEN 1 ELSE 0 END AS k, x, CAST(age AS DOUBLE) AS a, CAST(floor({HASH.format(s='da', u='id')} * 5) AS INTEGER) AS fold FROM persons), w AS (SELECT f.fold AS out, k, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mx, avg(a) AS ma, var_samp(x) AS vx, var_samp(a) AS va, covar_samp(x, a) AS c FROM t, (SELECT unnest(range(6)) AS fold) f WHERE t.fold <> f.fold GROUP BY ALL), pl AS (SELECT out, sum(n) AS nn, sum((n - 1) * vx) / (sum(n) - 2) AS px, sum((n - 1) * va) / (sum(n) - 2) AS pa, sum((n - 1) * c) / (sum(n) - 2) AS pc FROM w GROUP BY out)"


def _side_sql(k: int) -> str:
    return ", ".join(f"max({e}) FILTER (k = {k}) AS {e}{k}" for e in ("n", "mx", "ma", "vx", "va", "c"))


def _score_sql(k: int, vx: str, va: str, cov: str) -> str:
    zx, za, det = f"(x - mx{k})", f"(a - ma{k})", f"({vx} * {va} - {cov} * {cov})"
    return f"(ln(n{k} / nn) - 0.5 * ln({det}) - 0.5 * ({va} * {zx} * {zx} - 2 * {cov} * {zx} * {za} + {vx} * {za} * {za}) / {det})"


@query("lda_qda", f"WITH {PERSONS}, {_DA}, s AS (SELECT out, {_side_sql(0)}, {_side_sql(1)} FROM w GROUP BY out), g AS (SELECT k, {_score_sql(0, 'px', 'pa', 'pc')} < {_score_sql(1, 'px', 'pa', 'pc')} AS lda, {_score_sql(0, 'vx0', 'va0', 'c0')} < {_score_sql(1, 'vx1', 'va1', 'c1')} AS qda FROM t JOIN s ON t.fold = s.out JOIN pl ON t.fold = pl.out), m AS (SELECT (nn - 2) * ln(px * pa - pc * pc) - (n0 - 1) * ln(vx0 * va0 - c0 * c0) - (n1 - 1) * ln(vx1 * va1 - c1 * c1) AS box, 1 - 13.0::DOUBLE / 18 * (1 / (n0 - 1) + 1 / (n1 - 1) - 1 / (nn - 2)) AS f FROM s JOIN pl USING (out) WHERE out = 5), b AS (SELECT box * f AS chi2 FROM m) SELECT method, round(accuracy, 6) AS accuracy, round(chi2, 4) AS box_m, round({Q.chi2_upper('chi2', '3')}, 6) AS p_box FROM (SELECT 'lda' AS method, avg(CASE WHEN lda = (k = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM g UNION ALL SELECT 'qda', avg(CASE WHEN qda = (k = 1) THEN 1.0::DOUBLE ELSE 0 END) FROM g), b")
def _(spark, d):
    """method, accuracy over five folds, and Box's M of equal covariances: one aggregate by fold and class, then one scoring pass."""
    t = persons(spark, d).select((c("status") == "F").cast("int").alias("k"), "x", c("age").cast("double").alias("a"), F.floor(hash_uniform("da", "id") * FOLDS).cast("int").alias("fold"))
    centre = t.agg(F.avg("x").alias("x"), F.avg("a").alias("a")).first()
    zx, za = c("x") - float(centre["x"]), c("a") - float(centre["a"])
    sums = {(q["fold"], q["k"]): np.array([q[v] for v in ("n", "sx", "sa", "xx", "xa", "aa")], float) for q in t.groupBy("fold", "k").agg(F.count(F.lit(1)).alias("n"), F.sum(zx).alias("sx"), F.sum(za).alias("sa"), F.sum(zx * zx).alias("xx"), F.sum(zx * za).alias("xa"), F.sum(za * za).alias("aa")).collect()}

    def moments(out: int | None) -> dict:
        """n, means and covariance by class, without one fold."""
        got = {}
        for k in (0, 1):
            n, sx, sa, xx, xa, aa = sum(v for (f, q), v in sums.items() if q == k and f != out)
            got[k] = n, np.array([sx, sa]) / n, np.array([[xx - sx * sx / n, xa - sx * sa / n], [xa - sx * sa / n, aa - sa * sa / n]]) / (n - 1)
        return got

    def score(n: float, total: float, mean: np.ndarray, cov: np.ndarray):
        inv, z = np.linalg.inv(cov), [zx - float(mean[0]), za - float(mean[1])]
        return sum((F.lit(-0.5 * float(inv[i, j])) * z[i] * z[j] for i in range(2) for j in range(2)), F.lit(float(np.log(n / total) - 0.5 * np.log(np.linalg.det(cov)))))

    hits = {}
    for f in range(FOLDS):
        g = moments(f)
        total = g[0][0] + g[1][0]
        pooled = sum((n - 1) * v for n, _, v in g.values()) / (total - 2)
        for name, covs in (("lda", (pooled, pooled)), ("qda", (g[0][2], g[1][2]))):
            hit = ((score(g[0][0], total, g[0][1], covs[0]) < score(g[1][0], total, g[1][1], covs[1])).cast("int") == c("k")).cast("int")
            hits[name] = F.when(c("fold") == f, hit) if name not in hits else hits[name].when(c("fold") == f, hit)
    g = moments(None)
    total = g[0][0] + g[1][0]
    pooled = sum((n - 1) * v for n, _, v in g.values()) / (total - 2)
    m = (total - 2) * np.log(np.linalg.det(pooled)) - sum((n - 1) * np.log(np.linalg.det(v)) for n, _, v in g.values())
    chi2 = float(m * (1 - 13 / 18 * (sum(1 / (n - 1) for n, *_ in g.values()) - 1 / (total - 2))))
    a = t.agg(*[F.avg(e).alias(k) for k, e in hits.items()])
    return a.unpivot([], ["lda", "qda"], "method", "accuracy").select("method", r("accuracy", 6).alias("accuracy"), r(F.lit(chi2)).alias("box_m"), r(P.chi2_upper(F.lit(chi2), F.lit(3)), 6).alias("p_box"))


# resampling of rows

REPLICATES = 200


@query("bootstrap_ci", f"""WITH RECURSIVE {PERSONS}, t AS (SELECT rep, sum(times * x) / sum(times) AS t FROM {drawn_sql('(SELECT id, x FROM persons)', 'bm', 'id', REPLICATES)} GROUP BY rep), m AS (SELECT avg(x) AS m FROM persons),
a AS (SELECT 1 AS one, sum(pow(x - m, 3)) / (6 * pow(sum(pow(x - m, 2)), 1.5)) AS a, (SELECT avg(CASE WHEN t < m THEN 1.0::DOUBLE ELSE 0 END) FROM t, m) AS share FROM persons, m), {Q.bisected('zq', 'a', ['one'], Q.normal_lower('q') + ' >= share', '-10', '10')},
z AS (SELECT a, q AS z0 FROM a JOIN zq USING (one)), w AS (SELECT {Q.normal_lower('(z0 + (z0 - 1.959963984540054) / (1 - a * (z0 - 1.959963984540054)))')} AS lo, {Q.normal_lower('(z0 + (z0 + 1.959963984540054) / (1 - a * (z0 + 1.959963984540054)))')} AS hi FROM z),
l AS (SELECT list_sort(list(t)) AS v FROM t), q AS (SELECT m, (SELECT avg(t) FROM t) - m AS bias, (SELECT stddev_samp(t) FROM t) AS se, (SELECT quantile_cont(t, 0.025) FROM t) AS low, (SELECT quantile_cont(t, 0.975) FROM t) AS high, lo * 199 AS pl, hi * 199 AS ph, v FROM m, w, l)
SELECT round(m, 4) AS mean, round(bias, 6) AS bias, round(se, 6) AS se, round(low, 4) AS low, round(high, 4) AS high, round(2 * m - high, 4) AS basic_low, round(2 * m - low, 4) AS basic_high,
round(v[CAST(floor(pl) AS BIGINT) + 1] + (pl - floor(pl)) * (v[CAST(ceil(pl) AS BIGINT) + 1] - v[CAST(floor(pl) AS BIGINT) + 1]), 4) AS bca_low, round(v[CAST(floor(ph) AS BIGINT) + 1] + (ph - floor(ph)) * (v[CAST(ceil(ph) AS BIGINT) + 1] - v[CAST(floor(ph) AS BIGINT) + 1]), 4) AS bca_high FROM q""")
def _(spark, d):
    """Bias, se, percentile, basic and BCa intervals of the mean from Poisson replicates of rows."""
    p = persons(spark, d).select("id", "x")
    s = p.agg(F.avg("x").alias("m"), (F.coalesce(F.skewness("x"), F.lit(0.0)) / (6 * F.sqrt(F.count("x")))).alias("a")).first()
    m, skew = s["m"], s["a"]
    drawn = [q["t"] for q in B.bootstrap_means(p, "id", {"t": (c("x"), F.lit(1))}, REPLICATES, "bm").collect()]  # a number a replicate
    found = {"mean": float(m), **B.intervals(m, drawn, skew)}
    t = spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found))
    return t.select(*[r(k, 6 if k in ("bias", "se") else 4).alias(k) for k in found])


@query("bootstrap_median", f"WITH {PERSONS}, t AS (SELECT x, count(*) AS n FROM persons GROUP BY x), s AS (SELECT x, CAST(sum(n) OVER (ORDER BY x) AS DOUBLE) / sum(n) OVER () AS f, CAST(sum(n) OVER () AS DOUBLE) AS n FROM t), k AS (SELECT x, f, CASE WHEN f >= 1 THEN 1.0::DOUBLE ELSE list_sum(list_transform(generate_series(CAST(ceil(n / 2) AS BIGINT), CAST(n AS BIGINT)), lambda _i: exp(lgamma(n + 1) - lgamma(_i + 1) - lgamma(n - _i + 1) + _i * ln(f) + (n - _i) * ln(1 - f)))) END AS c FROM s WHERE abs(f - 0.5) < 6 / sqrt(n)) SELECT round(min(x) FILTER (f >= 0.5), 6) AS estimate, round(min(x) FILTER (c >= 0.025), 6) AS low, round(min(x) FILTER (c >= 0.975), 6) AS high FROM k")
def _(spark, d):
    """The median and its percentile interval under all resamples, from the distribution function."""
    return rounded(B.quantile_bootstrap(persons(spark, d), "x", 0.5), 6)


@query("bootstrap_diff", f"WITH {PERSONS}, u AS (SELECT id, grp, x FROM persons WHERE grp IN ('1-URGENT', '5-LOW')), t AS (SELECT rep, sum(times * x) FILTER (grp = '1-URGENT') / sum(times) FILTER (grp = '1-URGENT') - sum(times * x) FILTER (grp = '5-LOW') / sum(times) FILTER (grp = '5-LOW') AS t FROM {drawn_sql('u', 'bd', 'id', REPLICATES)} GROUP BY rep) SELECT round(avg(t), 4) AS diff, round(stddev_samp(t), 6) AS se, round(quantile_cont(t, 0.025), 4) AS low, round(quantile_cont(t, 0.975), 4) AS high, count(*) AS replicates FROM t")
def _(spark, d):
    p = persons(spark, d).filter(c("grp").isin("1-URGENT", "5-LOW")).select("id", "grp", "x")
    own = lambda g: (F.when(c("grp") == g, c("x")).otherwise(0.0), (c("grp") == g).cast("int"))
    t = B.bootstrap_means(p, "id", {"a": own("1-URGENT"), "b": own("5-LOW")}, REPLICATES, "bd").withColumn("t", c("a") - c("b"))
    return t.agg(r(F.avg("t")).alias("diff"), r(F.stddev_samp("t"), 6).alias("se"), r(F.percentile("t", 0.025)).alias("low"), r(F.percentile("t", 0.975)).alias("high"), F.count(F.lit(1)).alias("replicates"))


@query("permutation_test", f"WITH {PERSONS}, u AS (SELECT id, grp, x FROM persons WHERE grp IN ('1-URGENT', '5-LOW')), s AS (SELECT avg(x) FILTER (grp = '1-URGENT') - avg(x) FILTER (grp = '5-LOW') AS seen, count(*) FILTER (grp = '1-URGENT') AS na, count(*) AS n, sum(x) AS total FROM u), k AS (SELECT rep, x, row_number() OVER (PARTITION BY rep ORDER BY {HASH.format(s='pm', u="id || ':' || rep")}, id) AS k FROM u, (SELECT unnest(generate_series(1, {REPLICATES - 1})) AS rep)), t AS (SELECT rep, sum(x) FILTER (k <= na) / any_value(na) - (any_value(total) - sum(x) FILTER (k <= na)) / any_value(n - na) AS t FROM k, s GROUP BY rep) SELECT round(any_value(seen), 6) AS seen, count(*) AS replicates, (count(*) FILTER (abs(t) >= abs(seen)) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p FROM t, s")
def _(spark, d):
    """p = (extreme + 1) / (replicates + 1) of the difference of two means, over shuffles of the labels."""
    p = persons(spark, d).filter(c("grp").isin("1-URGENT", "5-LOW")).select("id", "grp", "x")
    own = c("grp") == "1-URGENT"
    s = p.agg((F.avg(F.when(own, c("x"))) - F.avg(F.when(~own, c("x")))).alias("seen"), F.count_if(own).alias("na"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))
    t = B.permuted_sums(p, "id", "x", own, REPLICATES - 1, "pm").crossJoin(F.broadcast(s)).withColumn("t", c("s") / c("na") - (c("total") - c("s")) / (c("n") - c("na")))
    return t.agg(r(F.first("seen"), 6).alias("seen"), F.count(F.lit(1)).alias("replicates"), ((F.count_if(F.abs("t") >= F.abs("seen")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


@query("shapiro_wilk_by_group")
def _(spark, d):
    """w and p by group on at most 5,000 rows of the smallest hash: Royston's weights and his normalising transformation."""
    return N.shapiro_wilk(persons(spark, d), "x", "grp", "id")


# checks of results

@query("check_identities", f"""WITH {PERSONS}, an AS ({{anova_one_way}}), s AS (SELECT sum(CAST(n AS DOUBLE)) / (SELECT count(*) FROM persons) AS one FROM (SELECT count(*) AS n FROM persons GROUP BY grp)), tss AS (SELECT var_samp(x) * (count(*) - 1) AS tss FROM persons),
lz AS (SELECT sum(w) OVER (ORDER BY x) / CAST(sum(w) OVER () AS DOUBLE) AS p, sum(w * x) OVER (ORDER BY x) / sum(w * x) OVER () AS q FROM persons), rt AS (SELECT CAST(sum(w) FILTER (status = 'F') AS DOUBLE) / sum(w) AS e, CAST(sum(w) FILTER (status IN ('F', 'O')) AS DOUBLE) / sum(w) AS a, CAST(sum(w) FILTER (status = 'O') AS DOUBLE) / sum(w) FILTER (status IN ('F', 'O')) AS u FROM persons),
rk AS (SELECT sum(r) AS r FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM persons)), ks AS (SELECT (SELECT sum(n) FROM (SELECT count(*) AS n FROM persons GROUP BY seg, grp)) AS n), gm AS (SELECT (SELECT sum(n * m) / sum(n) FROM (SELECT seg, count(*) AS n, avg(x) AS m FROM persons GROUP BY seg)) AS m)
SELECT 'shares sum to one' AS check_name, abs(one - 1) < 1e-9 AS ok FROM s UNION ALL SELECT 'sums of squares add up', abs(ss_between + ss_within - tss) < 1e-6 * tss FROM an, tss UNION ALL SELECT 'Lorenz below the diagonal', bool_and(q <= p + 1e-9) FROM lz UNION ALL SELECT 'rates multiply', abs(e - a * (1 - u)) < 1e-9 FROM rt UNION ALL SELECT 'F is the ratio of mean squares', abs(f - ss_between / df1 / (ss_within / df2)) < 1e-4 FROM an
UNION ALL SELECT 'ranks sum to n (n + 1) / 2', abs(r - (SELECT count(*) * (count(*) + 1) / 2.0::DOUBLE FROM persons)) < 1e-6 * r FROM rk UNION ALL SELECT 'cells sum to rows', n = (SELECT count(*) FROM persons) FROM ks UNION ALL SELECT 'mean of group means', abs(m - (SELECT avg(x) FROM persons)) < 1e-9 * abs(m) FROM gm UNION ALL SELECT 'eta squared between 0 and 1', eta2 BETWEEN 0 AND 1 FROM an
UNION ALL SELECT 'Gini by Lorenz and by mean differences', abs(lorenz - ranks) < 1e-9 FROM (SELECT 1 - sum((cy + cy - y) / ty * w / tw) AS lorenz, sum(y * (2 * (cw - w) + w - tw)) / (any_value(tw) * any_value(ty)) AS ranks FROM (SELECT x, w, y, sum(w) OVER (ORDER BY x) AS cw, sum(y) OVER (ORDER BY x) AS cy, sum(w) OVER () AS tw, sum(y) OVER () AS ty FROM (SELECT x, sum(w) AS w, sum(w * x) AS y FROM persons GROUP BY x)))
UNION ALL SELECT 'squared correlation is R2', abs(pow(corr(x, age), 2) - regr_r2(x, age)) < 1e-9 FROM persons
UNION ALL SELECT 'deviations of ranks sum to zero', abs(sum(r - m)) < 1e-6 * count(*) FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r, (count(*) OVER () + 1) / 2.0::DOUBLE AS m FROM persons)
UNION ALL SELECT 'expected cells keep the margins', abs(sum(e) - max(total)) < 1e-6 * max(total) FROM (SELECT sum(n) OVER (PARTITION BY seg) * sum(n) OVER (PARTITION BY grp) / sum(n) OVER () AS e, sum(n) OVER () AS total FROM (SELECT seg, grp, CAST(count(*) AS DOUBLE) AS n FROM persons GROUP BY ALL))
UNION ALL SELECT 'total variance is within plus between', abs(var_pop(x) - (SELECT sum(n * v) / sum(n) + sum(n * m * m) / sum(n) - pow(sum(n * m) / sum(n), 2) FROM (SELECT count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM persons GROUP BY seg))) < 1e-9 * var_pop(x) FROM persons""")
def _(spark, d):
    """Rows (check_name, ok): arithmetic that any right set of result tables fulfils."""
    p = persons(spark, d)
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    shares = D.frequency_table(p, "grp").agg(near(F.sum("share"), F.lit(1.0)).alias("ok"))
    a = K.anova(p, "x", "grp").crossJoin(p.agg((F.var_samp("x") * (F.count("x") - 1)).alias("tss")))
    lorenz = O.lorenz_points(p, "x", "w").agg(F.bool_and((c("q") <= c("p") + 1e-12) & (c("q") >= c("q0") - 1e-12)).alias("ok"))
    w = lambda s: F.sum(F.when(c("status").isin(*s), c("w")).otherwise(0))
    rates = p.agg(near(w("F") / F.sum("w"), w("FO") / F.sum("w") * (1 - w("O") / w("FO"))).alias("ok"))
    ranks = O.average_ranks(p, "x").agg(F.sum(c("n") * c("rank")).alias("s"), F.max("n_all").alias("m")).select(near(c("s"), c("m") * (c("m") + 1) / 2).alias("ok"))
    cells = K.contingency(p, "seg", "grp").agg((F.sum("n") == F.max("total")).alias("ok"))
    means = K.group_stats(p, "x", "seg").agg((F.sum(c("n") * c("mean")) / F.sum("n")).alias("m")).crossJoin(p.agg(F.avg("x").alias("own"))).select(near(c("m"), c("own")).alias("ok"))
    rows = [("shares sum to one", shares), ("sums of squares add up", a.select(near(c("ss_between") + c("ss_within"), c("tss")).alias("ok"))), ("Lorenz below the diagonal", lorenz), ("rates multiply", rates),
            ("F is the ratio of mean squares", a.select(near(c("f"), c("ss_between") / c("df1") / (c("ss_within") / c("df2"))).alias("ok"))), ("ranks sum to n (n + 1) / 2", ranks), ("cells sum to rows", cells), ("mean of group means", means),
            ("eta squared between 0 and 1", a.select(c("eta2").between(0, 1).alias("ok")))]
    s = O.prefix_sums(p, [], "x", {"k": c("w")})
    gaps = s.agg((F.sum(c("k") * c("x") * (2 * c("k_before") + c("k") - c("k_all"))) / (F.max("k_all") * F.sum(c("k") * c("x")))).alias("g"))
    rows.append(("Gini by Lorenz and by mean differences", O.gini(p, "x", "w").crossJoin(gaps).select(near(c("gini"), c("g")).alias("ok"))))
    rows.append(("squared correlation is R2", p.agg(near(F.pow(F.corr("x", "age"), 2), F.regr_r2("x", "age")).alias("ok"))))
    rows.append(("deviations of ranks sum to zero", O.average_ranks(p, "x").agg((F.abs(F.sum(c("n") * (c("rank") - (c("n_all") + 1) / 2))) < 1e-6 * F.max("n_all")).alias("ok"))))
    rows.append(("expected cells keep the margins", K.contingency(p, "seg", "grp").agg(near(F.sum("expected"), F.max("total").cast("double")).alias("ok"))))
    g = p.groupBy("seg").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).agg((F.sum(c("n") * c("v")) / F.sum("n") + F.sum(c("n") * c("m") * c("m")) / F.sum("n") - F.pow(F.sum(c("n") * c("m")) / F.sum("n"), 2)).alias("k"))
    rows.append(("total variance is within plus between", p.agg(F.var_pop("x").alias("v")).crossJoin(g).select(near(c("v"), c("k")).alias("ok"))))
    out = None
    for name, df in rows:
        one = df.select(F.lit(name).alias("check_name"), "ok")
        out = one if out is None else out.union(one)
    return out


@query("check_cross_tables", f"WITH {PERSONS}, a AS (SELECT seg, sum(w * x) / sum(w) AS m FROM persons GROUP BY 1), b AS (SELECT seg, sum(s) / sum(n) AS m FROM (SELECT seg, grp, sum(w * x) AS s, sum(w) AS n FROM persons GROUP BY ALL) GROUP BY seg) SELECT a.seg, round(a.m, 4) AS value, abs(a.m - b.m) <= 1e-9 * abs(a.m) AS agrees FROM a JOIN b USING (seg)")
def _(spark, d):
    p = persons(spark, d)
    a = p.groupBy("seg").agg((F.sum(c("w") * c("x")) / F.sum("w")).alias("m"))
    b = p.groupBy("seg", "grp").agg(F.sum(c("w") * c("x")).alias("s"), F.sum("w").alias("n")).groupBy(c("seg").alias("g")).agg((F.sum("s") / F.sum("n")).alias("k"))
    return a.join(b, c("seg") == c("g")).select("seg", r("m").alias("value"), (F.abs(c("m") - c("k")) <= 1e-9 * F.abs("m")).alias("agrees"))


RECOUNT = f"""WITH {PERSONS}, k AS (SELECT x, sum(w) AS w, sum(w * x) AS y FROM persons GROUP BY x), l AS (SELECT x, w, y, sum(w) OVER (ORDER BY x) AS cw, sum(y) OVER (ORDER BY x) AS cy, sum(w) OVER () AS tw, sum(y) OVER () AS ty FROM k),
g AS (SELECT 1 - sum((cy + cy - y) / ty * w / tw) AS lorenz, sum(y * (2 * (cw - w) + w - tw)) / (any_value(tw) * any_value(ty)) AS ranks FROM l),
s AS (SELECT seg, count(*) AS n, sum(w) AS w, sum(w * x) AS y, count(*) FILTER (p21 > 0) AS pos FROM persons GROUP BY seg),
a AS (SELECT count(*) AS n, sum(w) AS w, sum(w * x) / sum(w) AS m, count(*) FILTER (p21 > 0) AS pos, sum(w) FILTER (status = 'O') / CAST(sum(w) FILTER (status <> 'P') AS DOUBLE) AS u, sum(w) FILTER (status <> 'P') / CAST(sum(w) AS DOUBLE) AS act, sum(w) FILTER (status = 'F') / CAST(sum(w) AS DOUBLE) AS emp FROM persons),
q AS (SELECT 'rows' AS magnitude, CAST(n AS DOUBLE) AS value, CAST((SELECT sum(n) FROM s) AS DOUBLE) AS again FROM a UNION ALL SELECT 'weight', CAST(w AS DOUBLE), CAST((SELECT sum(w) FROM s) AS DOUBLE) FROM a UNION ALL SELECT 'mean', m, (SELECT sum(y) / sum(w) FROM s) FROM a UNION ALL SELECT 'positive', CAST(pos AS DOUBLE), CAST((SELECT sum(pos) FROM s) AS DOUBLE) FROM a
  UNION ALL SELECT 'unemployment', u, 1 - emp / act FROM a UNION ALL SELECT 'gini', lorenz, ranks FROM g)
SELECT magnitude, round(value, 4) AS value, round(again, 4) AS again, abs(value - again) <= 1e-9 * greatest(1, abs(value)) AS agrees FROM q"""


@query("recount_microdata", RECOUNT)
def _(spark, d):
    """Magnitudes counted from the rows and again by another way (from groups, from other rates, from mean differences), and whether both agree."""
    p = persons(spark, d)
    w = lambda *s: F.sum(F.when(c("status").isin(*s), c("w")))
    a = p.agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("weight"), (F.sum(c("w") * c("x")) / F.sum("w")).alias("mean"), F.count_if(c("p21") > 0).alias("positive"), (w("O") / w("F", "O")).alias("unemployment"), (1 - (w("F") / F.sum("w")) / (w("F", "O") / F.sum("w"))).alias("unemployment_again"))
    b = p.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(c("w") * c("x")).alias("y"), F.count_if(c("p21") > 0).alias("k")).agg(F.sum("n").alias("rows_again"), F.sum("w").alias("weight_again"), (F.sum("y") / F.sum("w")).alias("mean_again"), F.sum("k").alias("positive_again"))
    s = O.prefix_sums(p, [], "x", {"k": c("w")})
    mean_gap = s.agg((F.sum(c("k") * c("x") * (2 * c("k_before") + c("k") - c("k_all"))) / (F.max("k_all") * F.sum(c("k") * c("x")))).alias("gini_again"))
    t = a.crossJoin(b).crossJoin(O.gini(p, "x", "w")).crossJoin(mean_gap)  # a row each
    names = ["rows", "weight", "mean", "positive", "unemployment", "gini"]
    t = t.select(F.explode(F.array(*[F.struct(F.lit(k).alias("magnitude"), c(k).cast("double").alias("value"), c(k + "_again").cast("double").alias("again")) for k in names])).alias("q")).select("q.*")
    return t.select("magnitude", r("value").alias("value"), r("again").alias("again"), (F.abs(c("value") - c("again")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("value"))).alias("agrees"))


ORACLES["check_identities"] = ORACLES["check_identities"].format(anova_one_way=ORACLES["anova_one_way"])
