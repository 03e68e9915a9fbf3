"""Models from sums of products: one aggregate gives the Gram matrix, small dense algebra does the rest.

Rows never come to the driver; matrices of p x p numbers do, with p the number of columns named in the call.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as P


@dataclass
class Gram:
    """Sums of products of (1, x1 .. xp, y) about centres, with the number of rows."""

    names: list[str]
    n: int
    centre: np.ndarray
    m: np.ndarray  # centred sums of products of all columns, y last

    def drop(self, names: list[str]) -> Gram:
        keep = [i for i, k in enumerate(self.names) if k not in names]
        return Gram([self.names[i] for i in keep], self.n, self.centre[keep], self.m[np.ix_(keep, keep)])


def gram(df: DataFrame, xs: list[str], y: str, weight: str | None = None) -> Gram:
    """Two passes, the second about the means, against cancellation; rows with a missing value are left out."""
    names = [*xs, y]
    d = df.select(*[F.col(k).cast("double").alias(k) for k in names], *([weight] if weight else [])).dropna()
    w = F.col(weight) if weight else F.lit(1.0)
    a = d.agg(F.sum(w).alias("_n"), *[(F.sum(w * F.col(k)) / F.sum(w)).alias(k) for k in names]).first()
    centre = np.array([a[k] for k in names], float)
    z = [F.col(k) - F.lit(float(v)) for k, v in zip(names, centre, strict=True)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    b = d.agg(*[F.sum(w * z[i] * z[j]).alias(f"_{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((len(names), len(names)))
    for i, j in pairs:
        m[i, j] = m[j, i] = b[f"_{i}_{j}"]
    return Gram(names, int(a["_n"]), centre, m)


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray  # intercept first
    se: np.ndarray
    n: int
    df: int
    rss: float
    tss: float
    xtx_inv: np.ndarray  # of the centred predictors
    centre: np.ndarray

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss


def ols(g: Gram) -> Fit:
    k = len(g.names) - 1
    inv = np.linalg.inv(g.m[:k, :k])
    slope = inv @ g.m[:k, k]
    tss = float(g.m[k, k])
    rss = float(tss - slope @ g.m[:k, k])
    df = g.n - k - 1
    s2 = rss / df
    intercept = g.centre[k] - slope @ g.centre[:k]
    se0 = math.sqrt(s2 * (1 / g.n + g.centre[:k] @ inv @ g.centre[:k]))
    return Fit(["(constant)", *g.names[:k]], np.r_[intercept, slope], np.r_[se0, np.sqrt(s2 * np.diag(inv))], g.n, df, rss, tss, inv, g.centre[:k])


def coefficients(spark, g: Gram) -> DataFrame:
    """term, estimate, se, t, p, low, high, vif."""
    f = ols(g)
    k = len(g.names) - 1
    r_inv = np.linalg.inv(g.m[:k, :k] / np.sqrt(np.outer(np.diag(g.m)[:k], np.diag(g.m)[:k])))
    q = P.t_ppf(0.975, f.df)
    rows = [(n, float(b), float(s), float(b / s), float(b - q * s), float(b + q * s), None if i == 0 else float(r_inv[i - 1, i - 1])) for i, (n, b, s) in enumerate(zip(f.names, f.beta, f.se, strict=True))]
    d = spark.createDataFrame(rows, "term string, estimate double, se double, t double, low double, high double, vif double")
    return d.withColumn("p", P.t_two_sided(F.col("t"), F.lit(f.df)))


def fit_summary(f: Fit) -> dict:
    k = len(f.names) - 1
    return {"n": f.n, "r2": f.r2, "adj_r2": 1 - (1 - f.r2) * (f.n - 1) / f.df, "f": (f.tss - f.rss) / k / (f.rss / f.df), "sigma": math.sqrt(f.rss / f.df),
            "aic": f.n * math.log(f.rss / f.n) + 2 * (k + 1), "bic": f.n * math.log(f.rss / f.n) + math.log(f.n) * (k + 1)}


def linear(f: Fit) -> Column:
    return sum((F.lit(float(b)) * F.col(n) for b, n in zip(f.beta[1:], f.names[1:], strict=True)), F.lit(float(f.beta[0])))


def diagnostics(df: DataFrame, f: Fit, y: str) -> DataFrame:
    """df with fitted, residual, leverage, standardized and cook: Column expressions with the small inverse inside."""
    z = [F.col(n) - F.lit(float(c)) for n, c in zip(f.names[1:], f.centre, strict=True)]
    h = F.lit(1.0 / f.n)
    for i in range(len(z)):
        for j in range(len(z)):
            h = h + F.lit(float(f.xtx_inv[i, j])) * z[i] * z[j]
    s = math.sqrt(f.rss / f.df)
    d = df.withColumn("fitted", linear(f)).withColumn("residual", F.col(y) - F.col("fitted")).withColumn("leverage", h)
    d = d.withColumn("standardized", F.col("residual") / (s * F.sqrt(1 - F.col("leverage"))))
    return d.withColumn("cook", F.col("standardized") * F.col("standardized") * F.col("leverage") / (1 - F.col("leverage")) / len(f.names))


def logistic(df: DataFrame, xs: list[str], y: str, rounds: int = 50, tolerance: float = 1e-10) -> dict | None:
    """Newton steps, each one aggregate; None if it has not settled after rounds (as with separated classes)."""
    d = df.select(*[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias("_y")).dropna()
    s = d.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"), *[F.avg(x).alias("m_" + x) for x in xs], *[F.stddev_pop(x).alias("s_" + x) for x in xs]).first()
    mean, sd = np.array([s["m_" + x] for x in xs]), np.array([s["s_" + x] or 1.0 for x in xs])
    z = [F.lit(1.0), *[(F.col(x) - F.lit(float(m))) / F.lit(float(v)) for x, m, v in zip(xs, mean, sd, strict=True)]]
    k = len(z)
    beta = np.zeros(k)
    last = None
    for _ in range(rounds):
        eta = sum((F.lit(float(b)) * v for b, v in zip(beta, z, strict=True)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))
        ll = F.sum(-F.ln(1 + F.exp(-F.when(F.col("_y") == 1, eta).otherwise(-eta))))
        a = d.agg(ll.alias("ll"), *[F.sum((F.col("_y") - mu) * z[i]).alias(f"g{i}") for i in range(k)], *[F.sum(mu * (1 - mu) * z[i] * z[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        h = np.array([[a[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        try:
            step = np.linalg.solve(h, np.array([a[f"g{i}"] for i in range(k)]))
        except np.linalg.LinAlgError:
            return None
        if a["ll"] > -1e-6 * s["n"]:  # the classes are separated: no finite estimate
            return None
        if last is not None and abs(a["ll"] - last) <= tolerance * (abs(last) + 1):
            inv = np.linalg.inv(h)
            to = np.eye(k)
            to[0, 1:] = -mean / sd
            to[1:, 1:] = np.diag(1 / sd)
            own, cov = to @ beta, to @ inv @ to.T
            null = s["n"] * (s["m"] * math.log(s["m"]) + (1 - s["m"]) * math.log(1 - s["m"]))
            return {"names": ["(constant)", *xs], "beta": own, "se": np.sqrt(np.diag(cov)), "ll": a["ll"], "ll0": null, "n": s["n"]}
        last = a["ll"]
        beta = beta + step
        if not np.isfinite(beta).all() or np.abs(beta).max() > 1e4:
            return None
    return None


def signed(vectors: np.ndarray) -> np.ndarray:
    """Each column with its element of largest size positive, the lowest index on ties."""
    at = np.argmax(np.round(np.abs(vectors), 12), axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def pca(df: DataFrame, xs: list[str], standardized: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """eigenvalues, eigenvectors, means, scales: from the correlation (or covariance) matrix."""
    g = gram(df, xs[:-1], xs[-1])
    cov = g.m / (g.n - 1)
    scale = np.sqrt(np.diag(cov)) if standardized else np.ones(len(xs))
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-values, kind="stable")
    return values[order], signed(vectors[:, order]), g.centre, scale


def scores(df: DataFrame, xs: list[str], vectors: np.ndarray, centre: np.ndarray, scale: np.ndarray, k: int) -> DataFrame:
    z = [(F.col(x) - F.lit(float(c))) / F.lit(float(s)) for x, c, s in zip(xs, centre, scale, strict=True)]
    return df.withColumns({f"pc{j + 1}": sum((F.lit(float(v)) * a for v, a in zip(vectors[:, j], z, strict=True)), F.lit(0.0)) for j in range(k)})


def mahalanobis(df: DataFrame, xs: list[str]) -> DataFrame:
    """df with d2 from the mean in the metric of the inverse covariance."""
    g = gram(df, xs[:-1], xs[-1])
    inv = np.linalg.inv(g.m / (g.n - 1))
    z = [F.col(x) - F.lit(float(c)) for x, c in zip(xs, g.centre, strict=True)]
    d2 = F.lit(0.0)
    for i in range(len(xs)):
        for j in range(len(xs)):
            d2 = d2 + F.lit(float(inv[i, j])) * z[i] * z[j]
    return df.withColumn("d2", d2)


def correspondence(table: np.ndarray) -> dict:
    """Of a contingency table of few rows and columns: masses, inertia by axis, coordinates, chi2."""
    n = table.sum()
    p = table / n
    r, c = p.sum(1), p.sum(0)
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    u, d, vt = np.linalg.svd(s, full_matrices=False)
    keep = d > 1e-9
    v = signed(vt.T[:, keep])
    u = s @ v / d[keep]
    return {"inertia": d[keep] ** 2, "rows": u * d[keep] / np.sqrt(r)[:, None], "columns": v * d[keep] / np.sqrt(c)[:, None], "row_mass": r, "column_mass": c, "chi2": n * float((d**2).sum())}


def leave_one_out(df: DataFrame, group: str, xs: list[str]) -> DataFrame:
    """group, r (correlations of all pairs of xs, in order, without the group's rows), share (of the first component then).

    Each group is its number of rows, sums and products about the whole mean; what is left without it are the totals less these.
    """
    p = len(xs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    centre = df.agg(*[F.avg(x).alias(x) for x in xs]).first()
    z = [F.col(x) - F.lit(float(centre[x])) for x in xs]
    sums = df.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("_n"), *[F.sum(v).alias(f"_s{i}") for i, v in enumerate(z)], *[F.sum(z[i] * z[j]).alias(f"_m{i}_{j}") for i, j in pairs])
    names = ["_n", *[f"_s{i}" for i in range(p)], *[f"_m{i}_{j}" for i, j in pairs]]
    total = np.array([float(v) for v in sums.agg(*[F.sum(k) for k in names]).first()])  # p (p + 3) / 2 + 1 numbers
    kind = df.schema[group].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for b in batches:
            left = total - b[names].to_numpy(float)
            n, s = left[:, 0], left[:, 1:p + 1]
            m = np.zeros((len(b), p, p))
            for k, (i, j) in enumerate(pairs):
                m[:, i, j] = m[:, j, i] = left[:, p + 1 + k]
            cov = m - s[:, :, None] * s[:, None] / n[:, None, None]
            sd = np.sqrt(np.einsum("bii->bi", cov))
            with np.errstate(invalid="ignore", divide="ignore"):
                cor = cov / (sd[:, :, None] * sd[:, None])
            whole = np.isfinite(cor).all((1, 2))
            top = np.full(len(b), np.nan)
            top[whole] = np.linalg.eigvalsh(cor[whole])[:, -1] / p
            r = [[None if np.isnan(c[i, j]) else float(c[i, j]) for i, j in pairs if i < j] for c in cor]
            yield pd.DataFrame({group: b[group], "r": r, "share": [None if np.isnan(t) else float(t) for t in top]})

    return sums.mapInPandas(run, f"{group} {kind}, r array<double>, share double")


def correspondence_points(cells: DataFrame, axes: int = 2) -> DataFrame:
    """label, side, mass, inertia, axis1 .., contribution1 .., quality, from a, b, n, row_n, col_n, total, expected of a contingency table.

    Residuals are cells; their products are summed over the longer side, so that only a matrix of the shorter one's labels is
    decomposed. The longer side's points are sums over its cells.
    """
    few_rows = cells.select("a").distinct().count() < cells.select("b").distinct().count()
    own, other, own_n, other_n = ("b", "a", "col_n", "row_n") if few_rows else ("a", "b", "row_n", "col_n")
    res = (F.col("n") - F.col("expected")) / F.sqrt(F.col("expected") * F.col("total"))
    s = cells.filter("expected > 0").select(F.col(own).cast("string").alias("long"), F.col(other).cast("string").alias("short"), (F.col(own_n) / F.col("total")).alias("long_mass"), (F.col(other_n) / F.col("total")).alias("short_mass"), res.alias("s"))
    left, right = s.select("long", F.col("short").alias("j"), F.col("s").alias("sj")), s.select(F.col("long").alias("l"), F.col("short").alias("k"), F.col("s").alias("sk"))
    gram_ = left.join(right, F.col("long") == F.col("l")).groupBy("j", "k").agg(F.sum(F.col("sj") * F.col("sk")).alias("m")).collect()  # the shorter side's labels squared
    labels = sorted({q["j"] for q in gram_})
    m = np.zeros((len(labels), len(labels)))
    at = {k: i for i, k in enumerate(labels)}
    for q in gram_:
        m[at[q["j"]], at[q["k"]]] = q["m"]
    values, vectors = np.linalg.eigh(m)
    values, vectors = values[::-1][:axes], signed(vectors[:, ::-1][:, :axes])
    spark = cells.sparkSession
    names = [f"v{k}" for k in range(1, axes + 1)]
    v = spark.createDataFrame([(k, *[float(x) for x in vectors[i]]) for i, k in enumerate(labels)], "of string, " + ", ".join(f"{k} double" for k in names))
    lam = [max(float(x), 0.0) for x in values]
    sums = s.join(v, F.col("short") == F.col("of")).groupBy("long").agg(F.first("long_mass").alias("mass"), F.sum(F.col("s") * F.col("s")).alias("inertia"), *[F.sum(F.col("s") * F.col(k)).alias(k) for k in names])
    points = sums.select(F.col("long").alias("label"), F.lit("row" if own == "a" else "column").alias("side"), "mass", "inertia", *[(F.col(k) / F.sqrt("mass")).alias(f"axis{i}") for i, k in enumerate(names, 1)])
    short = s.groupBy("short").agg(F.first("short_mass").alias("mass"), F.sum(F.col("s") * F.col("s")).alias("inertia")).join(v, F.col("short") == F.col("of"))
    points = points.union(short.select("short", F.lit("column" if own == "a" else "row"), "mass", "inertia", *[F.col(k) * F.lit(x**0.5) / F.sqrt("mass") for k, x in zip(names, lam, strict=True)]))
    squares = [F.col("mass") * F.col(f"axis{i}") * F.col(f"axis{i}") for i in range(1, axes + 1)]
    return points.select("*", *[(q / F.lit(x) if x > 0 else F.lit(0.0)).alias(f"contribution{i}") for i, (q, x) in enumerate(zip(squares, lam, strict=True), 1)], (sum(squares[1:], squares[0]) / F.nullif("inertia", F.lit(0.0))).alias("quality"))


def two_way(cells: DataFrame, a: str, b: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(effect, sum of squares, df) of type III and of type I in both orders, and whether a cell is empty.

    From cells (a, b, n, sy, syy), effect coded; least squares on the cells.
    """
    rows = cells.collect()  # a row a cell
    la, lb = sorted({x[a] for x in rows}), sorted({x[b] for x in rows})
    code = lambda v, levels: [1.0 if v == k else 0.0 for k in levels[:-1]] if v != levels[-1] else [-1.0] * (len(levels) - 1)
    n = np.array([float(x["n"]) for x in rows])
    mean = np.array([x["sy"] / x["n"] for x in rows])
    xa, xb = np.array([code(x[a], la) for x in rows]), np.array([code(x[b], lb) for x in rows])
    xi = np.einsum("ij,ik->ijk", xa, xb).reshape(len(rows), -1)
    within = float(sum(x["syy"] - x["sy"] ** 2 / x["n"] for x in rows))

    def rss(*blocks: np.ndarray) -> float:
        x = np.column_stack([np.ones(len(rows)), *blocks]) * np.sqrt(n)[:, None]
        y = mean * np.sqrt(n)
        fit = np.linalg.lstsq(x, y, rcond=None)[0]
        return float(((y - x @ fit) ** 2).sum())

    full = rss(xa, xb, xi)
    out = [(a, rss(xb, xi) - full, xa.shape[1]), (b, rss(xa, xi) - full, xb.shape[1]), ("interaction", rss(xa, xb) - full, xi.shape[1])]
    out += [(f"{a} (type I)", rss() - rss(xa), xa.shape[1]), (f"{b} (type I)", rss(xa) - rss(xa, xb), xb.shape[1])]
    out += [(f"{b} first (type I)", rss() - rss(xb), xb.shape[1]), (f"{a} second (type I)", rss(xb) - rss(xa, xb), xa.shape[1])]
    return [*out, ("residual", within + full, int(n.sum()) - len(rows))], len(rows) < len(la) * len(lb)
