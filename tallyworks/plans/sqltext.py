"""DuckDB text of what DuckDB has no functions for: tails of distributions as series, and least squares by sweeps."""

from __future__ import annotations


def gamma_upper(a: str, x: str) -> str:
    """Regularised upper incomplete gamma: one less the series of the lower, summed on the log scale."""
    last = f"CAST(greatest(({x}) - ({a}), 0) + 14 * sqrt({x}) + 60 AS BIGINT)"
    term = f"exp((({a}) + _i) * ln({x}) - ({x}) - lgamma(({a}) + _i + 1))"
    return f"(CASE WHEN ({x}) <= 0 THEN 1.0::DOUBLE WHEN ({x}) > ({a}) + 60 * sqrt({a}) + 800 THEN 0.0::DOUBLE ELSE 1 - list_sum(list_transform(generate_series(0, {last}), lambda _i: {term})) END)"


def beta_lower(x: str, a: str, b: str) -> str:
    """Regularised incomplete beta by its hypergeometric series."""
    last = f"CAST(greatest(((({a}) + ({b})) * ({x}) - ({a})) / (1 - ({x})), 0) + 14 * sqrt((({a}) + ({b})) * ({x})) / (1 - ({x})) + 100 AS BIGINT)"
    term = f"exp((({a}) + _i) * ln({x}) + ({b}) * ln(1 - ({x})) + lgamma(({a}) + ({b}) + _i) - lgamma({b}) - lgamma(({a}) + 1 + _i))"
    return f"(CASE WHEN ({x}) <= 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform(generate_series(0, {last}), lambda _i: {term})) END)"


def f_upper(f: str, d1: str, d2: str) -> str:
    x = f"(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2})))"
    return f"(1 - {beta_lower(x, f'(({d1}) / 2.0::DOUBLE)', f'(({d2}) / 2.0::DOUBLE)')})"


def t_two_sided(t: str, df: str) -> str:
    return f_upper(f"(({t}) * ({t}))", "1", df)


def chi2_upper(x: str, df: str) -> str:
    return gamma_upper(f"(({df}) / 2.0::DOUBLE)", f"(({x}) / 2.0::DOUBLE)")


def normal_two_sided(z: str) -> str:
    return gamma_upper("0.5::DOUBLE", f"(({z}) * ({z}) / 2.0::DOUBLE)")


def normal_lower(z: str) -> str:
    return f"(CASE WHEN ({z}) > 0 THEN 1 - {normal_two_sided(z)} / 2 ELSE {normal_two_sided(z)} / 2 END)"


def bisected(name: str, source: str, keys: list[str], holds: str, low: str, high: str, steps: int = 60) -> str:
    """A recursive table name(keys, q): the least q between low and high (text over source) from which on holds is true, a text over q and source's columns."""
    k = ", ".join(keys)
    return (f"{name}_b AS (SELECT {k}, 0 AS step, CAST({low} AS DOUBLE) AS lo, CAST({high} AS DOUBLE) AS hi FROM {source} UNION ALL "
            f"SELECT {k}, step + 1, CASE WHEN ok THEN lo ELSE q END, CASE WHEN ok THEN q ELSE hi END FROM (SELECT *, ({holds}) AS ok FROM (SELECT b.step, b.lo, b.hi, (b.lo + b.hi) / 2 AS q, s.* FROM {name}_b b JOIN {source} s USING ({k}))) WHERE step < {steps}), "
            f"{name} AS (SELECT {k}, (lo + hi) / 2 AS q FROM {name}_b WHERE step = {steps})")


class Sweeps:
    """Least squares in SQL: centred sums of products of columns, and sweeps of them, as a chain of one-row tables.

    After a sweep of columns x1 .. xk, entry (i, j) of two swept columns is minus the inverse, entry (i, y) the
    coefficient, entry (y, y) the residual sum of squares.
    """

    def __init__(self, name: str, source: str, columns: dict[str, str], where: str = "true", count: str = "n"):
        self.name, self.names = name, list(columns)
        n = len(self.names)
        means = ", ".join(f"avg({e}) AS c{i}" for i, e in enumerate(columns.values()))
        self.tables = [f"{name}_c AS (SELECT CAST(count(*) AS DOUBLE) AS {count}, {means} FROM {source} WHERE {where})"]
        z = [f"(({e}) - c{i})" for i, e in enumerate(columns.values())]
        self.pairs = [(i, j) for i in range(n) for j in range(i, n)]
        sums = ", ".join(f"sum({z[i]} * {z[j]}) AS m{i}_{j}" for i, j in self.pairs)
        self.tables.append(f"{name}_0 AS (SELECT {sums} FROM {source}, {name}_c WHERE {where})")
        self.last, self.steps = f"{name}_0", 0

    @classmethod
    def over(cls, name: str, names: list[str], start: str | None = None) -> Sweeps:
        """Sweeps of a table of sums that is there already."""
        out = cls.__new__(cls)
        out.name, out.names, out.tables = name, names, []
        out.pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        out.last, out.steps = start or f"{name}_0", 0
        return out

    def at(self, a: str, b: str) -> str:
        i, j = sorted((self.names.index(a), self.names.index(b)))
        return f"m{i}_{j}"

    def sweep(self, *columns: str) -> Sweeps:
        for c in columns:
            k = self.names.index(c)
            d = f"m{k}_{k}"

            def entry(i: int, j: int) -> str:
                if i == j == k:
                    return f"-1 / {d}"
                if k in (i, j):
                    return f"m{i}_{j} / {d}"
                (a, b), (p, q) = sorted((i, k)), sorted((j, k))
                return f"m{i}_{j} - m{a}_{b} * m{p}_{q} / {d}"

            self.steps += 1
            name = f"{self.name}_{self.steps}"
            self.tables.append(f"{name} AS (SELECT {', '.join(f'{entry(i, j)} AS m{i}_{j}' for i, j in self.pairs)} FROM {self.last})")
            self.last = name
        return self

    @property
    def text(self) -> str:
        return ", ".join(self.tables)
