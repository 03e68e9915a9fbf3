"""What needs a global order: running totals, ranks, lags, weighted quantiles, Lorenz curves.

A window without a partition would move a table into one task. Here rows are collapsed to distinct values first (so
heaped values help), cut into ranges of value at approximate quantiles, ranged over partitions by these, summed within each range where it
lies, and shifted by the totals of the ranges before, of which there is one small row each. The windows ask for the
partitioning that is there, so a table is exchanged once.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Ranges of value at most: as many rows of totals for each group.
RANGES = 512
#: Tables held for a second reading; beyond, the oldest is let go. All can be made again alike.
HELD = 12
_held: deque[DataFrame] = deque()


def held(df: DataFrame) -> DataFrame:
    """df, persisted until enough others have been; only for tables that give the same rows when they are made again."""
    while _held and (len(_held) >= HELD or _held[0].sparkSession is not df.sparkSession):
        old = _held.popleft()
        if old.sparkSession is df.sparkSession:
            old.unpersist()
    _held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def edges(df: DataFrame, value: str, parts: int | None = None) -> list[float]:
    """Values that cut df into about as many ranges as there are shuffle partitions, of about as many rows each."""
    n = min(RANGES, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n < 2:
        return []
    x = F.col(value).cast("double")
    found = df.agg(F.percentile_approx(x, [k / n for k in range(1, n)], 20 * n).alias("q")).first()["q"]
    return sorted({q for q in found or [] if q == q})


def range_of(value: str, cuts: list[float]) -> Column:
    """How many of cuts are below the value: the number of its range."""
    x = F.col(value).cast("double")

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(cuts[mid]), among(lo, mid)).otherwise(among(mid + 1, hi))

    return among(0, len(cuts)).cast("int")


def ranged(df: DataFrame, by: list[str], value: str, parts: int | None = None) -> DataFrame:
    """df with _p, the range of its value, and its rows partitioned by group and range."""
    d = df.withColumn("_p", range_of(value, edges(df, value, parts)))
    keys = [*[F.col(b).asc_nulls_first() for b in by], F.col("_p")]
    return d.repartitionByRange(*([parts] if parts else []), *keys)


def prefix_sums(df: DataFrame, by: list[str], value: str, sums: dict[str, Column], parts: int | None = None, beside: dict[str, Column] | None = None) -> DataFrame:
    """by, value and, for each name in sums, name (at this value), name_before (below it) and name_all (of the group).

    beside names other aggregates of a value's rows, carried along. df may have many rows a value. With groups, ranges are over (group, value), so a hot group spreads.
    """
    one = held(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[c.alias(n) for n, c in (beside or {}).items()]))
    d = ranged(one, by, value, parts)
    inside = Window.partitionBy("_p", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("_p", *by).agg(*[F.sum(n).alias(n) for n in sums])
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    shift = totals.select(
        F.col("_p").alias("_q"), *[F.col(b).alias("_" + b) for b in by],
        *[F.coalesce(F.sum(n).over(over.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{n}_shift") for n in sums],
        *[F.sum(n).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{n}_all") for n in sums])
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col("_" + b)) for b in by], F.col("_p") == F.col("_q"))
    # one row a range (and group in it): at most ranges times groups
    out = d.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums}).join(shift, on)
    return out.select(*by, value, *sums, *(beside or {}), *[(F.col(f"{n}_before") + F.col(f"_{n}_shift")).alias(f"{n}_before") for n in sums], *[f"{n}_all" for n in sums])


def lagged(df: DataFrame, order: list[str], value: str, lags: list[int]) -> DataFrame:
    """df with value_k for each k in lags: the value k rows before, in the order of columns that tell all rows apart; the first is a number.

    Rows are ranged by the first column and lagged within their range. The last rows of each range, as many as the longest
    lag, go on to the ranges behind it: a table of so many rows a range.
    """
    most = max(lags)
    d = ranged(df, [], order[0])
    own = Window.partitionBy("_p").orderBy(*order)
    last = d.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*[F.desc(c) for c in order]))).filter(F.col("_r") <= most)
    tails = Window.partitionBy(F.lit(0)).orderBy("_p", F.desc("_r"))
    halo = (last.select("_p", "_r", F.collect_list(F.struct(F.col(value).alias("v"))).over(tails.rowsBetween(-most, -1)).alias("_halo"), F.max("_r").over(Window.partitionBy("_p")).alias("_m"))
            .filter(F.col("_r") == F.col("_m")).select(F.col("_p").alias("_q"), "_halo"))
    out = d.withColumn("_r", F.row_number().over(own)).withColumns({f"{value}_{k}": F.lag(value, k).over(own) for k in lags}).join(F.broadcast(halo), F.col("_p") == F.col("_q"))
    before = lambda k: F.get("_halo", F.size("_halo") - (k - F.col("_r") + 1))["v"]
    return out.select(*df.columns, *[F.when(F.col("_r") > k, F.col(f"{value}_{k}")).otherwise(before(k)).alias(f"{value}_{k}") for k in lags])


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, value, n (ties), rank (average of the tied places)."""
    s = prefix_sums(df, by or [], value, {"n": F.lit(1)})
    return s.select(*(by or []), value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"), F.col("n_all"))


def places(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, value, _n rows of it, _n_before rows below it, _n_all rows of the group: what at_place reads places off."""
    return prefix_sums(df, by or [], value, {"_n": F.lit(1)})


def at_place(value: str, h: Column) -> Column:
    """An aggregate over places(): the value at place h, from 1, of a group's order, interpolated between its neighbours."""
    low = F.floor(h)
    part = h - low
    holds = lambda k: (F.col("_n_before") < k) & (k <= F.col("_n_before") + F.col("_n"))
    v = F.col(value).cast("double")
    return F.sum(F.when(holds(low), v * (1 - part)).otherwise(0.0) + F.when((part > 0) & holds(low + 1), v * part).otherwise(0.0))


def quantiles(df: DataFrame, value: str, ps: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by and, for each name in ps, the quantile of type 7; groups without a value are left out, without groups there is one row."""
    found = places(df, value, by).groupBy(*(by or []))
    return found.agg(*[F.when(F.count(F.lit(1)) > 0, at_place(value, (F.col("_n_all") - 1) * p + 1)).alias(name) for name, p in ps.items()])


def quantiles_step(df: DataFrame, value: str, weight: str, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """by, p, q: the first value whose running weight reaches p of the total."""
    by = by or []
    s = prefix_sums(df.filter(F.col(weight) > 0), by, value, {"w": F.col(weight)})
    at = s.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    hit = at.filter(F.col("w_before") + F.col("w") >= F.col("p") * F.col("w_all"))
    return hit.groupBy(*by, "p").agg(F.min(value).alias("q"))


def quantiles_midpoint(df: DataFrame, value: str, weight: str, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """by, p, q: weighted quantiles with each row's place at the middle of its weight, interpolated, clamped at the ends.

    Tied values are taken in order of weight, so only the first and last place of a tied block matter: those of its
    lightest and heaviest row.
    """
    by = by or []
    d = df.filter((F.col(weight) > 0) & F.col(value).isNotNull())
    s = prefix_sums(d, by, value, {"w": F.col(weight)}, beside={"_low": F.min(weight), "_high": F.max(weight)})
    s = s.select(*by, value, ((F.col("w_before") + F.col("_low") / 2) / F.col("w_all")).alias("lo"), ((F.col("w_before") + F.col("w") - F.col("_high") / 2) / F.col("w_all")).alias("hi"))
    at = s.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    below = F.max(F.when(F.col("hi") <= F.col("p"), F.struct(F.col("hi").alias("x"), F.col(value).alias("v"))))
    above = F.min(F.when(F.col("lo") >= F.col("p"), F.struct(F.col("lo").alias("x"), F.col(value).alias("v"))))
    inside = F.min(F.when((F.col("lo") <= F.col("p")) & (F.col("p") <= F.col("hi")), F.col(value)))
    g = at.groupBy(*by, "p").agg(below.alias("b"), above.alias("a"), inside.alias("i"))
    mid = F.col("b.v") + (F.col("a.v") - F.col("b.v")) * (F.col("p") - F.col("b.x")) / F.nullif(F.col("a.x") - F.col("b.x"), F.lit(0.0))
    return g.select(*by, "p", F.coalesce("i", F.when(F.col("b").isNull(), F.col("a.v")).when(F.col("a").isNull(), F.col("b.v")).otherwise(F.coalesce(mid, F.col("b.v")))).alias("q"))


def lorenz_points(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """by, value, p, q: shares of population and of income up to and with each value; p0, q0 those before it."""
    s = prefix_sums(df.filter(F.col(weight) > 0), by or [], value, {"w": F.col(weight), "y": F.col(weight) * F.col(value)})
    return s.select(*(by or []), value, ((F.col("w_before") + F.col("w")) / F.col("w_all")).alias("p"), ((F.col("y_before") + F.col("y")) / F.col("y_all")).alias("q"), (F.col("w_before") / F.col("w_all")).alias("p0"), (F.col("y_before") / F.col("y_all")).alias("q0"))


def gini(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """by, gini: one less twice the area under the Lorenz curve, by trapezoids from the origin."""
    return lorenz_points(df, value, weight, by).groupBy(*(by or [])).agg((1 - F.sum((F.col("q") + F.col("q0")) * (F.col("p") - F.col("p0")))).alias("gini"))


def lorenz_grid(df: DataFrame, value: str, weight: str, steps: int = 100) -> DataFrame:
    """k, p, q for k = 0..steps: the curve read off at equal steps of the population."""
    pts = lorenz_points(df, value, weight)
    # each segment serves the grid points inside it
    k = F.explode(F.filter(F.sequence(F.floor(F.col("p0") * steps).cast("int"), F.ceil(F.col("p") * steps).cast("int")), lambda k: (k / steps > F.col("p0")) & (k / steps <= F.col("p"))))
    g = pts.withColumn("k", k).select("k", (F.col("k") / steps).alias("p_at"), (F.col("q0") + (F.col("q") - F.col("q0")) * (F.col("k") / steps - F.col("p0")) / (F.col("p") - F.col("p0"))).alias("q"))
    zero = df.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(0.0).alias("p_at"), F.lit(0.0).alias("q"))
    return g.unionByName(zero).withColumnRenamed("p_at", "p")


def index_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """df with row_index, from 1, in the order of columns that tell all rows apart."""
    keys = [F.col(c) for c in order]
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("_at", 33)  # a partition's number stands above the place in it
    n = d.groupBy(part.alias("_q")).agg(F.count(F.lit(1)).alias("_n")).select("_q", (F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.shiftleft("_q", 33) + 1).alias("_shift"))
    return d.join(F.broadcast(n), part == F.col("_q")).withColumn("row_index", (F.col("_at") + F.col("_shift")).cast("long")).drop("_at", "_q", "_shift")
