"""Monthly series and price indices: everything is a window over one series' months or a join to a base month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_month(series: list[str]):
    return Window.partitionBy(*series).orderBy("month") if series else Window.partitionBy(F.lit(0)).orderBy("month")


def changes(df: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """monthly and yearly change, year-to-date change against the December before (null where that is missing)."""
    w = by_month(series)
    v = F.col(value)
    d = df.withColumn("monthly", v / F.lag(v, 1).over(w) - 1).withColumn("yearly", v / F.lag(v, 12).over(w) - 1)
    dec = df.filter(F.month("month") == 12).select(*[F.col(s).alias("_" + s) for s in series], (F.year("month") + 1).alias("_y"), v.alias("_dec"))
    on = F.year("month") == F.col("_y")
    for s in series:
        on = on & (F.col(s) == F.col("_" + s))
    return d.join(dec, on, "left").withColumn("year_to_date", v / F.col("_dec") - 1).drop("_y", "_dec", *["_" + s for s in series])


def rebase(df: DataFrame, month: str, value: str = "value") -> DataFrame:
    """rebased: 100 at the given month."""
    base = df.filter(F.col("month") == F.lit(month).cast("date")).select(F.col(value).alias("_b"))
    return df.crossJoin(F.broadcast(base)).withColumn("rebased", 100 * F.col(value) / F.col("_b")).drop("_b")  # one row


def splice(old: DataFrame, new: DataFrame, month: str) -> DataFrame:
    """month, value: old up to the overlap, then new times the coefficient of both at the overlap."""
    at = F.lit(month).cast("date")
    k = old.filter(F.col("month") == at).select(F.col("value").alias("_o")).crossJoin(new.filter(F.col("month") == at).select(F.col("value").alias("_n"))).select((F.col("_o") / F.col("_n")).alias("_k"))
    later = new.filter(F.col("month") > at).crossJoin(F.broadcast(k)).select("month", (F.col("value") * F.col("_k")).alias("value"))
    return old.filter(F.col("month") <= at).select("month", "value").union(later)


def centred_ma(df: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """ma: mean of the 2 x 12 centred window; null where it is incomplete."""
    w = by_month(series)
    full = F.count(value).over(w.rowsBetween(-6, 5))
    m = F.when(full == 12, F.avg(value).over(w.rowsBetween(-6, 5)))
    return df.withColumn("_m", m).withColumn("ma", (F.col("_m") + F.lead("_m").over(w)) / 2).drop("_m")


def seasonal(df: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """series, month_no, seasonal: median ratio to the moving average by month, scaled to a mean of 1."""
    d = centred_ma(df, series, value).filter("ma IS NOT NULL")
    m = d.groupBy(*series, F.month("month").alias("month_no")).agg(F.percentile(F.col(value) / F.col("ma"), 0.5).alias("k"))
    over = Window.partitionBy(*series) if series else Window.partitionBy(F.lit(0))
    return m.withColumn("seasonal", F.col("k") / F.avg("k").over(over)).drop("k")


def price_indices(df: DataFrame, p0: Column, q0: Column, p1: Column, q1: Column, by: list[str]) -> DataFrame:
    """Laspeyres, Paasche, Fisher and the value index of prices and quantities at two times."""
    s = df.groupBy(*by).agg(F.sum(p1 * q0).alias("a"), F.sum(p0 * q0).alias("b"), F.sum(p1 * q1).alias("c"), F.sum(p0 * q1).alias("e"))
    lasp, paas = F.col("a") / F.col("b"), F.col("c") / F.col("e")
    return s.select(*by, lasp.alias("laspeyres"), paas.alias("paasche"), F.sqrt(lasp * paas).alias("fisher"), (F.col("c") / F.col("b")).alias("value_index"))
