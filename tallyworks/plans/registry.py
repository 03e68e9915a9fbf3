"""Where queries register themselves, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its DuckDB text where there is one."""
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All double columns rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders seen as persons of a survey: stratum, psu (dwelling), weight, status, groups and income."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("psu"), F.col("c_nationkey").alias("stratum"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("grp"), F.col("c_mktsegment").alias("seg"),
        (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 7 + 1).alias("w"), ((F.col("o_orderkey") % 97) - 1).cast("int").alias("age"),
        F.when(F.col("o_orderkey") % 9 == 0, F.lit(-9.0)).when(F.col("o_orderkey") % 11 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / 1000).alias("p21"), F.col("o_orderdate").alias("day"))


PERSONS = """persons AS (SELECT o_orderkey AS id, o_custkey AS psu, c_nationkey AS stratum, o_orderstatus AS status, o_orderpriority AS grp, c_mktsegment AS seg,
  o_totalprice / 1000 AS x, o_orderkey % 7 + 1 AS w, CAST(o_orderkey % 97 - 1 AS INTEGER) AS age,
  CASE WHEN o_orderkey % 9 = 0 THEN -9.0::DOUBLE WHEN o_orderkey % 11 = 0 THEN 0.0::DOUBLE ELSE o_totalprice / 1000 END AS p21, o_orderdate AS day FROM orders JOIN customer ON o_custkey = c_custkey)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dirty survey file made of orders: every cell text, in a foreign dialect, with impossible entries and repeated ids."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("line_no"), (k - F.when(k % 10 == 3, 1).otherwise(0)).cast("string").alias("id"),
        F.when(k % 13 == 0, "NA").when(k % 29 == 0, "1.2.3x").otherwise(F.concat((k % 9).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(","), F.lpad((k % 100).cast("string"), 2, "0"))).alias("amount"),
        F.when(k % 17 == 0, " ").when(k % 5 == 0, F.upper("o_orderpriority")).otherwise(F.concat(F.lit("  "), F.lower("o_orderpriority"))).alias("kind"),
        F.when(k % 19 == 0, "31/02/2024").when(k % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        (k % 120 - 3).cast("string").alias("age"), F.lit("const").alias("fixed"))


DIRTY = """dirty AS (SELECT o_orderkey AS line_no, CAST(o_orderkey - CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS VARCHAR) AS id,
  CASE WHEN o_orderkey % 13 = 0 THEN 'NA' WHEN o_orderkey % 29 = 0 THEN '1.2.3x' ELSE (o_orderkey % 9) || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') END AS amount,
  CASE WHEN o_orderkey % 17 = 0 THEN ' ' WHEN o_orderkey % 5 = 0 THEN upper(o_orderpriority) ELSE '  ' || lower(o_orderpriority) END AS kind,
  CASE WHEN o_orderkey % 19 = 0 THEN '31/02/2024' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CAST(o_orderkey % 120 - 3 AS VARCHAR) AS age, 'const' AS fixed FROM orders)"""
