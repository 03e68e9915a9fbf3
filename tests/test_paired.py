"""Paired differences do not depend on where and in which order the rows lie."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyworks.operators.compare import wilcoxon_signed
from tallyworks.plans.comparisons import paired


def test_order_of_rows(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(3)
    n = 4000  # dwellings, with four persons in 1996 and one in 1997: a mean of four ends in a 5 at the seventh decimal, if at all
    rows = [(j * n + i, i, "F", float(rng.integers(100_000, 50_000_000)) / 100, "a", "1997-05-01" if j == 4 else "1996-05-01") for j in range(5) for i in range(n)]
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string, o_orderdate string"
    orders = spark.createDataFrame(rows, kinds).withColumn("o_orderdate", F.to_timestamp("o_orderdate"))
    customer = spark.range(n).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).alias("c_nationkey"), F.lit("x").alias("c_mktsegment"))
    found = []
    for i, t in enumerate([orders.coalesce(1).sortWithinPartitions("o_orderkey"), orders.coalesce(1).sortWithinPartitions(F.desc("o_orderkey")), orders.repartition(7, F.rand(1)).sortWithinPartitions(F.rand(2))]):
        t.write.parquet(f"{tmp_path}/{i}/orders.parquet")
        customer.write.parquet(f"{tmp_path}/{i}/customer.parquet")
        found.append({r.psu: r.d for r in paired(spark, f"{tmp_path}/{i}").collect()})
    assert len(found[0]) == n and found[0] == found[1] == found[2]
    con = duckdb.connect()
    con.execute("SET threads = 1")  # so that SQL sums in the order of the table
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/0/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["wilcoxon_signed"]).fetchall()
    for i in range(3):
        assert [tuple(r) for r in entry.queries()["wilcoxon_signed"](spark, f"{tmp_path}/{i}").collect()] == want


def test_ties_beyond_whole_numbers(spark):
    df = spark.range(3_000_000).select(F.lit(1.0).alias("d"))
    r = wilcoxon_signed(df, F.col("d")).first()
    assert r.n == 3_000_000 and r.w_plus == 3_000_000 * 3_000_001 / 2 and r.w_minus == 0
