"""Draws made in batches against hashes one by one, and against the same draws row by row."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyworks.functions.hashes import Steps, Texts
from tallyworks.operators import resample as B
from tallyworks.operators.survey import poisson_edges, replicates

KEYS = ["", "1", "22", "é", "a:b", "x" * 51, "x" * 52, "x" * 53, "x" * 54, "y" * 200, *map(str, range(990, 1400))]


def bits(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize("ending", ["7", "42", "200"])
def test_hashes_of_many_texts(ending):
    t = Texts(pa.array(["zz", *KEYS]).slice(1), 3)
    assert t.bits(ending).tolist() == [bits(k + ending) for k in KEYS]
    e = np.array(poisson_edges())
    assert Steps(poisson_edges()).of(*t.words(ending)).tolist() == [int((bits(k + ending) / 2**52 >= e).sum()) for k in KEYS]


def test_steps_at_their_edges():
    e = poisson_edges()
    s = Steps(e)
    u = np.sort(np.r_[s.least - 1, s.least, 0, 2**52 - 1])
    a = (u >> 20).astype(np.uint32).byteswap()
    b = ((u & 0xFFFFF).astype(np.uint32) << np.uint32(12)).byteswap()
    assert s.of(a, b).tolist() == [int((x / 2**52 >= np.array(e)).sum()) for x in u]


def odd(spark):
    rows = [(k, float(i % 7) + 0.25) for i, k in enumerate(KEYS)] + [("1", 2.5), (None, 1.5), ("n", None), ("m", None)]
    return spark.createDataFrame(rows, "id string, x double").repartition(3)


def by_rows(df, sums, n):
    return replicates(df, "id", n, "s").groupBy("rep").agg(F.count(F.lit(1)).alias("drawn"), *[F.sum(F.col("times") * c).alias(k) for k, c in sums.items()])


@pytest.mark.parametrize("which", ["odd", "all null", "two rows", "not a number"])
def test_sums_of_replicates(spark, which):
    df = odd(spark)
    df = {"odd": df, "all null": df.withColumn("x", F.lit(None).cast("double")), "two rows": df.filter("id IN ('22', 'm')"), "not a number": df.withColumn("x", F.when(F.col("id") == "995", float("nan")).otherwise(F.col("x")))}[which]
    sums = {"k": F.lit(1), "a": F.col("x"), "b": F.col("x") * F.col("x")}
    got, want = ({r.rep: (r.drawn, r.k, r.a, r.b) for r in t.collect()} for t in (B.replicate_sums(df, "id", sums, 40, "s"), by_rows(df, sums, 40)))
    assert sorted(got) == sorted(want) and all(got[r] == pytest.approx(want[r], nan_ok=True) for r in got)


def test_no_row_for_each_replicate(spark):
    plan = B.replicate_sums(odd(spark), "id", {"k": F.lit(1)}, 200, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_deviation_of_replicates(spark):
    df = odd(spark).filter("x IS NOT NULL AND id IS NOT NULL")
    rows = df.collect()
    values, ids = np.array([r.x for r in rows]), [r.id for r in rows]
    sd, _, drawn = B.bootstrap_sd(df, "id", "x", 12, "s")
    e = np.array(poisson_edges())
    want = [np.repeat(values, [int((bits(f"s:{i}:{rep}") / 2**52 >= e).sum()) for i in ids]).std(ddof=1) for rep in range(1, 13)]
    assert sd == pytest.approx(values.std(ddof=1)) and sorted(drawn) == pytest.approx(sorted(want))


def test_means_without_a_row_for_each_replicate(spark):
    df = odd(spark)
    means = {"all": (F.col("x"), F.lit(1)), "own": (F.when(F.col("id") == "22", F.col("x")).otherwise(0.0), (F.col("id") == "22").cast("int"))}
    t = B.bootstrap_means(df, "id", means, 40, "s")
    assert "Generate" not in t._jdf.queryExecution().optimizedPlan().toString()
    want = by_rows(df, {"x": F.col("x"), "k": F.lit(1)}, 40).select("rep", F.col("x") / F.col("k")).collect()
    got = {r.rep: r for r in t.collect()}
    assert all(got[rep]["all"] == pytest.approx(m) for rep, m in want) and len(got) == len(want)
    assert {r.own for r in got.values()} == {None, KEYS.index("22") % 7 + 0.25}  # a replicate that draws no row of a group has no mean of it


@pytest.mark.parametrize("kind", ["real", "ties", "one value"])
def test_quantiles_of_replicates(spark, kind):
    rng = np.random.default_rng(4)
    x = {"real": rng.lognormal(2, 1, 900), "ties": rng.integers(0, 6, 900).astype(float), "one value": np.full(900, 3.0)}[kind]
    rows = [(f"g{i % 3}" if i < 890 else "few", i // 4, None if i % 50 == 7 else float(v), i % 7 + 1) for i, v in enumerate(x)]
    rows += [(None, 3, 1.0, 1), ("g1", None, 1.0, 1), *[("nulls", i, None, 2) for i in range(3)]]
    df = spark.createDataFrame(rows, "g string, u long, x double, w long").repartition(3)
    got = {(r.rep, r.g): tuple(r)[2:] for r in B.replicate_quantiles(df, "g", "u", "x", "w", [0.5, 0.9], {"y": F.col("x")}, 15, "s").collect()}
    e, want = np.array(poisson_edges()), {}
    for rep in range(1, 16):
        for g in ("g0", "g1", "g2", "few", "nulls"):
            own = [(v, w * int((bits(f"s:{g}:{u}:{rep}") / 2**52 >= e).sum())) for h, u, v, w in rows if h == g and u is not None]
            own = sorted(((v, k) for v, k in own if k), key=lambda q: (q[0] is None, q[0]))
            if own:
                upto = np.cumsum([k for _, k in own])
                first = lambda p: own[int(np.argmax(upto >= p * upto[-1]))][0]  # noqa: E731, B023
                want[rep, g] = (upto[-1], sum(v * k for v, k in own if v is not None), first(0.5), first(0.9))
    assert sorted(got) == sorted(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got), [(k, got[k], want[k]) for k in got if got[k] != pytest.approx(want[k])][:3]


def test_index_keeps_nulls_last(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, i % 3 AS c_nationkey, 'x' AS c_mktsegment FROM range(60) t(i)")
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, i * 7 % 60 AS o_custkey, ['F', 'O'][i % 2 + 1] AS o_orderstatus, CASE WHEN i % 9 = 0 THEN NULL ELSE CAST(i * 37 % 101 AS DOUBLE) END AS o_totalprice, 'a' AS o_orderpriority, DATE '1996-01-01' AS o_orderdate FROM range(400) t(i)")
    for t in ("customer", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    df = entry.queries()["rank_uncertainty_index"](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()["rank_uncertainty_index"]).fetchall()
    got = sorted(map(tuple, df.collect()))
    assert len(got) == 3 and all(a == pytest.approx(b) for a, b in zip(got, sorted(want), strict=True))


def test_shuffles_without_a_row_for_each_replicate(spark, monkeypatch):
    made = []
    inner = B._hashed_near
    monkeypatch.setattr(B, "_hashed_near", lambda *a: made.append(inner(*a)) or made[-1])
    n, size = 30_000, 10_000
    df = spark.range(n).select("id", (F.col("id") * 7919 % 10007).cast("double").alias("x"), (F.col("id") % 3 == 0).alias("first"))
    got = {r.rep: r.s for r in B.permuted_sums(df, "id", "x", F.col("first"), 4, "p").collect()}
    x = np.array([float(i * 7919 % 10007) for i in range(n)])
    for rep in (1, 4):
        order = sorted(range(n), key=lambda i: (bits(f"p:{i}:{rep}"), i))
        assert got[rep] == x[order[:size]].sum()
    assert len(made) == 1 and made[0].count() < 4 * 20 * n**0.5  # of 120,000 rows and replicates


@pytest.mark.parametrize("copies", [1, 400])
def test_shuffles_of_rows_that_share_ids(spark, copies):
    """Rows of one id stand or fall together, so that a group's last row may lie anywhere."""
    df = spark.range(5 * copies).select((F.col("id") % 5).alias("id"), (F.col("id") % 5).cast("double").alias("x"), (F.col("id") < 2 * copies).alias("first"))
    got = {r.rep: r.s for r in B.permuted_sums(df, "id", "x", F.col("first"), 20, "p").collect()}
    for rep in range(1, 21):
        order = sorted(range(5), key=lambda i: bits(f"p:{i}:{rep}"))
        assert got[rep] == copies * sum(order[:2])
    none = df.withColumn("x", F.when(F.col("x") != 3, F.col("x")))
    got = {r.rep: r.s for r in B.permuted_sums(none, "id", "x", F.col("first"), 20, "p").collect()}
    assert all(got[rep] == copies * sum(i for i in sorted(range(5), key=lambda i: bits(f"p:{i}:{rep}"))[:2] if i != 3) for rep in got) and len(got) == 20
