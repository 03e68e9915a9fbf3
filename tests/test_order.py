import random

import numpy as np
from pyspark.sql import functions as F

from tallyworks.operators import describe as D
from tallyworks.operators import order as O


def frame(spark):
    rows = [(g, float(v), w) for g in ("a", "b", None) for v, w in [(1, 2), (1, 5), (2, 1), (2, 1), (5, 3), (9, 4), (9, 1), (9, 1)]]
    return spark.createDataFrame([*rows, ("a", None, 3)], "g string, x double, w int")


def test_prefix_sums_by_group_and_over_partitions(spark):
    for parts in (1, 3, 7):
        got = {(r.g, r.x): (r.w, r.w_before, r.w_all) for r in O.prefix_sums(frame(spark), ["g"], "x", {"w": F.col("w")}, parts).collect()}
        assert len(got) == 12
        for g in ("a", "b", None):
            assert [got[g, x] for x in (1.0, 2.0, 5.0, 9.0)] == [(7, 0, 18), (2, 7, 18), (3, 9, 18), (6, 12, 18)]


def test_no_task_gets_all_rows(spark):
    plan = O.prefix_sums(frame(spark), [], "x", {"w": F.col("w")})._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan


def _midpoint(rows, p):
    rows = sorted(rows)
    total = sum(w for _, w in rows)
    at, run = [], 0
    for x, w in rows:
        at.append(((run + w / 2) / total, x))
        run += w
    if p <= at[0][0]:
        return at[0][1]
    for (a, x), (b, y) in zip(at, at[1:]):
        if a <= p <= b:
            return x + (y - x) * (p - a) / (b - a)
    return at[-1][1]


def test_midpoint_quantiles_with_ties(spark):
    one = [(r.x, r.w) for r in frame(spark).filter("g = 'b'").collect()]
    ps = [0.01, 0.1, 0.2, 0.3, 0.45, 0.5, 0.6, 0.75, 0.9, 0.99]
    got = {r.p: r.q for r in O.quantiles_midpoint(frame(spark).filter("g = 'b'"), "x", "w", ps).collect()}
    assert all(abs(got[p] - _midpoint(one, p)) < 1e-12 for p in ps)


def test_gini_of_equal_and_unequal(spark):
    same = spark.createDataFrame([(5.0, 1)] * 10, "x double, w int")
    assert abs(O.gini(same, "x", "w").first()[0]) < 1e-12
    one = spark.createDataFrame([(0.0, 9), (10.0, 1)], "x double, w int")
    assert abs(O.gini(one, "x", "w").first()[0] - 0.9) < 1e-12


def test_index_rows(spark):
    d = spark.range(0, 1000, numPartitions=5).withColumn("k", (F.col("id") * 7919) % 1000)
    assert all(r.row_index == r.k + 1 for r in O.index_rows(d, ["k"]).collect())


def exchanges(df):
    """Of rows: those of the final plan that the join of the few totals does not need."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line and "Reused" not in line]


def test_one_exchange_beyond_the_aggregate(spark):
    d = frame(spark).repartition(3).withColumn("x", F.col("x") + F.rand(1))
    for q in (O.gini(d, "x", "w", ["g"]), O.quantiles_midpoint(d, "x", "w", [0.1, 0.5]), O.prefix_sums(d, [], "x", {"w": F.col("w")})):
        lines = exchanges(q)
        assert any("rangepartitioning" in x for x in lines) and not any("hashpartitioning(_p" in x for x in lines), lines


def test_lags_take_one_exchange(spark):
    d = spark.range(0, 1000, numPartitions=5).withColumn("v", F.rand(2))
    assert sum("rangepartitioning" in x for x in exchanges(O.lagged(d, ["id"], "v", [1, 2]))) == 1


def test_lags_over_ranges(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([0, 0, 0, rnd.randint(-50, 50)]), i, float(rnd.randint(0, 9)) if i % 5 else None) for i in range(300)]
    d = spark.createDataFrame(rows, "k int, id int, v double").repartition(4)
    want = sorted(rows)
    for r in O.lagged(d, ["k", "id"], "v", [1, 3, 40]).collect():
        at = want.index((r.k, r.id, r.v))
        assert [r.v_1, r.v_3, r.v_40] == [want[at - n][2] if at >= n else None for n in (1, 3, 40)]
    few = spark.createDataFrame([(i, i, float(i)) for i in range(5)], "k int, id int, v double")
    assert sorted((r.k, r.v_2) for r in O.lagged(few, ["k"], "v", [2]).collect()) == [(0, None), (1, None), (2, 0.0), (3, 1.0), (4, 2.0)]
    assert O.lagged(few.limit(0), ["k"], "v", [1]).count() == 0


def test_held_tables_are_let_go(spark):
    rows = spark.range(100).withColumn("x", (F.col("id") % 7).cast("double"))
    sums = [O.prefix_sums(rows.withColumn("x", F.col("x") + k), [], "x", {"n": F.lit(1)}) for k in range(O.HELD + 3)]
    assert len(O._held) == O.HELD
    assert all(s.agg(F.sum("n")).first()[0] == 100 and s.agg(F.max("n_before")).first()[0] == 86 for s in sums)  # also those let go


def test_ranges_hold_a_hot_value_and_nan(spark):
    rows = [(1.0, 1)] * 500 + [(float("nan"), 1), (float("inf"), 1), (-float("inf"), 1)] + [(float(i), 1) for i in range(50)]
    got = {str(r.x): (r.n_before, r.n) for r in O.prefix_sums(spark.createDataFrame(rows, "x double, n int"), [], "x", {"n": F.col("n")}, 6).collect()}
    assert got["-inf"] == (0, 1) and got["1.0"] == (2, 501) and got["inf"] == (551, 1) and got["nan"] == (552, 1) and got["49.0"] == (550, 1)


def test_quantiles_of_groups(spark):
    rnd = random.Random(5)
    rows = [(g, float(rnd.choice([rnd.randint(0, 9), rnd.gauss(0, 50)]))) for g in ["hot"] * 400 + ["b"] * 7 + [None] * 4 + ["one"]] + [("empty", None), ("hot", None)]
    d = spark.createDataFrame(rows, "g string, x double")
    own = lambda g: [x for k, x in rows if k == g and x is not None]
    got = {r.g: r for r in O.quantiles(d, "x", {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}, ["g"]).collect()}
    assert got.keys() == {"hot", "b", None, "one"}
    for g, r in got.items():
        assert np.allclose([r.a, r.b, r.c, r.d], np.quantile(own(g), [0, 0.3, 0.5, 1]), rtol=1e-12)
    assert O.quantiles(d.filter("g = 'empty'"), "x", {"m": 0.5}).collect() == [(None,)]
    box = {r.g: r for r in D.box_summary(d, "x", "g").collect()}
    assert box["empty"].median is None and box["empty"].outliers == 0 and box[None].q1 == np.quantile(own(None), 0.25)
    about = {r.g: r for r in D.describe_numeric(d, "x", ["g"]).collect()}
    assert (about["empty"].n, about["empty"].median, about["hot"].missing) == (0, None, 1) and about["hot"].q3 == np.quantile(own("hot"), 0.75)
    for r in D.quantile_conventions(d, "x", "g", [0.1, 0.5, 0.9]).collect():
        v = own(r.g)
        want = [np.quantile(v, r.p, method=m) for m in ("linear", "weibull", "averaged_inverted_cdf")]
        assert np.allclose([r.type7, r.type6, r.type2], want, rtol=1e-9), (r, want)


def test_quantiles_hold_no_group_in_one_task(spark):
    plan = O.quantiles(frame(spark), "x", {"m": 0.5}, ["g"])._jdf.queryExecution().toString()
    assert "rangepartitioning(g" in plan and "percentile" not in plan
