"""Projections, recodes, cleaning, joins, set operations, top-k: over orders, customers and lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean as C
from ..operators import order as O
from .registry import DIRTY, PERSONS, dirty, persons, query, r, table

SPECS = [C.VarSpec("amount", "number", 0, 8000), C.VarSpec("kind", "category", codes=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")), C.VarSpec("day", "date"), C.VarSpec("age", "integer", 0, 110)]
NUM = "TRY_CAST(replace(replace(amount, '.', ''), ',', '.') AS DOUBLE)"
AMOUNT = f"CASE WHEN amount <> 'NA' AND regexp_matches(replace(replace(amount, '.', ''), ',', '.'), '^[+-]?[0-9]+([.][0-9]+)?$') THEN {NUM} END"
DAY = "CASE WHEN day LIKE '%/%' THEN CAST(try_strptime(day, '%d/%m/%Y') AS DATE) ELSE CAST(try_strptime(day, '%Y-%m-%d') AS DATE) END"


@query("filter_universe", f"WITH {PERSONS} SELECT id, w, x FROM persons WHERE status = 'F' AND p21 > 0 AND w > 1")
def _(spark, d):
    return persons(spark, d).filter("status = 'F' AND p21 > 0 AND w > 1").select("id", "w", "x")


@query("filter_in_list", f"WITH {PERSONS} SELECT count(*) FILTER (stratum IN (1, 3, 5)) AS kept, count(*) FILTER (stratum NOT IN (1, 3, 5)) AS dropped FROM persons")
def _(spark, d):
    return persons(spark, d).agg(F.count_if(F.col("stratum").isin(1, 3, 5)).alias("kept"), F.count_if(~F.col("stratum").isin(1, 3, 5)).alias("dropped"))


@query("recode_binary", f"WITH {PERSONS} SELECT id, CAST(status IN ('F', 'O') AS INTEGER) AS active FROM persons")
def _(spark, d):
    return persons(spark, d).select("id", F.col("status").isin("F", "O").cast("int").alias("active"))


@query("label_codes", f"WITH {PERSONS} SELECT id, CASE CASE WHEN id % 13 = 0 THEN NULL ELSE stratum END WHEN 0 THEN 'Norte' WHEN 1 THEN 'Sur' WHEN 2 THEN 'Este' ELSE coalesce('Código ' || CASE WHEN id % 13 = 0 THEN NULL ELSE stratum END, 'Sin dato') END AS label FROM persons")
def _(spark, d):
    code = F.when(F.col("id") % 13 != 0, F.col("stratum"))
    return persons(spark, d).select("id", S.label_codes(code, {0: "Norte", 1: "Sur", 2: "Este"}).alias("label"))


BANDS = [(0, 14, "0-14"), (15, 29, "15-29"), (30, 64, "30-64"), (65, None, "65+")]


@query("band_ages", f"WITH {PERSONS} SELECT CASE WHEN greatest(age, 0) <= 14 THEN '0-14' WHEN age <= 29 THEN '15-29' WHEN age <= 64 THEN '30-64' ELSE '65+' END AS band, count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM persons GROUP BY 1")
def _(spark, d):
    return persons(spark, d).groupBy(S.band(F.greatest("age", F.lit(0)), BANDS).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


@query("band_deaths_groups", "SELECT CASE p_type WHEN 'ECONOMY' THEN 'A' WHEN 'STANDARD' THEN 'A' WHEN 'PROMO' THEN 'B' ELSE 'unmapped' END AS grp, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    m = F.create_map(F.lit("ECONOMY"), F.lit("A"), F.lit("STANDARD"), F.lit("A"), F.lit("PROMO"), F.lit("B"))
    return table(spark, d, "part").groupBy(F.coalesce(m[F.col("p_type")], F.lit("unmapped")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("derived_hourly_income", f"WITH {PERSONS} SELECT id, round(x / ((id % 40 + 1) * 4.33::DOUBLE), 6) AS hourly, round(CASE WHEN p21 > 0 THEN ln(p21) END, 6) AS log_income FROM persons")
def _(spark, d):
    return persons(spark, d).select("id", r(F.col("x") / ((F.col("id") % 40 + 1) * F.lit(4.33)), 6).alias("hourly"), r(S.log_safe("p21"), 6).alias("log_income"))


@query("clean_numeric", f"WITH {DIRTY}, t AS (SELECT line_no, amount, {AMOUNT} AS v FROM dirty) SELECT line_no, CASE WHEN v BETWEEN 0 AND 8000 THEN v END AS value, CASE WHEN amount = 'NA' THEN 'missing' WHEN v IS NULL THEN 'not a number' WHEN v > 8000 THEN 'out of range' END AS rule FROM t")
def _(spark, d):
    return dirty(spark, d).select("line_no", C.clean_numeric(SPECS[0]).alias("c")).select("line_no", "c.value", "c.rule")


@query("clean_category", f"WITH {DIRTY} SELECT line_no, CASE WHEN trim(kind) = '' THEN NULL ELSE upper(trim(kind)) END AS value, CASE WHEN trim(kind) = '' THEN 'missing' END AS rule FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("line_no", C.clean_category(SPECS[1]).alias("c")).select("line_no", "c.value", "c.rule")


@query("clean_date", f"WITH {DIRTY} SELECT line_no, {DAY} AS value, CASE WHEN {DAY} IS NULL THEN 'impossible date' END AS rule FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("line_no", C.clean_date(SPECS[2]).alias("c")).select("line_no", "c.value", "c.rule")


@query("clean_table", f"""WITH {DIRTY}, t AS (SELECT line_no, id, {AMOUNT} AS a, CASE WHEN trim(kind) = '' THEN NULL ELSE upper(trim(kind)) END AS kind, {DAY} AS day, CAST(age AS DOUBLE) AS g, row_number() OVER (PARTITION BY id ORDER BY line_no) AS n FROM dirty)
SELECT line_no, id, CASE WHEN a <= 8000 THEN a END AS amount, kind, day, CASE WHEN g BETWEEN 0 AND 110 THEN g END AS age FROM t WHERE n = 1""")
def _(spark, d):
    return C.clean_table(dirty(spark, d), SPECS, "id", "line_no")


@query("cleaning_change_log", f"""WITH {DIRTY}, t AS (SELECT amount, {AMOUNT} AS v, kind, {DAY} AS day, CAST(age AS INTEGER) AS g FROM dirty), u AS (
SELECT 'amount' AS variable, CASE WHEN amount = 'NA' THEN 'missing' WHEN v IS NULL THEN 'not a number' WHEN v > 8000 THEN 'out of range' END AS rule FROM t UNION ALL SELECT 'kind', CASE WHEN trim(kind) = '' THEN 'missing' END FROM t
UNION ALL SELECT 'day', CASE WHEN day IS NULL THEN 'impossible date' END FROM t UNION ALL SELECT 'age', CASE WHEN g NOT BETWEEN 0 AND 110 THEN 'out of range' END FROM t) SELECT variable, rule, count(*) AS n FROM u WHERE rule IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return C.change_log(dirty(spark, d), SPECS)


@query("limits_filter", f"WITH {DIRTY}, t AS (SELECT CASE WHEN TRY_CAST(age AS INTEGER) BETWEEN 0 AND 90 THEN TRY_CAST(age AS INTEGER) END AS v FROM dirty) SELECT count(*) AS n, count(v) AS kept, count(*) - count(v) AS lost, CAST(sum(v) AS BIGINT) AS total FROM t")
def _(spark, d):
    v = F.col("age").try_cast("int")
    return dirty(spark, d).select(F.when(v.between(0, 90), v).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("kept"), F.count_if(F.col("v").isNull()).alias("lost"), F.sum("v").alias("total"))


@query("normalize_group_label", f"WITH {DIRTY}, t AS (SELECT line_no, trim(regexp_replace(kind, '\\s+', ' ', 'g')) AS k FROM dirty) SELECT line_no, upper(substr(k, 1, 1)) || lower(substr(k, 2)) AS label FROM t")
def _(spark, d):
    return dirty(spark, d).select("line_no", S.normalize_group_label("kind").alias("label"))


@query("dedupe_first", f"WITH {DIRTY} SELECT id, min(line_no) AS line_no FROM dirty GROUP BY id")
def _(spark, d):
    return C.dedupe_first(dirty(spark, d), "id", "line_no").select("id", "line_no")


COLS = ["amount", "kind", "day", "age", "fixed"]
CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, CASE WHEN upper(trim({c})) IN ('', 'NA') THEN NULL ELSE trim({c}) END AS v, line_no AS o FROM dirty" for c in COLS) + ")"
PROFILE = f"""WITH {DIRTY}, {CELLS}, profile AS (SELECT name, count(*) AS n, count(*) - count(v) AS missing, count(DISTINCT v) AS distinct_values, count(DISTINCT lower(v)) AS distinct_folded,
coalesce(bool_and(regexp_matches(v, '^[+-]?[0-9.,]+$')), false) AS all_numeric, arg_min(v, CASE WHEN v IS NOT NULL THEN o END) AS example FROM cells GROUP BY name)"""


@query("profile_columns", f"{PROFILE} SELECT * FROM profile")
def _(spark, d):
    return C.profile_columns(dirty(spark, d), COLS, "line_no").withColumn("missing", F.col("missing").cast("long"))


@query("profile_suspicions", f"""{PROFILE} SELECT name, suspicion FROM (SELECT name, unnest([CASE WHEN name NOT IN ('amount', 'kind', 'day', 'age') THEN 'undeclared' END, CASE WHEN missing = n THEN 'empty' END, CASE WHEN missing < n AND 2 * missing > n THEN 'more than half empty' END,
CASE WHEN distinct_values = 1 THEN 'constant' END, CASE WHEN all_numeric THEN 'numbers as text' END, CASE WHEN distinct_values > distinct_folded THEN 'case variants' END]) AS suspicion FROM profile) WHERE suspicion IS NOT NULL""")
def _(spark, d):
    return C.suspicions(C.profile_columns(dirty(spark, d), COLS, "line_no"), ["amount", "kind", "day", "age"])


@query("complete_cases", f"WITH {PERSONS}, t AS (SELECT CASE WHEN p21 >= 0 THEN p21 END AS a, CASE WHEN age >= 0 THEN age END AS b FROM persons) SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS kept, count(*) FILTER (a IS NULL OR b IS NULL) AS dropped FROM t")
def _(spark, d):
    t = persons(spark, d).select(F.when(F.col("p21") >= 0, F.col("p21")).alias("a"), F.when(F.col("age") >= 0, F.col("age")).alias("b"))
    return t.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("dropped"))


@query("sentinel_audit", f"WITH {PERSONS} SELECT status, count(*) AS n, count(*) FILTER (p21 = 0) AS zeros, count(*) FILTER (p21 = -9) AS not_answered, count(*) FILTER (p21 > 0) AS positive, bool_and(p21 >= 0 OR p21 = -9) AS only_known_negatives, round(avg(p21), 4) AS mean_raw, round(avg(p21) FILTER (p21 >= 0), 4) AS mean_no_sentinel, round(avg(p21) FILTER (p21 > 0), 4) AS mean_positive FROM persons GROUP BY status")
def _(spark, d):
    v = F.col("p21")
    return persons(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(v == 0).alias("zeros"), F.count_if(v == -9).alias("not_answered"), F.count_if(v > 0).alias("positive"), F.bool_and((v >= 0) | (v == -9)).alias("only_known_negatives"), r(F.avg(v)).alias("mean_raw"), r(F.avg(F.when(v >= 0, v))).alias("mean_no_sentinel"), r(F.avg(F.when(v > 0, v))).alias("mean_positive"))


@query("codebook_check", f"WITH {PERSONS}, u AS (SELECT 'status' AS name, status AS v FROM persons UNION ALL SELECT 'grp', grp FROM persons UNION ALL SELECT 'stratum', CAST(stratum AS VARCHAR) FROM persons) SELECT name, count(DISTINCT v) AS distinct_values, bool_and(regexp_matches(v, '^-?[0-9]+$')) AS all_integer, array_to_string(list_sort(list_distinct(list(v) FILTER (v NOT IN ('F', 'O', '1-URGENT', '2-HIGH', '0', '1')))), ',') AS undeclared FROM u GROUP BY name")
def _(spark, d):
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in ("status", "grp", "stratum")]))
    declared = F.array(*map(F.lit, ("F", "O", "1-URGENT", "2-HIGH", "0", "1")))
    g = persons(spark, d).select(cell.alias("c")).select("c.*").groupBy("name").agg(F.count_distinct("v").alias("distinct_values"), F.bool_and(F.col("v").rlike("^-?[0-9]+$")).alias("all_integer"), F.collect_set("v").alias("s"))
    return g.select("name", "distinct_values", "all_integer", F.array_join(F.array_sort(F.array_except("s", declared)), ",").alias("undeclared"))


@query("file_checks", f"""WITH {PERSONS} SELECT 'several periods' AS check_name, count(DISTINCT year(day)) AS n FROM persons UNION ALL SELECT 'weight not positive', count(*) FILTER (w <= 0) FROM persons UNION ALL SELECT 'unknown status', count(*) FILTER (status NOT IN ('F', 'O')) FROM persons
UNION ALL SELECT 'negative age', count(*) FILTER (age < 0) FROM persons UNION ALL SELECT 'not answered', count(*) FILTER (p21 = -9) FROM persons""")
def _(spark, d):
    a = persons(spark, d).agg(F.count_distinct(F.year("day")).alias("several periods"), F.count_if(F.col("w") <= 0).alias("weight not positive"), F.count_if(~F.col("status").isin("F", "O")).alias("unknown status"), F.count_if(F.col("age") < 0).alias("negative age"), F.count_if(F.col("p21") == -9).alias("not answered"))
    return a.unpivot([], a.columns, "check_name", "n")


# joins

@query("join_counts_population", "WITH k AS (SELECT c_nationkey, count(*) AS cases FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT c_nationkey, count(*) AS population FROM customer WHERE c_nationkey <> 3 GROUP BY 1) SELECT n_name, cases, population, round(1000.0::DOUBLE * cases / population, 6) AS rate FROM k JOIN p USING (c_nationkey) JOIN nation ON n_nationkey = c_nationkey")
def _(spark, d):
    k = persons(spark, d).filter("status = 'F'").groupBy("stratum").agg(F.count(F.lit(1)).alias("cases"))
    p = table(spark, d, "customer").filter("c_nationkey <> 3").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("population"))
    n = table(spark, d, "nation")
    return k.join(p, F.col("stratum") == F.col("c_nationkey")).join(n, F.col("n_nationkey") == F.col("stratum")).select("n_name", "cases", "population", r(1000.0 * F.col("cases") / F.col("population"), 6).alias("rate"))


@query("join_cases_exposed", "WITH g AS (SELECT n_nationkey, s FROM nation, (SELECT DISTINCT p_size AS s FROM part)), k AS (SELECT s_nationkey, p_size, count(*) AS exposed, count(*) FILTER (l_returnflag = 'R') AS cases FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT n_nationkey, s AS size, coalesce(cases, 0) AS cases, coalesce(exposed, 0) AS exposed FROM g LEFT JOIN k ON n_nationkey = s_nationkey AND s = p_size")
def _(spark, d):
    part = table(spark, d, "part")
    grid = table(spark, d, "nation").select("n_nationkey").crossJoin(part.select(F.col("p_size").alias("size")).distinct())  # two key lists
    k = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("s_nationkey", "p_size").agg(F.count(F.lit(1)).alias("e"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    return grid.join(k, (F.col("n_nationkey") == F.col("s_nationkey")) & (F.col("size") == F.col("p_size")), "left").select("n_nationkey", "size", F.coalesce("c", F.lit(0)).alias("cases"), F.coalesce("e", F.lit(0)).alias("exposed"))


@query("join_names", "SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def _(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey <> 2")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.col("s_nationkey").cast("string")).alias("name"))


@query("semi_top_groups", f"WITH {PERSONS}, t AS (SELECT stratum FROM persons GROUP BY 1 ORDER BY sum(w) DESC, stratum LIMIT 12) SELECT id FROM persons SEMI JOIN t USING (stratum)")
def _(spark, d):
    p = persons(spark, d)
    top = p.groupBy("stratum").agg(F.sum("w").alias("s")).orderBy(F.desc("s"), "stratum").limit(12).select("stratum")
    return p.join(top, "stratum", "left_semi").select("id")


@query("anti_missing_periods", "WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders WHERE month(o_orderdate) <> 7), e AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM m) SELECT CAST(e.m AS DATE) AS missing_month FROM e ANTI JOIN m ON e.m = m.m")
def _(spark, d):
    m = table(spark, d, "orders").filter(F.month("o_orderdate") != 7).select(F.trunc("o_orderdate", "month").alias("m")).distinct()
    every = m.agg(F.min("m").alias("a"), F.max("m").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("missing_month"))
    return every.join(m, F.col("missing_month") == F.col("m"), "left_anti")


@query("group_stat_back_join", f"WITH {PERSONS}, m AS (SELECT grp, quantile_cont(x, 0.5) AS med FROM persons GROUP BY 1) SELECT id, round(abs(x - med), 6) AS deviation FROM persons JOIN m USING (grp)")
def _(spark, d):
    p = persons(spark, d)
    m = O.quantiles(p, "x", {"med": 0.5}, ["grp"]).withColumnRenamed("grp", "g")
    return p.join(m, F.col("grp") == F.col("g")).select("id", r(F.abs(F.col("x") - F.col("med")), 6).alias("deviation"))


@query("pairs_self_join", f"WITH {PERSONS}, g AS (SELECT grp, avg(x) AS m FROM persons GROUP BY 1) SELECT a.grp AS a, b.grp AS b, round(a.m - b.m, 4) AS difference FROM g a JOIN g b ON a.grp < b.grp")
def _(spark, d):
    g = persons(spark, d).groupBy("grp").agg(F.avg("x").alias("m"))
    a, b = g.select(F.col("grp").alias("a"), F.col("m").alias("ma")), g.select(F.col("grp").alias("b"), F.col("m").alias("mb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", r(F.col("ma") - F.col("mb")).alias("difference"))


@query("pairs_requested", f"WITH {PERSONS}, g AS (SELECT grp, avg(x) AS m FROM persons GROUP BY 1), q(a, b) AS (VALUES ('1-URGENT', '5-LOW'), ('2-HIGH', '3-MEDIUM')) SELECT q.a, q.b, round(x.m / y.m, 6) AS ratio FROM q JOIN g x ON q.a = x.grp JOIN g y ON q.b = y.grp")
def _(spark, d):
    g = persons(spark, d).groupBy("grp").agg(F.avg("x").alias("m"))
    q = spark.createDataFrame([("1-URGENT", "5-LOW"), ("2-HIGH", "3-MEDIUM")], "a string, b string")
    x, y = g.select(F.col("grp").alias("ga"), F.col("m").alias("ma")), g.select(F.col("grp").alias("gb"), F.col("m").alias("mb"))
    return x.join(F.broadcast(q), F.col("ga") == F.col("a")).join(y, F.col("gb") == F.col("b")).select("a", "b", r(F.col("ma") / F.col("mb"), 6).alias("ratio"))


@query("lookup_published_interval", f"WITH {PERSONS}, g AS (SELECT grp, avg(x) - 1.96::DOUBLE * stddev_samp(x) / sqrt(count(*)) AS lo, avg(x) + 1.96::DOUBLE * stddev_samp(x) / sqrt(count(*)) AS hi FROM persons GROUP BY 1) SELECT a.grp AS a, b.grp AS b, round(a.lo, 4) AS a_low, round(a.hi, 4) AS a_high, round(b.lo, 4) AS b_low, round(b.hi, 4) AS b_high, a.lo <= b.hi AND b.lo <= a.hi AS overlap FROM g a JOIN g b ON a.grp < b.grp")
def _(spark, d):
    half = 1.96 * F.stddev_samp("x") / F.sqrt(F.count("x"))
    g = persons(spark, d).groupBy("grp").agg((F.avg("x") - half).alias("lo"), (F.avg("x") + half).alias("hi"))
    a, b = (g.select(F.col("grp").alias(k), F.col("lo").alias(k + "_low"), F.col("hi").alias(k + "_high")) for k in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", *[r(c).alias(c) for c in ("a_low", "a_high", "b_low", "b_high")], ((F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))).alias("overlap"))


# order, sets

@query("top_groups_by_weight", f"WITH {PERSONS} SELECT stratum, CAST(sum(w) AS BIGINT) AS w FROM persons GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def _(spark, d):
    return persons(spark, d).groupBy("stratum").agg(F.sum("w").alias("w")).orderBy(F.desc("w"), "stratum").limit(12)


@query("top_k_per_metric", f"WITH {PERSONS}, t AS (SELECT seg, stratum, avg(x) AS m FROM persons GROUP BY ALL) SELECT seg, stratum, round(m, 4) AS mean, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY m DESC, stratum) AS n FROM t) WHERE n <= 3")
def _(spark, d):
    t = persons(spark, d).groupBy("seg", "stratum").agg(F.avg("x").alias("m"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("seg").orderBy(F.desc("m"), "stratum"))).filter("place <= 3").select("seg", "stratum", r("m").alias("mean"), "place")


@query("argmax_row", f"WITH {PERSONS} SELECT grp, arg_max(id, {{'x': x, 'i': id}}) AS id, round(max(x), 4) AS x FROM persons GROUP BY grp")
def _(spark, d):
    return persons(spark, d).groupBy("grp").agg(F.max_by("id", F.struct("x", "id")).alias("id"), r(F.max("x")).alias("x"))


@query("fixed_order_output", f"WITH {PERSONS}, o(status, k) AS (VALUES ('P', 1), ('O', 2), ('F', 3)) SELECT k, status, count(*) AS n FROM persons JOIN o USING (status) GROUP BY ALL")
def _(spark, d):
    o = spark.createDataFrame([("P", 1), ("O", 2), ("F", 3)], "status string, k int")
    return persons(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(o, "status").select("k", "status", "n").orderBy("k")


@query("union_total_and_parts", f"WITH {PERSONS} SELECT coalesce(grp, 'Total') AS grp, count(*) AS n, round(avg(x), 4) AS mean FROM persons GROUP BY GROUPING SETS ((grp), ())")
def _(spark, d):
    return persons(spark, d).rollup("grp").agg(F.count(F.lit(1)).alias("n"), r(F.avg("x")).alias("mean")).withColumn("grp", F.coalesce("grp", F.lit("Total")))


@query("except_declared", "SELECT DISTINCT p_type AS undeclared FROM part WHERE p_type NOT IN ('PROMO', 'ECONOMY')")
def _(spark, d):
    declared = spark.createDataFrame([("PROMO",), ("ECONOMY",)], "undeclared string")
    return table(spark, d, "part").select(F.col("p_type").alias("undeclared")).distinct().join(declared, "undeclared", "left_anti")


@query("same_set_check", f"WITH {PERSONS}, a AS (SELECT DISTINCT status FROM persons) SELECT stratum, count(DISTINCT status) = (SELECT count(*) FROM a) AS same FROM persons GROUP BY stratum")
def _(spark, d):
    p = persons(spark, d)
    every = p.agg(F.collect_set("status").alias("every"))
    return p.groupBy("stratum").agg(F.collect_set("status").alias("s")).crossJoin(every).select("stratum", ((F.size(F.array_except("every", "s")) == 0) & (F.size(F.array_except("s", "every")) == 0)).alias("same"))


# scalars

@query("scalar_text", f"WITH {DIRTY} SELECT line_no, trim(regexp_replace(kind, '\\s+', ' ', 'g')) AS text, CASE WHEN trim(kind) = '' THEN NULL ELSE regexp_replace(lower(kind), '[^a-z0-9]', '', 'g') END AS folded, CASE WHEN amount IN ('NA') THEN NULL ELSE amount END AS na FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("line_no", S.clean_text("kind").alias("text"), F.when(F.trim("kind") != "", S.fold_key("kind")).alias("folded"), S.parse_na("amount").alias("na"))


@query("parse_number", f"WITH {DIRTY} SELECT line_no, CASE WHEN regexp_matches(replace(replace(amount, '.', ''), ',', '.'), '^[+-]?[0-9]+([.][0-9]+)?$') THEN {NUM} END AS value, amount NOT IN ('NA', '1.2.3x') AS converted FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("line_no", S.parse_number("amount").alias("p")).select("line_no", "p.value", "p.converted")


@query("parse_na_number", f"WITH {DIRTY} SELECT line_no, TRY_CAST(CASE WHEN amount <> 'NA' THEN replace(amount, ',', '') END AS DOUBLE) AS number, coalesce(CAST(CASE WHEN age <> '.' THEN age END AS INTEGER), -1) AS whole FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("line_no", S.parse_na_number(F.replace("amount", F.lit(","), F.lit(""))).alias("number"), S.parse_int("age", -1).alias("whole"))


@query("split_codes", "SELECT p_partkey, len(list_filter(string_split(p_name || '; ;x', ';'), lambda v: trim(v) <> '')) AS n FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(S.split_codes(F.concat("p_name", F.lit("; ;x")))).cast("long").alias("n"))


@query("split_pairs", "SELECT p_partkey, p_brand AS a, p_type AS b FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(S.split_pairs(F.concat("p_brand", F.lit(" | "), "p_type", F.lit("; odd")))).alias("p")).select("p_partkey", "p.a", "p.b")


@query("round_significant", "SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_extendedprice = 0 THEN 0 ELSE sign(l_extendedprice) * floor(abs(l_extendedprice) * pow(10, 3 - 1 - floor(log10(abs(l_extendedprice)))) + 0.5) / pow(10, 3 - 1 - floor(log10(abs(l_extendedprice)))) END AS three FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", S.round_significant("l_extendedprice", 3).alias("three"))


@query("format_result", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN abs(round(c_acctbal)) < 0.5 THEN '0.000000' ELSE printf('%.6f', round(c_acctbal)) END AS text, CASE WHEN c_custkey % 3 = 0 THEN 'Sí' WHEN c_custkey % 3 = 1 THEN 'No' ELSE '' END AS flag FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.format_result(F.when(F.col("c_custkey") % 10 != 0, F.round("c_acctbal"))).alias("text"), S.format_flag(F.when(F.col("c_custkey") % 3 != 2, F.col("c_custkey") % 3 == 0)).alias("flag"))


@query("format_es", "SELECT c_custkey, translate(format('{:,.2f}', c_acctbal), ',.', '.,') AS pesos FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.format_es("c_acctbal").alias("pesos"))


@query("last_digit_code", "SELECT c_custkey, CAST(c_custkey % 10 AS INTEGER) AS skill FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.last_digit_code("c_custkey").alias("skill"))


@query("wide_prefix_to_long", "SELECT c_mktsegment, k, n FROM (UNPIVOT (SELECT c_mktsegment, count(*) FILTER (c_acctbal < 0) AS debt, count(*) FILTER (c_acctbal >= 0) AS credit FROM customer GROUP BY 1) ON debt, credit INTO NAME k VALUE n)")
def _(spark, d):
    w = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") < 0).alias("n_debt"), F.count_if(F.col("c_acctbal") >= 0).alias("n_credit"))
    return w.unpivot(["c_mktsegment"], ["n_debt", "n_credit"], "k", "n").withColumn("k", F.regexp_replace("k", "^n_", ""))


@query("logistic_safe", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN 1 / (1 + exp(-least(c_acctbal, 700))) ELSE exp(greatest(c_acctbal, -700)) / (1 + exp(greatest(c_acctbal, -700))) END, 9) AS p, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 9) AS log_x FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", r(S.logistic_safe("c_acctbal"), 9).alias("p"), r(S.log_safe("c_acctbal"), 9).alias("log_x"))


@query("hash_uniform", "SELECT c_custkey, CAST(CAST('0x' || substr(md5('s:' || c_custkey), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.hash_uniform("s", "c_custkey").alias("u"))


@query("clean_text", f"WITH {DIRTY} SELECT line_no, trim(regexp_replace('  ' || kind || '   x ', '\\s+', ' ', 'g')) AS text FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("line_no", S.clean_text(F.concat(F.lit("  "), "kind", F.lit("   x "))).alias("text"))


@query("parse_int", f"WITH {DIRTY} SELECT line_no, CAST(CASE WHEN line_no % 7 <> 0 THEN age END AS INTEGER) AS n FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("line_no", S.parse_int(F.when(F.col("line_no") % 7 == 0, "NULL").otherwise(F.col("age"))).alias("n"))


@query("parse_date", f"WITH {DIRTY} SELECT line_no, {DAY} AS day FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("line_no", S.parse_date("day").alias("day"))


@query("fold_key", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'three' ELSE regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') || 'n' END AS key FROM nation")
def _(spark, d):
    n = F.when(F.col("n_nationkey") == 3, "Trés!").otherwise(F.concat("n_name", F.lit(" Ñ")))
    return table(spark, d, "nation").select("n_nationkey", S.fold_key(n, {"tres": "three"}).alias("key"))


@query("log_safe", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 9) AS log_x FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", r(S.log_safe("c_acctbal"), 9).alias("log_x"))
