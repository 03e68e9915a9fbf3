"""Readers and sinks, over files that Spark writes from the given tables; and exact intervals of rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rates as T
from ..sources import readers as R
from ..sources import sinks as W
from .registry import DIRTY, PERSONS, dirty, persons, query, r, table
from . import sqltext as Q
from .surveys import CELLS, cells, direct

c = F.col


@query("read_survey_text", f"WITH {DIRTY} SELECT CAST(line_no AS VARCHAR) AS LINE_NO, id AS ID, amount AS AMOUNT, day AS DAY FROM dirty")
def _(spark, d):
    path = W.scratch(spark)
    dirty(spark, d).select("line_no", "id", "amount", "day").write.csv(path, sep=";", header=True, encoding="ISO-8859-1")
    return R.read_survey_text(spark, path)


@query("read_selected_columns", "SELECT l_orderkey, l_returnflag FROM lineitem")
def _(spark, d):
    return R.read_selected_columns(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_returnflag"])


@query("read_delimited_utf8", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _(spark, d):
    path = W.scratch(spark)
    table(spark, d, "nation").select(F.format_string("  %d ", "n_nationkey").alias("n_nationkey"), "n_name").write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return R.read_delimited_utf8(spark, path)


@query("sniff_dialect", f"""WITH {DIRTY}, t AS (SELECT 'id;amount;age' AS line UNION ALL SELECT id || ';' || amount || ';' || age FROM dirty), s AS (SELECT s AS sep, len(string_split('id;amount;age', s)) - 1 AS n FROM (VALUES (','), (';'), (chr(9)), ('|')) v(s)),
b AS (SELECT sep FROM s ORDER BY n DESC, sep = ',' DESC LIMIT 1), u AS (SELECT trim(unnest(string_split(line, sep))) AS cell, sep FROM t, b) SELECT any_value(sep) AS sep, CASE WHEN count(*) FILTER (regexp_matches(cell, '^[+-]?[0-9.]*[0-9],[0-9]+$')) > count(*) FILTER (regexp_matches(cell, '^[+-]?[0-9,]*[0-9][.][0-9]+$')) THEN ',' ELSE '.' END AS dec FROM u""")
def _(spark, d):
    path = W.scratch(spark)
    dirty(spark, d).select("id", "amount", "age").write.csv(path, sep=";", header=True)
    sep, mark = R.sniff_dialect(spark, path)
    return spark.createDataFrame([(sep, mark)], "sep string, dec string")


@query("read_census_parquet", "SELECT c_nationkey AS province, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    path = W.scratch(spark)
    table(spark, d, "customer").withColumn("province", c("c_nationkey")).write.partitionBy("province").parquet(path)
    return R.read_census_parquet(spark, path, ["c_custkey"]).groupBy("province").agg(F.count(F.lit(1)).alias("n"))


@query("read_vital_counts", f"WITH {PERSONS} SELECT CASE WHEN p21 = -9 THEN 'not answered' WHEN age < 0 THEN 'no age' END AS reason, CAST(sum(w) AS BIGINT) AS n FROM persons GROUP BY 1")
def _(spark, d):
    return R.read_vital_counts(persons(spark, d), "w", {"not answered": "p21 = -9", "no age": "age < 0"})


@query("read_names_dimension", "SELECT n_nationkey AS code, n_name AS name FROM nation")
def _(spark, d):
    path = W.scratch(spark)
    # one collection of features: nations, a row each
    one = table(spark, d, "nation").agg(F.collect_list(F.struct(F.struct(c("n_nationkey").alias("code"), c("n_name").alias("name")).alias("properties"))).alias("features"))
    one.write.json(path)
    return R.read_names_dimension(spark, path).select(c("code").cast("int").alias("code"), "name")


@query("write_result_csv", f"WITH {PERSONS} SELECT grp, printf('%.6f', round(avg(x), 2)) AS mean, 'Sí' AS known, CAST(count(*) AS VARCHAR) AS n FROM persons GROUP BY grp")
def _(spark, d):
    path = W.scratch(spark)
    W.write_result_csv(persons(spark, d).groupBy("grp").agg(F.round(F.avg("x"), 2).alias("mean"), F.lit(True).alias("known"), F.count(F.lit(1)).alias("n")), path)
    return spark.read.csv(path, header=True)


@query("write_result_json", f"WITH {PERSONS} SELECT seg, count(*) AS n FROM persons GROUP BY seg")
def _(spark, d):
    path = W.scratch(spark)
    W.write_result_json(persons(spark, d).groupBy("seg").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("seg string, n long").json(path)


@query("write_extract", f"WITH {PERSONS} SELECT CAST(id AS VARCHAR) AS persona, status AS estado, CAST(w AS VARCHAR) AS peso FROM persons")
def _(spark, d):
    path = W.scratch(spark)
    W.write_extract(persons(spark, d), path, {"id": "persona", "status": "estado", "w": "peso"}, ["persona"])
    return spark.read.csv(path, sep=";", header=True)


# exact intervals of rates: a population each

POISSON = Q.bisected("lo", "k", ["pop"], Q.gamma_upper("greatest(cases, 1)", "q") + " <= 0.975", "0", "cases + 60") + ", " + Q.bisected("hi", "k", ["pop"], Q.gamma_upper("(cases + 1)", "q") + " <= 0.025", "0", "cases + 60 * sqrt(cases + 1) + 60")


@query("poisson_ci", f"WITH RECURSIVE {CELLS}, k AS (SELECT pop, CAST(sum(cases) AS BIGINT) AS cases FROM cells GROUP BY pop), {POISSON} SELECT pop, cases, CASE WHEN cases = 0 THEN 0 ELSE round(lo.q, 4) END AS low, round(hi.q, 4) AS high FROM k JOIN lo USING (pop) JOIN hi USING (pop)")
def _(spark, d):
    """pop, cases and the exact interval of a count."""
    t = cells(spark, d).groupBy("pop").agg(F.sum("cases").alias("cases"))
    low, high = T.poisson_interval(c("cases"))
    return t.select("pop", "cases", r(low).alias("low"), r(high).alias("high"))


def _fay_feuer(spark, d):
    return T.with_gamma_interval(direct(spark, d).filter("standard = 'young'")).select("pop", "rate", "low", "high")


FAY = f"""{CELLS}, fy AS (SELECT pop, rate AS y, variance AS v, top / 15.0::DOUBLE AS w FROM direct WHERE standard = 'young'), fk AS (SELECT pop, y, v, w, greatest(y * y / v, 1e-9) AS a, (y + w) * (y + w) / (v + w * w) AS b FROM fy WHERE v > 0),
{Q.bisected("lo", "fk", ["pop"], Q.gamma_upper("a", "q") + " <= 0.975", "0", "a + 60")}, {Q.bisected("hi", "fk", ["pop"], Q.gamma_upper("b", "q") + " <= 0.025", "0", "b + 60 * sqrt(b) + 60")},
fay AS (SELECT pop, y AS rate, lo.q * v / y AS low, hi.q * (v + w * w) / (y + w) AS high FROM fk JOIN lo USING (pop) JOIN hi USING (pop))"""


@query("direct_ci_fay_feuer", f"WITH RECURSIVE {FAY} SELECT pop, round(1000 * rate, 4) AS rate, round(1000 * low, 4) AS low, round(1000 * high, 4) AS high FROM fay")
def _(spark, d):
    return _fay_feuer(spark, d).select("pop", *[r(1000 * c(k)).alias(k) for k in ("rate", "low", "high")])


@query("rate_ratio_ci", f"WITH RECURSIVE {FAY}, s AS (SELECT pop, rate, (ln(high) - ln(low)) / (2 * 1.959963984540054) AS s FROM fay), j AS (SELECT a.pop AS a, b.pop AS b, a.rate / b.rate AS q, sqrt(a.s * a.s + b.s * b.s) AS s FROM s a JOIN s b ON a.pop < b.pop) SELECT a, b, round(q, 6) AS ratio, round(q * exp(-1.959963984540054 * s), 6) AS low, round(q * exp(1.959963984540054 * s), 6) AS high FROM j")
def _(spark, d):
    """Ratio of two adjusted rates with an interval on the log scale, from the widths of both intervals; every pair of populations, a row per nation on each side."""
    return T.rate_ratios(_fay_feuer(spark, d)).select("a", "b", *[r(k, 6).alias(k) for k in ("ratio", "low", "high")])
