"""Cleaning by a declared dictionary of variables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, parse_date, parse_number


@dataclass(frozen=True)
class VarSpec:
    """A variable: kind is number, integer, category, date or text; codes are the declared categories."""

    name: str
    kind: str = "text"
    low: float | None = None
    high: float | None = None
    codes: tuple[str, ...] = field(default_factory=tuple)
    missing: str | None = None


def clean_numeric(spec: VarSpec, decimal: str = ",") -> Column:
    """value, rule: null with the name of the rule where the entry is missing, no number, no integer or out of range."""
    t = F.trim(F.col(spec.name))
    n = parse_number(t, decimal)["value"]
    rule = F.when(F.upper(t).isin("", "NA", *([spec.missing.upper()] if spec.missing else [])) | t.isNull(), "missing").when(n.isNull(), "not a number")
    if spec.kind == "integer":
        rule = rule.when(n != F.floor(n), "not an integer")
    if spec.low is not None:
        rule = rule.when(n < spec.low, "out of range")
    if spec.high is not None:
        rule = rule.when(n > spec.high, "out of range")
    return F.struct(F.when(rule.isNull(), n).alias("value"), rule.alias("rule"))


def clean_category(spec: VarSpec) -> Column:
    """value, rule: the declared code that matches without regard to case."""
    t = clean_text(spec.name)
    codes = F.create_map(*[F.lit(v) for c in spec.codes for v in (c.lower(), c)])
    v = codes[F.lower(t)]
    return F.struct(v.alias("value"), F.when(F.coalesce(t, F.lit("")) == "", "missing").when(v.isNull(), "unknown code").alias("rule"))


def clean_date(spec: VarSpec) -> Column:
    t = F.trim(F.col(spec.name))
    v = parse_date(t)
    return F.struct(v.alias("value"), F.when(F.coalesce(t, F.lit("")) == "", "missing").when(v.isNull(), "impossible date").alias("rule"))


def _cleaned(spec: VarSpec) -> Column:
    if spec.kind in ("number", "integer"):
        return clean_numeric(spec)
    if spec.kind == "category":
        return clean_category(spec)
    if spec.kind == "date":
        return clean_date(spec)
    t = clean_text(spec.name)
    return F.struct(t.alias("value"), F.when(F.coalesce(t, F.lit("")) == "", "missing").alias("rule"))


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by an explicit order column."""
    first = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def clean_table(df: DataFrame, specs: list[VarSpec], key: str, order: str) -> DataFrame:
    return dedupe_first(df.select(order, key, *[_cleaned(s)["value"].alias(s.name) for s in specs if s.name != key]), key, order)


def change_log(df: DataFrame, specs: list[VarSpec]) -> DataFrame:
    """variable, rule, n: how often each rule fired."""
    fired = F.array(*[F.struct(F.lit(s.name).alias("variable"), _cleaned(s)["rule"].alias("rule")) for s in specs])
    return df.select(F.explode(fired).alias("f")).select("f.*").filter("rule IS NOT NULL").groupBy("variable", "rule").agg(F.count(F.lit(1)).alias("n"))


def profile_columns(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """name, n, missing, distinct, distinct_folded, all_numeric, example: one aggregate over all columns."""
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.trim(F.col(c)).alias("v"), F.col(order).alias("o")) for c in columns]))
    d = df.select(cell.alias("c")).select("c.*").withColumn("full", F.coalesce(F.upper("v"), F.lit("")).isin("", "NA") == F.lit(False))
    v = F.when(F.col("full"), F.col("v"))
    g = d.withColumn("v", v).groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    return g.groupBy("name").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("v").alias("distinct_values"), F.count_distinct(F.lower("v")).alias("distinct_folded"),
                                 F.coalesce(F.bool_and(F.when(F.col("v").isNotNull(), F.col("v").rlike(r"^[+-]?[0-9.,]+$"))), F.lit(False)).alias("all_numeric"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("o"))).alias("example"))


def suspicions(profile: DataFrame, declared: list[str]) -> DataFrame:
    """name, suspicion, from a profile."""
    s = F.array_compact(F.array(
        F.when(~F.col("name").isin(declared), "undeclared"), F.when(F.col("missing") == F.col("n"), "empty"),
        F.when((F.col("missing") < F.col("n")) & (2 * F.col("missing") > F.col("n")), "more than half empty"),
        F.when(F.col("distinct_values") == 1, "constant"), F.when(F.col("all_numeric"), "numbers as text"), F.when(F.col("distinct_values") > F.col("distinct_folded"), "case variants")))
    return profile.select("name", F.explode(s).alias("suspicion"))
