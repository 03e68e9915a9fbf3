"""Readers of delimited and Parquet microdata: text first, types by explicit projection, only the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_text


def read_survey_text(spark: SparkSession, path: str, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Every cell as text, headers in upper case; short rows are padded with nulls, long ones cut."""
    df = spark.read.csv(path, sep=sep, encoding=encoding, header=True, quote='"', mode="PERMISSIVE", inferSchema=False)
    return df.toDF(*[c.strip().upper() for c in df.columns])


def read_selected_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A few columns of a wide Parquet file: the scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def read_delimited_utf8(spark: SparkSession, path: str) -> DataFrame:
    """Comma file with a byte-order mark, blank lines dropped, cells trimmed."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.select(*[clean_text(c).alias(c) for c in df.columns]).dropna("all")


def sniff_dialect(spark: SparkSession, path: str) -> tuple[str, str]:
    """(separator, decimal mark): the separator that gives the header most fields, ties to the comma; the mark of most cells."""
    header = spark.read.text(path).head()[0]  # one line
    sep = max((",", ";", "\t", "|"), key=lambda s: (header.count(s), s == ","))
    lines = spark.read.text(path).select(F.explode(F.split("value", "\\" + sep if sep == "|" else sep)).alias("cell")).select(F.trim(F.regexp_replace("cell", '"', "")).alias("cell"))
    n = lines.agg(F.count_if(F.col("cell").rlike(r"^[+-]?[\d.]*\d,\d+$")).alias("comma"), F.count_if(F.col("cell").rlike(r"^[+-]?[\d,]*\d\.\d+$")).alias("dot")).first()
    return sep, "," if n["comma"] > n["dot"] else "."


def read_census_parquet(spark: SparkSession, path: str, columns: list[str], key: str = "province") -> DataFrame:
    """One folder per province (name = code): needed columns and the code of the folder."""
    df = spark.read.option("basePath", path).parquet(f"{path}/{key}=*")
    return df.select(key, *columns)


def read_vital_counts(df: DataFrame, count: str, reasons: dict[str, str]) -> DataFrame:
    """reason (null: kept), n: counts by the first SQL condition that discards a row."""
    why = None
    for name, cond in reasons.items():
        why = F.when(F.expr(cond), name) if why is None else why.when(F.expr(cond), name)
    return df.groupBy(why.alias("reason")).agg(F.sum(count).alias("n"))


def read_names_dimension(spark: SparkSession, path: str, code: str = "code", name: str = "name") -> DataFrame:
    """code, name out of the properties of a collection of map features."""
    df = spark.read.json(path, multiLine=True)
    return df.select(F.explode("features").alias("f")).select(F.col(f"f.properties.{code}").alias("code"), F.col(f"f.properties.{name}").alias("name"))
