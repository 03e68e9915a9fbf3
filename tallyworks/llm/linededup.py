"""Drop lines that a site repeats: the share of a host's pages that hold a line, against a boilerplate ratio.

A page is a distinct text of its host, so that copies of one document do not make its lines boilerplate. A line is compared
after trimming white space; empty lines are never dropped. A line of a host goes from every document of that host if more
than ratio of its pages hold it, and at least min_hits: a line that one or two pages have is not repeated, however small the site.
Each page counts a line once, so the counts are summed in part by (host, line) before they are shuffled. Since the ratios
of a host's lines sum to its mean lines per page, a host has at most that mean over ratio such lines, so they are gathered into
one bounded array per host. The arrays are broadcast if they hold at most broadcast_mb in all; else the documents meet
them by (host, salt), the salt taken from the whole row, so that neither a hot host nor a group of copies is one task.

Nulls: a null host is no site, its documents stay as they are; a null text stays null with 0 lines. A document
that loses all lines has an empty text, and goes where documents are dropped for that (without_boilerplate). dedup_lines
drops no row; repeated rows are cleaned alike. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLANK = " \t\r\x0b\x0c"


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05, min_hits: int = 3) -> DataFrame:
    """site, n_pages, lines: for each host the lines that more than ratio of its distinct texts hold."""
    d = docs.select(F.col(host).alias("site"), F.col(text).alias("body")).filter(F.col("site").isNotNull()).distinct()
    pages = d.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    held = F.array_distinct(F.filter(F.transform(F.split("body", "\n"), _trim), lambda x: x != ""))
    counts = d.select("site", F.explode(held).alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("hits"))
    often = counts.filter(F.col("hits") >= min_hits).join(pages.withColumnRenamed("site", "s"), F.col("site") == F.col("s"))
    often = often.filter(F.col("hits") > F.lit(ratio) * F.col("n_pages"))
    return often.groupBy("site").agg(F.first("n_pages").alias("n_pages"), F.array_sort(F.collect_list("line")).alias("lines"))


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05, min_hits: int = 3, salts: int = 64, broadcast_mb: int = 32) -> DataFrame:
    """docs with the text cleaned, and the columns n_lines and n_dropped behind its own, in a struct with the row: row, clean, n_lines, n_dropped."""
    bad = cut(boilerplate(docs, host, text, ratio, min_hits).select(F.col("site").alias("bad_site"), F.col("lines").alias("bad")))
    rows = docs.select(F.struct("*").alias("row"), F.col(host).alias("site"), F.col(text).alias("body"))
    total = bad.agg(F.sum(F.octet_length(F.array_join("bad", "")) + 16 * F.size("bad") + 64).alias("n")).first()["n"] or 0
    if total <= broadcast_mb << 20:
        out = rows.join(F.broadcast(bad), F.col("site") == F.col("bad_site"), "left")
    else:
        spread = bad.select("bad_site", "bad", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("bad_salt"))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(spread, (F.col("site") == F.col("bad_site")) & (F.col("salt") == F.col("bad_salt")), "left")
    lines = F.split("body", "\n")
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("bad"), _trim(x))))
    out = out.withColumn("lines", lines).withColumn("kept", kept)
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return out.select("row", F.when(F.col("bad").isNull(), F.col("body")).otherwise(F.array_join("kept", "\n")).alias("clean"), n("lines").alias("n_lines"), (n("lines") - n("kept")).alias("n_dropped"))


def without_boilerplate(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with the text cleaned and all other columns as they were; a document that loses every line goes."""
    out = dedup_lines(docs, text=text, **options)
    out = out.filter(~((F.col("n_dropped") > 0) & (F.col("clean") == "")))
    return out.select(*[F.col("clean").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
