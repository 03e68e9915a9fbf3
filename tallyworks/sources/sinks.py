"""Sinks of result tables, and a shared folder for what one job hands to the next."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import format_flag, format_result


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a local one only where none is set and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def write_result_csv(df: DataFrame, path: str) -> None:
    """Header and rows in column order: six-decimal numbers, Sí/No flags, empty for null; results are small, so one file."""
    cols = [format_result(c).alias(c) if t in ("double", "float") else format_flag(c).alias(c) if t == "boolean" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, t in df.dtypes]
    df.select(*cols).repartition(1).write.csv(path, header=True, emptyValue="", mode="overwrite")


def write_result_json(df: DataFrame, path: str) -> None:
    df.repartition(1).write.json(path, mode="overwrite")


def write_extract(df: DataFrame, path: str, names: dict[str, str], keys: list[str]) -> None:
    """A reduced public extract: renamed columns, sorted by keys, semicolons."""
    df.select(*[F.col(c).alias(n) for c, n in names.items()]).orderBy(*keys).write.csv(path, sep=";", header=True, mode="overwrite")
