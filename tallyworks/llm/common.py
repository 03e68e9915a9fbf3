"""What several operators share: reading, cutting lineage, sizing and broadcasting by a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table counts as small enough to broadcast.
SMALL_ROWS = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set and all run on this machine."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, and a lost executor loses nothing. What is written goes with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyworks-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p, files = _path(spark, path)
    files.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what cut wrote for df, once nothing reads it any more."""
    path = getattr(df, "written_to", None)
    if path:
        p, files = _path(df.sparkSession, path)
        files.delete(p, True)
        files.cancelDeleteOnExit(p)


def small(df: DataFrame, rows: int = SMALL_ROWS, mb: int = 32) -> DataFrame:
    """Mark a written table for broadcast if it holds few rows and few bytes; else leave the join to Spark."""
    if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) > rows:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= mb << 20 else df


def hash60(*parts: Column) -> Column:
    """60 bits of an md5 as a long, which other engines compute alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def parts_for(df: DataFrame, total: int, mb: int = 24) -> int:
    """So many hash parts that each holds about mb MB of total bytes; never below the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (mb << 20) + 1)
