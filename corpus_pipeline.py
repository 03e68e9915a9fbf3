"""A corpus pipeline of five stages over documents; every stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tallyworks.llm import linededup, mixing, packing, simhash, toxicity
from tallyworks.llm.common import cut, read
from tallyworks.llm.queries import tokenizer_path


#: Bytes of texts that an executor hands to a Python worker at once. By Spark's own 10,000 rows or 64 MB, both sides hold a
#: batch several times over, and what they held stays with the workers for the stages that follow.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def in_small_batches(stage: Callable) -> Callable:
    """The stage, for whose job the session has batches of BATCH bytes from then on; a size that the user has set holds."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_KEY, None) is None:
            spark.conf.set(BATCH_KEY, BATCH)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.7 go."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source repeats go; n_chars follows the text."""
    from pyspark.sql import functions as F

    return linededup.without_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks, some not at all."""
    return mixing.mixed(docs)


@in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Learned scores, fingerprints and packing are not for SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet to the shared folder and read again."""
    own = spark.conf.get(BATCH_KEY, None)
    try:
        docs = read(spark, sf_dir, "documents")
        for _, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir))
        return docs
    finally:
        if own is None:
            spark.conf.unset(BATCH_KEY)
