"""Mix sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; the budget of a source falls into one bucket, which alone is
summed again by the next bits of the hash, until a bucket holds one hash value. What lies below the threshold
is taken once more than the rest. Nothing is sorted by document, and a source that holds a third of all rows
is pre-aggregated to at most 2^15 sums before the shuffle.

Nulls: a null text counts 0 words, a null source is a source of its own (last in order); rows with a null or repeated id
are told apart by their texts. Rows equal in id and text share a hash and so a decision. Of the
document at the boundary, all or nothing is taken, whichever comes nearer to the target. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hash60, small

BITS, LEVELS = 15, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: str) -> Column:
    """Of id and text, so that rows without an id, or of one id, are told apart by their texts."""
    return hash60(F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.col("text")))


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with the sums over all rows before each in an order that tells them apart: ranges are summed apart, then shifted."""
    d = cut(rows.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shift = d.groupBy("_range").agg(*[F.sum(f"_{n}").alias(n) for n in sums]).select(F.col("_range").alias("_at"), *[F.coalesce(F.sum(n).over(ranges), F.lit(0)).alias(f"_{n}_shift") for n in sums])
    out = d.withColumns({n: F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in sums}).join(F.broadcast(shift), F.col("_range") == F.col("_at"))
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}_shift")).alias(n) for n in sums])


def source_targets(sized: DataFrame, cycle: int = 3, limit: float = 3.0) -> DataFrame:
    """source, source_size, target: weights 1..cycle by code point (null last), repeating; targets stop at limit times the size.

    The excess goes to the other sources by weight until none is above: target = min(limit * size, rate * weight)
    for one rate, found from prefix sums over the sources ordered by limit * size / weight. Of sources equal in that, the
    first has the rate that holds: it counts none of them as above yet. Only the table of sources, one row each, is ordered,
    by ranges.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = _before(s, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    s = s.withColumn("weight", F.col("place") % cycle + 1).withColumn("cap", limit * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = _before(s, [F.col("ratio"), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "weights": F.col("weight")})
    all_ = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rate = (F.lit(all_["size"]) - F.col("caps")) / (F.lit(all_["weight"]) - F.col("weights"))
    level = s.withColumn("rate", rate).filter("rate <= ratio").agg(F.min(F.struct("ratio", -F.col("rate"))).alias("first")).first()["first"]
    return s.select("source", "source_size", F.least(F.col("cap"), F.lit(-level[1] if level else 0.0) * F.col("weight")).cast("double").alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, rounds, edge, edge_in: hashes below edge are taken rounds + 1 times, those above rounds times."""
    state = targets.select(
        F.col("source").alias("src"), "source_size", "target",
        F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).alias("rounds"),
    ).withColumn("need", F.col("target") - F.col("rounds") * F.col("source_size")).withColumn("edge", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long")).withColumn("inside", F.lit(None).cast("long"))
    state = cut(state)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        here = sized.join(small(state.select("src", "edge")), F.col("source").eqNullSafe(F.col("src")) & (F.shiftright("h", shift + BITS) == F.col("edge")))
        hist = here.groupBy("src", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumnRenamed("src", "s").withColumn("upto", F.sum("words").over(run))
        old = state.select(F.col("src").alias("o"), "need", F.col("before").alias("had"))
        first = (hist.join(old, F.col("s").eqNullSafe(F.col("o"))).filter(F.col("had") + F.col("upto") > F.col("need"))
                 .groupBy("s").agg(F.min(F.struct("bucket", "upto", "words")).alias("b")))
        # a source whose budget lies above all its words ends past its last hash
        state = state.drop("inside").join(first, F.col("src").eqNullSafe(F.col("s")), "left").select(
            "src", "source_size", "target", "rounds", "need",
            F.coalesce("b.bucket", F.lit(1 << (BITS * (level + 1)))).alias("edge"),
            (F.col("before") + F.coalesce(F.col("b.upto") - F.col("b.words"), F.lit(0))).alias("before"),
            F.col("b.words").alias("inside"))
        state = cut(state)
    near = F.coalesce((F.col("before") + F.col("inside") - F.col("need")) < (F.col("need") - F.col("before")), F.lit(False))
    return small(state.select("src", "source_size", "target", "rounds", "edge", near.alias("edge_in")))


def mix(docs: DataFrame, seed: str = "mix", cycle: int = 3, limit: float = 3.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, in the hash order of seed."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash(seed).alias("h")))
    t = thresholds(sized, source_targets(sized, cycle, limit))
    more = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.col("edge_in"))
    copies = (F.col("rounds") + more.cast("int")).cast("int")
    return sized.join(t, F.col("source").eqNullSafe(F.col("src"))).select(
        "doc_id", "source", "size", F.col("source_size").cast("long"), "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns are kept."""
    seed = options.get("seed", "mix")
    row = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), _hash(seed).alias("h"))
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash(seed).alias("h")))
    t = thresholds(sized, source_targets(sized, options.get("cycle", 3), options.get("limit", 3.0)))
    more = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.col("edge_in"))
    # one row per source: joined by broadcast where Spark finds it small, else by a shuffle whose hot source it splits
    out = row.join(t, F.col("source").eqNullSafe(F.col("src"))).withColumn("copies", (F.col("rounds") + more.cast("int")).cast("int"))
    return out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
