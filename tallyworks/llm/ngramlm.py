"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

Each part of the corpus counts its own n-grams of every order; the counts meet in tables partitioned by a 56-bit hash of the n-gram,
where they are summed; each part gets the totals of its n-grams back, joins them to the n-grams of its
documents and sums the logarithms per document. What is exchanged grows with the corpus; no task holds more than a part or a
bucket. A very frequent n-gram is one number a part.

S(w | context) = count(context w) / count(context) if the n-gram occurs min_count times or more, else alpha *
S(w | shorter context); S(w) = count(w) / words of the corpus. Words are runs of non-white-space (ASCII), as written.

Nulls and ties: a null or empty text has 0 words, log_score 0.0 and a null mean; a null doc_id is scored like any other; repeated
rows count and are scored as documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, parts_for, text_bytes
from .parts import KEY_BITS, bucket_slices, gaps, packed, parted, squeeze, ungaps, unpacked, unsqueeze

CACHE_WORDS = 1_000_000
SHIFT = np.uint64(64 - KEY_BITS)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[bytes], cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    split = [t.split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    get = cache.__getitem__
    return np.fromiter((get(w) for s in split for w in s), np.uint64, int(sizes.sum())), sizes


def ngram_keys(words: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the key at each word of the n-gram that ends there; 0 where the text has too few words before."""
    at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, h = [], words
    for n in range(1, order + 1):
        if n > 1:
            longer = np.zeros_like(h)
            longer[1:] = _mix(h[:-1] + np.uint64(n)) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)  # n-gram before, then the word
            h = longer
        key = _mix(h + np.uint64(n * 7919)) >> SHIFT
        key[at < n - 1] = 0
        out.append(key)
    return out


def _counted(texts: list[bytes], cache: WordHash, order: int) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(np.concatenate(ngram_keys(*word_hashes(texts, cache), order)), return_counts=True)
    if len(keys) and keys[0] == 0:
        keys, n = keys[1:], n[1:]
    return keys, n


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score."""
    size = text_bytes(docs)
    buckets = parts_for(docs, size, 8)
    texts = packed(parted(docs, size))

    def send(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = _counted(unpacked(rows)[1], WordHash(), order)
        out = [(b, key[0], j - i, gaps(keys[i:j]), squeeze(n[i:j].astype("<u4"))) for b, i, j in bucket_slices(keys, buckets)]
        return pd.DataFrame(out, columns=["bucket", "part", "n", "keys", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([ungaps(k, n) for k, n in zip(rows["keys"], rows["n"], strict=True)])
        counts = np.concatenate([unsqueeze(c, "<u4", n) for c, n in zip(rows["counts"], rows["n"], strict=True)])
        own, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, counts, len(own)).astype("<u8")[where]
        ends = np.cumsum(rows["n"].to_numpy())
        back = [squeeze(total[e - n:e]) for e, n in zip(ends.tolist(), rows["n"].tolist(), strict=True)]
        check = [int(np.bitwise_xor.reduce(keys[e - n:e])) for e, n in zip(ends.tolist(), rows["n"].tolist(), strict=True)]
        return pd.DataFrame({"part": rows["part"], "bucket": rows["bucket"], "n": rows["n"], "totals": back, "check": check})

    def join(key: tuple, rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        ids, own = unpacked(rows)
        cache = WordHash()
        words, sizes = word_hashes(own, cache)
        by_order = ngram_keys(words, sizes, order)
        keys, where = np.unique(np.concatenate(by_order), return_inverse=True)
        none = int(len(keys) > 0 and keys[0] == 0)  # key 0: no n-gram of that order ends here
        keys = keys[none:]
        t = totals.sort_values("bucket")
        if int(t["n"].sum()) != len(keys) or (len(keys) and int(np.bitwise_xor.reduce(t["check"].to_numpy())) != int(np.bitwise_xor.reduce(keys))):
            raise RuntimeError("a part's documents changed between two reads")
        count = np.concatenate([unsqueeze(b, "<u8", n) for b, n in zip(t["totals"], t["n"], strict=True)] or [np.empty(0, "<u8")]).astype(float)
        found = np.split(np.r_[np.zeros(none), count][where], order)
        n_words = float(rows_total)
        s = found[0] / n_words if n_words else found[0]
        for n in range(2, order + 1):
            context = np.r_[0.0, found[n - 2][:-1]]  # the n-gram that ends at the word before
            seen = (by_order[n - 1] > 0) & (found[n - 1] >= min_count)
            has = by_order[n - 1] > 0
            s = np.where(seen, found[n - 1] / np.where(context > 0, context, 1.0), np.where(has, alpha * s, s))
        logs = np.log(np.where(s > 0, s, 1.0))
        ends = np.cumsum(sizes)
        total = [float(logs[e - n:e].sum()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": sizes, "log_score": total})
        out["mean_log_score"] = [x / n if n else None for x, n in zip(total, sizes.tolist(), strict=True)]
        return out

    rows_total = docs.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")).alias("n")).first()["n"] or 0
    sent = texts.groupBy("part").applyInPandas(send, "bucket long, part long, n long, keys binary, counts binary")
    answers = sent.groupBy("bucket").applyInPandas(add, "part long, bucket long, n long, totals binary, check long")
    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(join, "doc_id long, n_words long, log_score double, mean_log_score double")


def score_joined(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """The same scores from rows alone: n-grams exploded, counted by group, joined back to their places, summed by document.

    N-grams are compared as text. It shuffles every n-gram of every place three times, several times the corpus (figures in
    the README), so score() is the form for large corpora.
    """
    d = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("w")))
    total = d.agg(F.sum(F.size("w")).alias("n")).first()["n"] or 0
    gram = lambda n: lambda i: F.struct((i + n - 1).alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("gram"))
    some = F.flatten(F.array(*[F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), gram(n))).otherwise(F.array().cast("array<struct<at:int,n:int,gram:string>>")) for n in range(1, order + 1)]))
    g = d.select("row", F.explode(some).alias("g")).select("row", "g.at", "g.n", "g.gram")
    counts = g.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("c"))
    seen = g.join(counts, ["n", "gram"])  # an n-gram that holds many rows is split by the skew join
    # a count serves the place where its n-gram ends and, as context of a longer one, the place after
    at = seen.select("row", "c", F.explode(F.array(F.struct(F.col("at").alias("at"), F.col("n").alias("own"), F.lit(0).alias("context")), F.struct((F.col("at") + 1).alias("at"), F.lit(0).alias("own"), (F.col("n") + 1).alias("context")))).alias("p")).select("row", "p.at", "p.own", "p.context", "c")
    place = at.groupBy("row", "at").agg(*[F.max(F.when(F.col("own") == n, F.col("c"))).alias(f"c{n}") for n in range(1, order + 1)], *[F.max(F.when(F.col("context") == n, F.col("c"))).alias(f"b{n}") for n in range(2, order + 1)]).filter("c1 IS NOT NULL")
    s = F.col("c1") / F.lit(float(total or 1))
    for n in range(2, order + 1):
        s = F.when(F.col(f"c{n}") >= min_count, F.col(f"c{n}") / F.col(f"b{n}")).when(F.col(f"c{n}").isNotNull(), alpha * s).otherwise(s)
    sums = place.groupBy(F.col("row").alias("r")).agg(F.count(F.lit(1)).alias("n_words"), F.sum(F.ln(s)).alias("log_score"))
    out = d.select("row", "doc_id").join(sums, F.col("row") == F.col("r"), "left")
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"), (F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
