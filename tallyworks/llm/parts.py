"""Parts of a corpus and what they exchange: sorted lists of 56-bit keys, sent as compressed gaps.

A part is a run of documents of one file split, so the same documents whenever a task is repeated. A part sends its distinct keys
to hash buckets; a bucket sees the keys of all parts and answers each part key by key, in the order that
the part can make again from its own text. Keys themselves are never sent back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KEY_BITS = 56
#: MB of text that make a part.
PART_MB = 6.5


def _dctx() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeeze(a: np.ndarray) -> bytes:
    """An array of whole numbers, as compressed byte planes."""
    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(len(raw), -1).T.tobytes() if len(raw) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueeze(b: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_dctx().decompress(b, max_output_size=max(1, n * width)), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel() if n else np.empty(0, kind)


def gaps(sorted_keys: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_keys, prepend=np.uint64(0)))


def ungaps(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueeze(b, "<u8", n), dtype=np.uint64)


def bucket_slices(sorted_keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the ranges of keys, empty ones left out; buckets share the key space evenly."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**KEY_BITS / buckets)).astype(np.uint64)
    cuts = [0, *np.searchsorted(sorted_keys, edges).tolist(), len(sorted_keys)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            yield i, a, b


def parted(docs: DataFrame, total: int) -> DataFrame:
    """part, doc_id, text: rows of one part come from one file split, whatever the tasks; total is the bytes of all texts."""
    def from_files(df: DataFrame) -> DataFrame:
        m = F.col("_metadata")
        files = df.select(m["file_path"].alias("p"), m["file_size"].alias("s")).distinct().agg(F.sum("s").alias("n")).first()["n"] or 1
        size = F.greatest(F.lit(1), F.ceil(m["file_block_length"] * F.lit(total / files / (PART_MB * (1 << 20))))).cast("long")
        sub = F.pmod(F.xxhash64(F.col("doc_id"), F.octet_length("text")), size)
        return df.select(F.xxhash64(m["file_path"], m["file_block_start"], sub).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    try:
        return from_files(docs)
    except AnalysisException:  # not read from files
        return from_files(cut(docs.select("doc_id", "text")))


def packed(parts: DataFrame) -> DataFrame:
    """part, ids, texts: a few rows a part, each with the doc_ids and the texts (their bytes as stored, lengths before) of many documents.

    Nulls among longs would make them doubles in pandas, so ids go as 0 and a flag where they are null.
    """
    def rows(part: int, ids: list, texts: list[bytes]) -> pd.DataFrame:
        null = np.array([i is None for i in ids], "u1")
        body = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([len(t) for t in texts], "<i8").tobytes() + null.tobytes() + b"".join(texts)
        return pd.DataFrame({"part": [part], "n": [len(ids)], "body": [zstandard.ZstdCompressor(level=3).compress(body)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [None if z else i for i, z in zip(b["doc_id"].tolist(), b["no_id"].tolist(), strict=True)]
            for part, at in b.groupby("part").indices.items():
                own, texts, size = [], [], 0
                for k in at.tolist():
                    t = b["text"].iat[k] or b""
                    own.append(ids[k])
                    texts.append(t)
                    size += len(t)
                    if size > 4 << 20:
                        yield rows(part, own, texts)
                        own, texts, size = [], [], 0
                if own:
                    yield rows(part, own, texts)

    whole = parts.select("part", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.col("text").cast("binary").alias("text"))
    return whole.mapInPandas(run, "part long, n long, body binary")


def unpacked(rows: pd.DataFrame) -> tuple[list, list[bytes]]:
    """doc_ids and texts of a part, ordered by their own values, so that a repeated task sees the same order."""
    out = []
    for n, body in zip(rows["n"], rows["body"], strict=True):
        raw = _dctx().decompress(body, max_output_size=1 << 31)
        ids, lengths = np.frombuffer(raw, "<i8", n).tolist(), np.frombuffer(raw, "<i8", n, 8 * n)
        null = np.frombuffer(raw, "u1", n, 16 * n).tolist()
        ends = (17 * n + np.cumsum(lengths)).tolist()
        starts = [17 * n, *ends[:-1]]
        out += [(None if z else i, raw[a:e]) for i, z, a, e in zip(ids, null, starts, ends, strict=True)]
    out.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return [i for i, _ in out], [t for _, t in out]
