"""SimHash fingerprints and the groups of near-duplicates that they form, by meet-in-the-middle ball hashing.

A fingerprint has a bit set where more than half of the XXH64 values of its word shingles have it. Two
fingerprints within radius bits agree up to half the radius (rounded down) in one of their two 32-bit halves. So every
distinct fingerprint emits, for each half, all variants of that half within half the radius; the half itself is
the centre of the ball. Variants are shuffled by value; in a partition, centres and variants that meet
are candidates, verified by the full distance. For radius 3 that is 66 rows a fingerprint; the ball
of radius 2 around all 64 bits would be 2,081.

Exact copies are one fingerprint before anything is emitted, however many there are. Where more than CROWD
fingerprints would meet on one value, they do not meet there: they are dealt again by a ball on the 16-bit quarters of the other half,
one of which two fingerprints within the radius share up to half of it. Of a centre 48 bits are then fixed, so on no value
more than 65,536 centres meet, whatever the corpus. Links are found in blocks of vectors and leave the task as a spanning
forest: fewer links than fingerprints, never all pairs.

Nulls and short texts: no word gives fingerprint zero, which links like any other; fewer words than a shingle
make one shingle. A null doc_id has a fingerprint but no links, and a null component. Repeated rows all come
back with the same component, and so do rows of one text under several ids. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .components import components

UPPER = bytes(range(65, 91))
FOLD = bytes.maketrans(UPPER, UPPER.lower())
#: Fingerprints that meet on one value and are compared directly; above, blocks of this size are compared.
BLOCK = 2048
#: Fingerprints of one half's value and those around it from which on they are dealt by quarters of the other half.
CROWD = 16_384


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    k = min(size, len(words))
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[k - 1:], strict=False)), np.uint64, len(words) - k + 1)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):  # long texts in slices
        part = h[i:i + 8192]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * total > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, extra: list[str] | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and extra columns of whole numbers."""
    extra = extra or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, size, seed) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp, **{c: b[c] for c in extra}})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra).mapInPandas(run, "doc_id long, fp long" + "".join(f", {c} long" for c in extra))


def _flips(radius: int, bits: int = 32) -> np.ndarray:
    """XOR masks of so many bits, 1 to radius of them set."""
    masks, last = [], [(0, 0)]
    for _ in range(radius):
        last = [(m | 1 << i, i + 1) for m, at in last for i in range(at, bits)]
        masks += [m for m, _ in last]
    return np.array(masks, np.uint64)


def _emit(radius: int):
    """The centre and the variants of each half: key (the half's number above the value), fp, centre."""
    flips = _flips(radius // 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            all_fp = b["fp"].to_numpy(np.int64).view(np.uint64)
            for i in range(0, len(all_fp), 2048):
                fp = all_fp[i:i + 2048]
                for half in (0, 1):
                    own = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                    key = np.concatenate([own, (own[:, None] ^ flips).ravel()]) | np.uint64(half << 32)
                    who = np.concatenate([fp, np.repeat(fp, len(flips))])
                    yield pd.DataFrame({"key": key.view(np.int64), "fp": who.view(np.int64), "centre": np.arange(len(key)) < len(fp)})
    return run


def crowded(own: DataFrame, radius: int, crowd: int) -> DataFrame:
    """key: values of a half (its number above) that, with those within half the radius around, more than crowd fingerprints have.

    A value is around 1 + 32 others at radius 3, so only values of more than crowd / 33 fingerprints can add up to that where they
    count: those are few (33 n / crowd at most), and each names its neighbours. Values left out add less than crowd in all.
    """
    flips = [0, *_flips(radius // 2).tolist()]
    halves = own.select(F.explode(F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))).alias("value"))
    many = halves.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd // len(flips))
    around = many.select("n", F.explode(F.array(*[F.col("value").bitwiseXOR(F.lit(m)) for m in flips])).alias("key"))
    return around.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > crowd).select("key")


def _again(radius: int):
    """Rows of crowded keys, dealt by the quarters of the other half: a key of its own for each value within half the radius."""
    flips = _flips(radius // 2, 16)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 4096):
                key = b["key"].to_numpy(np.int64)[i:i + 4096].view(np.uint64)
                fp = b["fp"].to_numpy(np.int64)[i:i + 4096].view(np.uint64)
                centre = b["centre"].to_numpy(bool)[i:i + 4096]
                other = np.where(key >> np.uint64(32) & np.uint64(1), fp, fp >> np.uint64(32))
                for quarter in (0, 1):
                    value = other >> np.uint64(16 * quarter) & np.uint64(0xFFFF)
                    # the key before, the quarter's number and its value; bit 62 tells such keys from those of a half
                    deal = lambda k, v: np.uint64(1 << 62) | k << np.uint64(17) | np.uint64(quarter << 16) | v  # noqa: B023, E731
                    keys = np.concatenate([deal(key, value), deal(key[:, None], value[:, None] ^ flips).ravel()])
                    whose = np.concatenate([fp, np.repeat(fp, len(flips))])
                    yield pd.DataFrame({"key": keys.view(np.int64), "fp": whose.view(np.int64), "centre": np.r_[centre, np.zeros(len(keys) - len(fp), bool)]})
    return run


def _forest(centres: np.ndarray, around: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever is within radius between centres and (centres and around), as a spanning forest."""
    every = np.concatenate([centres, around])
    group = np.arange(len(every))
    links = []
    for i in range(0, len(centres), BLOCK):
        for j in range(0, len(every), BLOCK):
            near = np.bitwise_count(every[i:min(i + BLOCK, len(centres)), None] ^ every[None, j:j + BLOCK]) <= radius
            for r in np.flatnonzero(near.sum(1) > (i <= j < i + BLOCK or j <= i < j + BLOCK)).tolist():
                x, there = i + r, j + np.flatnonzero(near[r])
                found, at = np.unique(group[there], return_index=True)
                for g, y in zip(found.tolist(), there[at].tolist(), strict=True):
                    if g != group[x]:
                        links.append((int(every[x]), int(every[y])))
                        group[group == g] = group[x]
    return links


def _verify(radius: int):
    """Sorted rows of (key, fp, centre), a partition at a time: links within radius."""
    def links(key: np.ndarray, fp: np.ndarray, centre: np.ndarray) -> pd.DataFrame:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        n_centre = np.add.reduceat(centre.astype(np.int64), start) if len(start) else size
        out: list[tuple[int, int]] = []
        two = start[(size == 2) & (n_centre >= 1)]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a ^ b) <= radius
        out += zip(a[near].tolist(), b[near].tolist(), strict=True)
        for s, n in zip(*(x[(size > 2) & (n_centre >= 1)].tolist() for x in (start, size)), strict=True):
            is_c = centre[s:s + n]
            out += _forest(fp[s:s + n][is_c], fp[s:s + n][~is_c], radius)
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"fa": pairs[:, 0], "fb": pairs[:, 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            key = held["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            if last:
                h = held.iloc[:last]
                yield links(key[:last], h["fp"].to_numpy(np.int64).view(np.uint64), h["centre"].to_numpy())
                held = held.iloc[last:]
        if held is not None and len(held):
            yield links(held["key"].to_numpy(), held["fp"].to_numpy(np.int64).view(np.uint64), held["centre"].to_numpy())
    return run


def near_links(fps: DataFrame, radius: int = 3, crowd: int = CROWD) -> DataFrame:
    """Links (fa, fb) between distinct fingerprints (column fp) that connect all within radius."""
    fields = "key long, fp long, centre boolean"
    variants = fps.select("fp").mapInPandas(_emit(radius), fields)
    hot = cut(crowded(fps, radius, crowd))
    if not hot.isEmpty():
        hot = small(hot.select(F.col("key").alias("k")))
        at = F.col("key") == F.col("k")
        variants = variants.join(hot, at, "left_anti").unionByName(variants.join(hot, at, "left_semi").mapInPandas(_again(radius), fields))
    # even values meet in ranges of a hash; a partition is sorted by Spark, which spills
    return variants.repartition(F.col("key")).sortWithinPartitions("key").mapInPandas(_verify(radius), "fa long, fb long")


def groups(rows: DataFrame, radius: int = 3) -> DataFrame:
    """group and first_id for each distinct fingerprint (column fp) of rows with an id: the group is the least fingerprint it can reach."""
    own = cut(rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = components(cut(near_links(own, radius).distinct()).select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    return cut(own.join(comp, F.col("fp") == F.col("vertex"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("group")))


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    rows = cut(fingerprints(docs, size, seed))
    g = groups(rows, radius)
    least = g.groupBy(F.col("group").alias("g")).agg(F.min("first_id").alias("c"))
    named = g.join(least, F.col("group") == F.col("g")).select(F.col("fp").alias("f"), "c")
    # one row for each distinct fingerprint on the right: a fingerprint of very many copies is split on the left
    return rows.join(named, F.col("fp") == F.col("f"), "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, seed: int = 42) -> DataFrame:
    """docs with one document of each group, that of the smallest doc_id (of equal ids, the least hash of the text); rows without an id stay.

    Rows of one doc_id but of texts in different groups are different documents and all stay; rows of one id and text are copies.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = cut(fingerprints(docs.withColumn("_t", text), size, seed, ["_t"]))
    g = groups(rows, radius).select(F.col("fp").alias("f"), "group")
    # of a fingerprint first its own least row, so that a fingerprint of very many copies is summed in part before it is shuffled
    first = rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("doc_id", "_t")).alias("r")).join(g, F.col("fp") == F.col("f"))
    keep = first.groupBy("group").agg(F.min("r").alias("r")).select(F.col("r.doc_id").alias("keep_id"), F.col("r._t").alias("keep_text")).distinct()
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("t"))
    one = row.filter("id IS NOT NULL").join(keep, (F.col("id") == F.col("keep_id")) & (F.col("t") == F.col("keep_text")), "left_semi").dropDuplicates(["id", "t"]).select("row.*")
    return one.unionByName(row.filter("id IS NULL").select("row.*"))
