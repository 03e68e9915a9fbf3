"""Selection among the differences a - b of two columns of numbers, without forming them.

Blocks of both columns prove an interval in which the wanted difference lies. Both are then dealt once into strips of b, each
with the values of a that differ from its own by a difference in the interval; where a falls below a whole strip, its rows alone
count. A round counts the differences up to several cuts in every strip, by bisection in sorted numbers, and keeps the interval
between two cuts that holds the wanted place. Cuts lie close around differences sampled in the strips, so that ties end the
search, and at equal distances. When few differences are left between the cuts, or only equal ones but for rounding, they are formed, strip by strip, and
ordered. Values are used as they are: a difference is compared by the same rounded sum b + cut wherever it is counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import RANGES, edges, held, prefix_sums

#: Blocks of the first interval to a side, rows of b in a strip, differences that are formed at last, and about as many samples a round.
BLOCKS, STRIP, FEW, SAMPLES = 512, 5_000, 200_000, 4096


def counted(df: DataFrame, value: Column) -> DataFrame:
    """v, n: distinct values and their rows, nulls left out."""
    return held(df.select(value.cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")))


class Strips:
    """a and b dealt for differences between low and high."""

    def __init__(self, a: DataFrame, b: DataFrame, low: float, high: float, unit: float, own: bool) -> None:
        self.a, self.own = a, own
        cuts = np.array(edges(b, "v", min(RANGES, b.count() // STRIP + 1)), float)
        self.samples = SAMPLES // (len(cuts) + 1) + 1
        self.table = held(_dealt(a, cuts, low - 8 * unit, high + 8 * unit).union(_dealt(b, cuts)).repartition("strip"))

    def upto(self, cuts: list[float]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """For each cut, in ascending order, the pairs with a <= b + cut, and differences sampled between the first and last cut, with their weights.

        own counts unordered pairs of a with itself instead (b is -a), each value with itself as well.
        """
        samples = self.samples

        def count(key, table):
            (a, ka, last), (b, kb) = _sides(table)
            below = np.concatenate([[0], np.cumsum(ka)])
            at = [np.searchsorted(a, b + t, "right") for t in cuts]
            wide = at[-1] - at[0]
            upto, sample = np.cumsum(wide), []
            if len(wide) and upto[-1] > 0:
                pick = np.random.default_rng(key[0].as_py()).integers(0, upto[-1], samples)
                row = np.searchsorted(upto, pick, "right")
                sample = (a[at[0][row] + pick - (upto[row] - wide[row])] - b[row]).tolist()
            # whole numbers, as sums of pairs have up to 2^63
            return pa.table({"strip": [key[0].as_py()], "last": [int(ka[last].sum())], "b": [int(kb.sum())], "upto": [[int((kb * below[i]).sum()) for i in at]], "sample": [sample]}, schema=shape)

        shape = pa.schema([("strip", pa.int32()), ("last", pa.int64()), ("b", pa.int64()), ("upto", pa.list_(pa.int64())), ("sample", pa.list_(pa.float64()))])
        rows = sorted(self.table.groupBy("strip").applyInArrow(count, "strip int, last long, b long, upto array<long>, sample array<double>").collect())  # a row a strip
        got, before, sample, weight = [0] * len(cuts), 0, [], []
        for _, last, b, upto, drawn in rows:
            got = [x + y + before * b for x, y in zip(got, upto, strict=True)]
            before += last
            sample += drawn
            weight += [(upto[-1] - upto[0]) / max(1, len(drawn))] * len(drawn)
        if self.own:
            alone = self.a.agg(*[F.coalesce(F.sum(F.when(F.col("v") <= -F.col("v") + F.lit(t), F.col("n"))), F.lit(0)) for t in cuts]).first()
            got = [(x + int(y)) // 2 for x, y in zip(got, alone, strict=True)]
        return got, np.array(sample), np.array(weight)

    def formed(self, low: float, high: float) -> DataFrame:
        """d, upto: the differences with b + low < a <= b + high, and how many of these lie at or below each."""
        own = self.own

        def form(_, table):
            (a, ka, _), (b, kb) = _sides(table)
            first, size = np.searchsorted(a, b + low, "right"), 0
            size = np.searchsorted(a, b + high, "right") - first
            j = np.repeat(np.arange(len(b)), size)
            i = np.repeat(first, size) + np.arange(len(j)) - np.repeat(np.cumsum(size) - size, size)
            x, y, n = a[i], b[j], ka[i] * kb[j]
            if own:  # each unordered pair once: of two values the one with the smaller first, of a value its rows with each other
                n, keep = np.where(x == -y, ka[i] * (ka[i] + 1) // 2, n), x <= -y
                x, y, n = x[keep], y[keep], n[keep]
            return pa.table({"d": x - y, "n": n.astype(np.int64)})

        pairs = self.table.groupBy("strip").applyInArrow(form, "d double, n long")
        s = prefix_sums(pairs, [], "d", {"n": F.col("n")})
        return s.select("d", (F.col("n_before") + F.col("n")).alias("upto"))


def _dealt(t: DataFrame, cuts: np.ndarray, low: float | None = None, high: float | None = None) -> DataFrame:
    """strip, side, v, n: b (side 0) by its own value, a by all values of b that differ from it by low to high, side 2 in the last of these strips and 1 before."""
    def deal(batches):
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            if low is None:
                last = np.searchsorted(cuts, v)
                yield pa.RecordBatch.from_arrays([pa.array(last.astype(np.int32)), pa.array(np.zeros(len(v), np.int32)), *batch.columns], ["strip", "side", "v", "n"])
                continue
            first, last = np.searchsorted(cuts, v - high), np.searchsorted(cuts, v - low)
            size = last - first + 1
            row = np.repeat(np.arange(len(v)), size)
            strip = np.repeat(first, size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            took = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(strip.astype(np.int32)), pa.array(np.where(strip == last[row], 2, 1).astype(np.int32)), *took.columns], ["strip", "side", "v", "n"])

    return t.select("v", "n").mapInArrow(deal, "strip int, side int, v double, n long")


def _sides(table: pa.Table) -> tuple:
    """Values of a in ascending order, their rows and whether the strip is their last; values of b and their rows."""
    side, v, n = (table.column(k).to_numpy() for k in ("side", "v", "n"))
    order = np.argsort(v, kind="stable")
    side, v, n = side[order], v[order], n[order]
    own = side > 0
    return (v[own], n[own], side[own] == 2), (v[~own], n[~own])


def _blocks(a: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """least, largest value and rows of blocks of about as many rows each."""
    n = a.agg(F.sum("n")).first()[0]
    s = prefix_sums(a, [], "v", {"n": F.col("n")})
    block = F.least(F.floor(F.col("n_before") * BLOCKS / F.lit(n)), F.lit(BLOCKS - 1))
    rows = s.groupBy(block.alias("k")).agg(F.min("v"), F.max("v"), F.sum("n")).collect()
    return tuple(np.array([r[i] for r in rows], float) for i in (1, 2, 3))


def _bounds(a: DataFrame, b: DataFrame, place: int, own: bool) -> tuple[float, float]:
    """An interval that holds the difference at place, from the blocks' least and largest differences."""
    (a_low, a_high, a_n), (b_low, b_high, b_n) = _blocks(a), _blocks(b)
    pairs, low, high = np.outer(a_n, b_n).ravel(), np.subtract.outer(a_low, b_high).ravel(), np.subtract.outer(a_high, b_low).ravel()
    wanted = 2 * place if own else place  # of ordered pairs; values with themselves move it by less than their number
    slack = float(a_n.sum()) if own else 0.0

    def reached(x: np.ndarray, least: float) -> float:
        order = np.argsort(x, kind="stable")
        return float(x[order][min(np.searchsorted(np.cumsum(pairs[order]), least), len(x) - 1)])

    return reached(low, max(wanted - slack, 1) * (1 - 1e-12)), reached(high, min(wanted * (1 + 1e-12), pairs.sum()))


def _cuts(low: float, high: float, unit: float, share: float, sample: np.ndarray, weight: np.ndarray) -> list[float]:
    """Where to count next between low and high: at equal distances, and closely around sampled differences near the wanted share."""
    at = {low + (high - low) * k / 6 for k in range(1, 6)}
    if len(sample):
        order = np.argsort(sample)
        upto = np.cumsum(weight[order]) / weight.sum()
        for off in (-4, -1, 0, 1, 4):
            d = sample[order[min(np.searchsorted(upto, share + off * 0.5 / len(sample) ** 0.5), len(sample) - 1)]]
            at |= {float(d) - 16 * unit, float(d) + 16 * unit}
    return sorted(t for t in at if low < t < high)


def place_among(a: DataFrame, b: DataFrame, place: int, own: bool = False) -> float:
    """The difference at place, from 1, of all a - b in ascending order; a and b are counted values."""
    low, high = _bounds(a, b, place, own)
    unit = max(abs(low), abs(high), *[abs(x) for t in (a, b) for x in t.agg(F.min("v"), F.max("v")).first()]) * 2.0**-48
    low, high = low - 4 * unit, high + 4 * unit
    # a margin, so that no difference is so near an end that rounding could move it across
    margin = 8 * unit
    strips = Strips(a, b, low - margin, high + margin, unit, own)
    (below, until), sample, weight = strips.upto([low, high])
    while until - below > FEW and high - low > 64 * unit:
        cuts = _cuts(low, high, unit, (place - below) / (until - below), sample, weight)
        ends = [low, *cuts, high]
        n, sample, weight = strips.upto(ends)
        k = next(i for i in range(1, len(n)) if n[i] >= place)
        low, high, below, until = ends[k - 1], ends[k], n[k - 1], n[k]
        inside = (sample > low) & (sample <= high)
        sample, weight = sample[inside], weight[inside]
    low, high = low - margin, high + margin
    below = strips.upto([low])[0][0]
    return float(strips.formed(low, high).agg(F.min(F.when(F.col("upto") >= place - below, F.col("d")))).first()[0])


def median_difference(a: DataFrame, b: DataFrame) -> tuple[float | None, int]:
    """The (lower) median of all a - b of counted values, and how many there are."""
    total = (a.agg(F.sum("n")).first()[0] or 0) * (b.agg(F.sum("n")).first()[0] or 0)
    return (place_among(a, b, (total + 1) // 2), total) if total else (None, 0)


def median_average(a: DataFrame) -> tuple[float | None, int]:
    """The (lower) median of the averages of all pairs of a's rows, each row with itself as well, and how many there are."""
    m = a.agg(F.sum("n")).first()[0] or 0
    total = m * (m + 1) // 2
    if not total:
        return None, 0
    return place_among(a, held(a.select((-F.col("v")).alias("v"), "n")), (total + 1) // 2, own=True) / 2, total
