"""Pack token sequences into as few bins as it can, by a grouping genetic algorithm on islands.

Documents are tokenized once; what is longer than a bin is cut, full pieces are bins of their own. The rest is
dealt by hash into shards of a bounded number of pieces. A shard is searched by several islands, each a task:
an island holds a few solutions, made by best fit in different orders. Crossover takes whole well-filled bins
of one parent into the other, removes the bins that hold a copied piece, and puts the displaced pieces back by best fit,
largest first. After each epoch the best solution of an island moves to the next one. A shard is done at once when its bins are as few
as the sum of its pieces asks. What lies in the worst bins of all shards is packed once more in fewer shards, and so on down
to one, so that half-empty last bins do not add up.

Seeds come from shard and island, and pieces are ordered by their own values, so a lost task repeats its result.

Nulls and ties: a null text is empty, one token (the end mark) long; a null doc_id is packed like any other;
repeated rows are pieces of their own. Equal pieces are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Odd words, and letters of words, whose ids a Python worker keeps in each of two generations.
CACHE_WORDS, CACHE_LETTERS = 250_000, 300_000
#: Bytes of texts whose words are told apart at once; a longer text is taken alone.
CHUNK = 8 << 20
#: A word of Latin letters with marks behind: parts that the tokenizer looks at one by one. An apostrophe may start an ending, so it is no mark.
LETTERS = "".join(chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7))
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class Recent(dict):
    """Values made when first asked for. When full, all become the older generation, from which those asked for again return."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


class WordIds(Recent):
    """Little-endian uint32 ids of white-space separated words; the tokenizer never joins what ASCII white space parts.

    The distinct words of many texts are told apart in Arrow. Capitals and marks make many words of the same letters, so
    Python is asked for distinct letters and distinct marks only, and for odd words, which are those of other make.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(self._word, CACHE_WORDS)
        self.letters = Recent(self._letters, CACHE_LETTERS)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.bytes_to_text = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _letters(self, low: str) -> bytes:
        if not low:
            return b""
        if not low.isascii():
            low = "".join(map(self.bytes_to_text.__getitem__, low.encode()))
        ids = [t.id for t in self.model.tokenize(low)]  # without the costly wrapper
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def _asked(cache: Recent, keys: pa.Array) -> pa.Array:
        return pa.array(list(map(cache.__getitem__, keys.to_numpy(zero_copy_only=False))), pa.large_binary())

    def words(self, words: pa.Array) -> pa.Array:
        """The ids of each of these words."""
        # what is left of the marks behind, and of the letters before: together the word, if it has nothing else
        body, marks = pc.ascii_rtrim(words, MARKS), pc.utf8_ltrim(words, LETTERS)
        odd = pc.not_equal(pc.add(pc.binary_length(body), pc.binary_length(marks)), pc.binary_length(words))
        halves = []
        for half in (pc.utf8_lower(body), marks):
            d = pc.if_else(odd, "", half).dictionary_encode()
            halves.append(self._asked(self.letters, d.dictionary).take(d.indices))
        plain = pc.binary_join_element_wise(*halves, pa.scalar(b"", pa.large_binary()))
        return pc.replace_with_mask(plain, odd, self._asked(self, words.filter(odd)))

    def texts(self, texts: pa.Array, end: int = 0) -> Iterator[bytes]:
        """The ids of each of these texts, and the end mark."""
        texts, mark = pc.fill_null(texts, ""), end.to_bytes(4, "little")
        chunk = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            lists = pc.ascii_split_whitespace(texts.slice(a, b - a))
            found = lists.flatten().dictionary_encode()
            ids = self.words(found.dictionary).take(found.indices)
            _, starts, data = ids.buffers()
            starts = np.frombuffer(starts, np.int64)[lists.offsets.to_numpy()].tolist()
            data = memoryview(data or b"")
            for s, e in zip(starts, starts[1:]):
                yield bytes(data[s:e]) + mark


_IDS: dict[str, WordIds] = {}


def document_ids(text: str | None, ids: WordIds, end: int = 0) -> bytes:
    return next(ids.texts(pa.array([(text or "").encode("utf-8", "replace").decode()]), end))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema([(x.split()[0], t) for x, t in zip(PIECES.split(", "), types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _IDS:
            _IDS[tokenizer] = WordIds(tokenizer)
        ids = _IDS[tokenizer]
        for b in batches:
            out = []
            for doc, all_ids in zip(b.column("doc_id").to_pylist(), ids.texts(b.column("text"), end), strict=True):
                n = len(all_ids) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    part = all_ids[4 * s:4 * (s + capacity)]
                    out.append((doc, k, s, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class Bins:
    """Open bins by free room, for best fit: the fullest bin that still takes a piece."""

    def __init__(self, capacity: int, room: list[int] | None = None):
        self.capacity, self.room = capacity, list(room or [])
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0
        for b, r in enumerate(self.room):
            if r:
                self.by_room.setdefault(r, []).append(b)
                self.mask |= 1 << r

    def put(self, size: int) -> int:
        fits = self.mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            open_ = self.by_room[r]
            b = open_.pop()
            if not open_:
                self.mask ^= 1 << r
        else:
            b, r = len(self.room), self.capacity
            self.room.append(r)
        left = r - size
        self.room[b] = left
        if left:
            self.by_room.setdefault(left, []).append(b)
            self.mask |= 1 << left
        return b


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins = Bins(capacity)
    at = np.empty(len(sizes), np.int64)
    put = bins.put
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        at[i] = put(s)
    return at


def cross(keep: np.ndarray, give: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of two solutions: some of give's fullest bins whole, keep's bins where untouched, the rest by best fit."""
    fill = np.bincount(give, sizes)
    good = np.flatnonzero(fill >= capacity * 0.995)
    if not len(good):
        good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, len(good) // 2), replace=False)] = True
    moved = chosen[give]
    touched = np.zeros(int(keep.max()) + 1, bool)
    touched[keep[moved]] = True
    # of the untouched, the worst filled are opened as well
    own = np.bincount(keep, sizes, minlength=len(touched))
    touched |= own < capacity * 0.97
    stay = ~moved & ~touched[keep]
    child = np.full(len(sizes), -1, np.int64)
    _, child[moved] = np.unique(give[moved], return_inverse=True)
    n = int(child.max()) + 1
    if stay.any():
        _, at = np.unique(keep[stay], return_inverse=True)
        child[stay] = at + n
    loose = np.flatnonzero(child < 0)
    placed = child >= 0
    bins = Bins(capacity, (capacity - np.bincount(child[placed], sizes[placed])).astype(int).tolist())
    loose = loose[np.lexsort((rng.random(len(loose)), -sizes[loose]))]
    for i, s in zip(loose.tolist(), sizes[loose].tolist(), strict=True):
        child[i] = bins.put(s)
    return child


def fitness(at: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fill = np.bincount(at, sizes) / capacity
    return -len(fill), float((fill ** 2).sum())


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], population: int = 8, generations: int = 80, patience: int = 30) -> np.ndarray:
    """The best solution after so many crossovers, or when patience of them in a row gave no better one, or at once where a solution has as few bins as the pieces' sum asks."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    pool = [*elites]
    while len(pool) < population:
        noise = rng.random(len(sizes)) * (0 if not pool else capacity / 16)
        pool.append(best_fit(sizes, np.argsort(-sizes - noise, kind="stable"), capacity))
        if -fitness(pool[-1], sizes, capacity)[0] <= least:
            return pool[-1]
    score = [fitness(x, sizes, capacity) for x in pool]
    since = 0
    for _ in range(generations):
        if -max(score)[0] <= least or since >= patience:
            break
        a, b = rng.permutation(len(pool))[:2]
        child = cross(pool[a], pool[b], sizes, capacity, rng)
        worst = min(range(len(pool)), key=score.__getitem__)
        s = fitness(child, sizes, capacity)
        since = 0 if s > max(score) else since + 1
        if s > score[worst]:
            pool[worst], score[worst] = child, s
    return pool[max(range(len(pool)), key=score.__getitem__)]


STATE = "shard long, island int, solution binary, bins long, filled double"
ITEM = ["length", "doc_id", "piece", "start", "ids_crc32"]


def _ordered(p: pd.DataFrame) -> pd.DataFrame:
    return p.sort_values(ITEM, ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)


def _search(loose: DataFrame, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """shard and the best solution of its islands: bin numbers by the order of _ordered."""
    def epoch(number: int):
        def run(key: tuple, items: pd.DataFrame, migrants: pd.DataFrame) -> pd.DataFrame:
            if not len(items):
                return pd.DataFrame(columns=["shard", "island", "solution", "bins", "filled"])
            sizes = _ordered(items)["length"].to_numpy()
            shard, island = int(key[0]), int(key[1])
            elites = [np.frombuffer(x, "<i4").astype(np.int64) for x in migrants["solution"]]
            best = evolve(sizes, capacity, hash((seed, shard, island, number)) & 0xFFFFFFFF, elites)
            n, filled = fitness(best, sizes, capacity)
            return pd.DataFrame({"shard": [shard], "island": [island], "solution": [best.astype("<i4").tobytes()], "bins": [-n], "filled": [filled]})
        return run

    spark = loose.sparkSession
    copies = loose.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = spark.createDataFrame([], STATE)
    for e in range(epochs):
        # its own best and that of the island before
        next_ = state.select("shard", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)))).alias("island"), "solution")
        state = cut(copies.groupBy("shard", "island").cogroup(next_.groupBy("shard", "island")).applyInPandas(epoch(e), STATE))
    rank = Window.partitionBy("shard").orderBy("bins", F.desc("filled"), "island")
    return state.withColumn("r", F.row_number().over(rank)).filter("r = 1").select("shard", "solution")


def _place(loose: DataFrame, best: DataFrame) -> DataFrame:
    """The pieces with the number of their bin, their place in it, and what the bin holds."""
    out = "shard long, bin long, offset long, filled long, length long, doc_id long, piece int, start long, ids_crc32 long" + (", row long" if "row" in loose.columns else "")

    def run(key: tuple, items: pd.DataFrame, solution: pd.DataFrame) -> pd.DataFrame:
        p = _ordered(items)
        p["bin"] = np.frombuffer(solution["solution"].iloc[0], "<i4").astype(np.int64)
        by = p.groupby("bin")["length"]
        p["offset"], p["filled"] = by.cumsum() - p["length"], by.transform("sum")
        p["doc_id"] = p["doc_id"].astype("Int64")
        return p[[x.split()[0] for x in out.split(", ")]]

    return loose.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(run, out)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, shard_pieces: int = 12_000, islands: int = 2, epochs: int = 2, reopen: float = 0.995, seed: int = 7) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    # a number for each piece, fixed by the write, so that equal rows without an id of their own are spread as well
    every = cut(pieces(docs, tokenizer, capacity, end).withColumn("row", F.monotonically_increasing_id()))
    cols = [F.col(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
    whole = every.filter(F.col("length") == capacity)
    loose = every.filter(F.col("length") < capacity)
    n = loose.count()
    key = F.xxhash64("doc_id", "piece", "ids_crc32", "row", F.lit(seed))
    rounds, left, level = [], loose, 0
    while True:
        shards = max(1, -(-n // shard_pieces))
        dealt = left.withColumn("shard", F.pmod(key, F.lit(shards)))
        placed = cut(_place(dealt, _search(dealt, capacity, islands, epochs, seed + level)))
        again = F.lit(False)
        if shards > 1:
            again = F.col("filled") < reopen * capacity
            m = placed.filter(again).count()
            if 2 * m > n:  # the lengths leave most bins so: only bins half empty, about one a shard, can be joined
                again = 2 * F.col("filled") <= capacity
                m = placed.filter(again).count()
        rounds.append(placed.filter(~again).select(*cols, F.struct(F.lit(level).cast("long").alias("level"), "shard", "bin").alias("b"), "offset"))
        if shards == 1 or m == 0:
            break
        left, n, level = placed.filter(again).select(*cols, "row"), m, level + 1
    packed = rounds[0]
    for r in rounds[1:]:
        packed = packed.union(r)
    # numbers of bins: level, shard and bin side by side; whole pieces number themselves below zero
    number = F.col("b.level") * F.lit(1 << 56) + F.col("b.shard") * F.lit(1 << 24) + F.col("b.bin")
    whole = whole.select(*cols, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.select(*cols, number.cast("long").alias("sequence_id"), "offset").union(whole)
