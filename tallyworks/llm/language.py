"""Language of a text by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for each piece of the vocabulary. A word's probability is the sum, over all ways to spell
it with pieces, of the product of theirs: a forward algorithm over the word's letters. A text's is the product over its words,
and the language whose product with its prior is greatest is predicted; the score is that language's share of all products.

Learning: expected counts of pieces from forward and backward sums over the words of labelled documents, starting from
equal probabilities, `passes` times. Bound: about max_docs documents of each language, by a hash of id and text, distinct texts
among them; all of a language that has fewer. Priors are counted over all labelled documents. A piece's probability is drawn towards its
mean over the languages by as many counts as the language has different pieces, and that mean towards an equal one. What
reaches the driver is a number for each language and piece of the vocabulary; more than max_languages values of lang raise a ValueError.

A word is a run of letters (and marks on them), in lower case. A letter that the vocabulary lacks is spelled by its UTF-8 bytes. Many
words are summed at once, in arrays over the words of a block; long ones are scaled on the way, so that no sum is lost. In learning,
words longer than 48 letters are taken in stretches of 48; scoring takes them whole.

Nulls: a null text, or one without a letter, is `und` with score 0. A null lang, or a null doc_id, is not learned from;
a null doc_id is not held out. Without any labelled text every text is `und`. Ties go to the alphabetically first
language. Repeated rows are predicted alike. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

SPACE = "\u2581"
STRETCH = 48
#: Words and letters of a block, and words that a worker keeps.
BLOCK, CELLS, KEPT = 8192, 1 << 20, 400_000
STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def word_pattern() -> re.Pattern:
    """A letter, then letters and marks, by their Unicode categories."""
    def spans(kinds: str) -> str:
        known = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in kinds]
        first = [c for p, c in zip([-2, *known], known, strict=False) if c != p + 1]
        last = [c for c, n in zip(known, [*known[1:], -2], strict=True) if n != c + 1]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last, strict=True))

    return re.compile(f"[{spans('L')}][{spans('LM')}]*")


@lru_cache(2)
def vocabulary(path: str) -> list[str]:
    """Pieces by id; those of a byte are named <0xHH>."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) if not (model.is_control(i) or model.is_unknown(i)) else "" for i in range(model.get_piece_size())]


class Lattice:
    """Which pieces spell which parts of words, by rolling hashes of their letters."""

    def __init__(self, pieces: list[str]) -> None:
        self.size = len(pieces)
        self.bytes_of = {int(p[3:5], 16): i for i, p in enumerate(pieces) if re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
        own = {p: i for i, p in enumerate(pieces) if p and i not in self.bytes_of.values()}
        self.own, self.longest = own, max(map(len, own))
        self.power = np.array([pow(int(STEP), n, 2**64) for n in range(self.longest + 1)], np.uint64)
        hashes = np.array([self.hash_of(p) for p in own], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(own.values()), np.int32)[order]
        assert (np.diff(self.hashes.astype(object)) > 0).all(), "pieces share a hash"

    def hash_of(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(STEP) + self.letter(ord(c))) % 2**64
        return h

    @staticmethod
    def letter(code: int) -> int:
        return (code + 1) * 0xD6E8FEB86659FD93 % 2**64

    def prefixes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first 0, 1, ... letters of each word, as columns, and the words' letters."""
        width = max(map(len, words))
        letters = np.zeros((len(words), width), np.uint32)
        for n in {len(w) for w in words}:
            at = [i for i, w in enumerate(words) if len(w) == n]
            letters[at, :n] = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
        with np.errstate(over="ignore"):
            own = (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            out = np.zeros((width + 1, len(words)), np.uint64)
            for j in range(width):
                out[j + 1] = out[j] * STEP + own[:, j]
        return out, letters

    def found(self, prefixes: np.ndarray, i: int, j: int) -> np.ndarray:
        """Id of the piece that is letters i to j of each word, or size where there is none."""
        with np.errstate(over="ignore"):
            h = prefixes[j] - prefixes[i] * self.power[j - i]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], self.size)

    def spelled(self, code: int) -> list[int]:
        """Ids of the bytes of a letter without a piece of its own."""
        return [self.bytes_of[b] for b in chr(code).encode("utf-8", "surrogatepass") if b in self.bytes_of]


@lru_cache(2)
def lattice(path: str) -> Lattice:
    return Lattice(vocabulary(path))


def blocks(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words in blocks of like lengths, shortest first, of a bounded number of letters."""
    sizes = np.array([len(w) for w in words])
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        n = BLOCK
        while n > 1 and n * sizes[order[min(at + n, len(order)) - 1]] > CELLS:
            n //= 2
        yield order[at:at + n]
        at += n


def forward(lat: Lattice, words: list[str], table: np.ndarray) -> np.ndarray:
    """Log probability of each word (which starts with its space) by each column of table, a probability for each piece."""
    out = np.empty((len(words), table.shape[1]))
    full = np.vstack([table, np.zeros(table.shape[1])])
    for part in blocks(words):
        own = [words[i] for i in part]
        prefixes, letters = lat.prefixes(own)
        ends = np.array([len(w) for w in own])
        sums, logs = [np.ones((len(own), table.shape[1]))], np.zeros((len(own), table.shape[1]))
        for j in range(1, len(prefixes)):
            now = np.zeros_like(logs)
            for back in range(1, min(j, lat.longest) + 1):
                ids = lat.found(prefixes, j - back, j)
                if back == 1:
                    now += sums[-1] * full[ids]
                    lack = np.flatnonzero((ids == lat.size) & (ends >= j))
                    for code in set(letters[lack, j - 1].tolist()):
                        at = lack[letters[lack, j - 1] == code]
                        now[at] += sums[-1][at] * np.prod(table[lat.spelled(code)], axis=0)
                else:
                    some = np.flatnonzero(ids < lat.size)
                    now[some] += sums[-back][some] * full[ids[some]]
            sums = [*sums[-lat.longest + 1:], now]
            live = ends >= j
            if j % 8 == 0:
                scale = np.where(live[:, None], now, 1)
                sums, logs = [s / scale for s in sums], logs + np.log(scale)
            done = ends == j
            out[part[done]] = np.log(sums[-1][done]) + logs[done]
    return out


def expected(lat: Lattice, words: list[str], column: np.ndarray, weight: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words, weighted, each by its column of table; as a table."""
    out = np.zeros((lat.size + 1) * table.shape[1])
    full = np.vstack([table, np.zeros(table.shape[1])])
    width = table.shape[1]
    for part in blocks(words):
        own, col, w = [words[i] for i in part], column[part], weight[part]
        prefixes, letters = lat.prefixes(own)
        ends, n = np.array([len(x) for x in own]), len(prefixes) - 1
        up, edges = np.zeros((n + 1, len(own))), []
        up[0] = 1
        for j in range(1, n + 1):
            for i in range(max(0, j - lat.longest), j):
                ids = lat.found(prefixes, i, j)
                some = np.flatnonzero((ids < lat.size) & (ends >= j))
                if len(some):
                    p = full[ids[some], col[some]]
                    edges.append((i, j, some, [ids[some]], p))
                    up[j, some] += up[i, some] * p
                if i == j - 1:
                    lack = np.flatnonzero((ids == lat.size) & (ends >= j))
                    for code in set(letters[lack, j - 1].tolist()):
                        at, spelled = lack[letters[lack, j - 1] == code], lat.spelled(code)
                        p = np.prod(table[spelled], axis=0)[col[at]]
                        edges.append((i, j, at, [np.full(len(at), s) for s in spelled], p))
                        up[j, at] += up[i, at] * p
        down = np.zeros_like(up)
        down[ends, np.arange(len(own))] = w / up[ends, np.arange(len(own))]
        for i, j, some, ids, p in reversed(edges):
            down[i, some] += down[j, some] * p
        for i, j, some, ids, p in edges:
            share = up[i, some] * p * down[j, some]
            for x in ids:
                out += np.bincount(x * width + col[some], share, len(out))
    return out.reshape(-1, width)[:-1]


@dataclass
class Model:
    path: str
    languages: list[str] = field(default_factory=list)
    prior: np.ndarray = field(default_factory=lambda: np.empty(0))
    table: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities from counts of pieces by language (columns)."""
    kinds = np.maximum((counts > 1e-9).sum(0), 1)
    mean = (counts / np.maximum(counts.sum(0), 1e-300)).sum(1)
    mean = mean / max(mean.sum(), 1e-300)
    some = max(int((mean > 0).sum()), 1)
    rows = counts.sum()
    mean = (mean * rows + some / len(mean)) / (rows + some)
    return (counts + kinds * mean[:, None]) / (counts.sum(0) + kinds)


def words_of(text: str | None) -> list[str]:
    return word_pattern().findall((text or "").lower())


def stretches(word: str) -> list[str]:
    return [SPACE + word] if len(word) <= STRETCH else [(SPACE if i == 0 else "") + word[i:i + STRETCH] for i in range(0, len(word), STRETCH)]


def learn(labelled: DataFrame, path: str, max_docs: int = 2000, passes: int = 2, max_languages: int = 512) -> Model:
    """A model from doc_id, text, lang; rows of a null text or lang teach nothing."""
    use = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")
    sizes = use.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} values of lang")
    size = {r["lang"]: r["n"] for r in sizes}
    languages = sorted(size)
    model = Model(path, languages, np.log(np.array([size[x] for x in languages], float) / max(sum(size.values()), 1)))
    if not languages:
        return model
    spark = labelled.sparkSession
    share = spark.createDataFrame([(x, i, min(1.0, max_docs / size[x])) for i, x in enumerate(languages)], "of string, at int, share double")
    drawn = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1 << 40)) < F.col("share") * (1 << 40)
    sample = use.join(small(share), F.col("lang") == F.col("of")).filter(drawn).select("at", "text").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, texts in b.groupby("at")["text"]:
                c = Counter(s for t in texts for w in words_of(t) for s in stretches(w))
                yield pd.DataFrame({"at": at, "word": list(c), "n": list(c.values())})

    counted = cut(sample.mapInPandas(count, "at int, word string, n long").groupBy("at", "word").agg(F.sum("n").alias("n")))
    pieces = len(vocabulary(path))
    model.table = np.full((pieces, len(languages)), 1.0 / pieces)

    for _ in range(passes):
        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((pieces, len(languages)))
            for b in batches:
                if len(b):
                    sums += expected(lattice(path), b["word"].tolist(), b["at"].to_numpy(np.int64), b["n"].to_numpy(float), table)
            at = np.nonzero(sums)
            yield pd.DataFrame({"piece": at[0], "at": at[1], "n": sums[at]})

        table = model.table
        found = counted.mapInPandas(expect, "piece int, at int, n double").groupBy("piece", "at").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each piece and language
        counts = np.zeros_like(model.table)
        np.add.at(counts, (found["piece"].to_numpy(np.int64), found["at"].to_numpy(np.int64)), found["n"].to_numpy(float))
        model.table = smoothed(counts)
    return model


class Scorer:
    """Log probabilities of texts by language; keeps those of words met before."""

    def __init__(self, model: Model) -> None:
        self.model, self.codes, self.known = model, {}, np.empty((0, len(model.languages)))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the words of each text, and how many words it has."""
        if len(self.codes) > KEPT:
            self.codes, self.known = {}, self.known[:0]
        codes, before = self.codes, len(self.codes)
        own = [[codes.setdefault(w, len(codes)) for w in words_of(t)] for t in texts]
        new = list(codes)[before:]
        if new:
            self.known = np.vstack([self.known, forward(lattice(self.model.path), [SPACE + w for w in new], self.model.table)])
        out = np.array([self.known[c].sum(0) if c else np.zeros(len(self.model.languages)) for c in own])
        return out, np.array([len(c) for c in own])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs, from the text alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            for lo in range(0, len(b), 256):
                own = b.iloc[lo:lo + 256]
                texts = [t if isinstance(t, str) else None for t in own["text"]]
                if model.languages:
                    z, n = scorer.texts(texts)
                    z = z + model.prior
                    z = np.exp(z - z.max(1, keepdims=True))
                    best, score = z.argmax(1), z.max(1) / z.sum(1)
                    said = [model.languages[i] if k else "und" for i, k in zip(best, n, strict=True)]
                    score = np.where(n > 0, score, 0.0)
                else:
                    said, score = ["und"] * len(own), np.zeros(len(own))
                yield pd.DataFrame({"doc_id": own["doc_id"], "lang_pred": said, "score": score})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column, modulus: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def identify(docs: DataFrame, path: str, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; learned from those that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = learn(rows.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), path, **options)
    return predicted(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
