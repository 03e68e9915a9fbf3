"""Alignment of two tokenizers' tokens over a corpus, by divide and conquer at shared cuts.

Both tokenizers cover the same bytes. An interval of tokens is cut at an end that both share: the ends near its middle are
looked up among the other's by bisection, in rings that double until one is found; both halves are cut again, and an
interval without a shared end inside is a group. All intervals of a height are cut together, in numpy, whatever document
they belong to. A token of one tokenizer is linked with every token of the other in its group.

A chunk is what one task reads until about chunk_mb of text have come. It is written with its documents' groups as digests, the
distinct (A id, B id) pairs of each document as places in the chunk's sorted pairs, and how many of its documents hold each pair. Spark
sums these counts over all chunks, finds each A id's highest, and joins both to the pairs of each chunk, which read their
documents' sums off them. So what is shuffled are a chunk's distinct pairs, not tokens, in proportion to the number of chunks;
a pair that all documents hold is one row a chunk. The texts are never shuffled.

Tokens never cross a space that follows anything but white space: neither tokenizer has a token with such a space inside it, and the patterns of A
end there. So texts are encoded by their pieces between such spaces, each distinct piece once; the tests hold
this against whole texts.

Nulls and empty texts, and texts whose tokens do not spell them again (with U+2581 in them, for one), have no tokens: zeros and ''. Repeated
rows count as documents of their own. A null doc_id is carried. Long texts are cut whole; a group holds its distinct ids times
each other. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .parts import squeeze, unsqueeze

#: Where a text may be cut into pieces, and whether it has places where a plain split at spaces would cut elsewhere.
CUT = re.compile(r"(?<=[^\s\u180e])(?= )")
ODD = re.compile(r"[\s\u180e] ")
#: Pieces on whose characters all pattern engines agree.
PLAIN = re.compile(r"[\x20-\x7e\n\t\u00c0-\u024f]*").fullmatch
#: Pieces that a worker keeps from chunk to chunk.
KEPT = 250_000
#: Links of a group that are written out; above, its distinct ids are counted first.
DIRECT = 256


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file: ids of a piece, and each id's bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = byte_alphabet(), model["vocab"]
        pure = {t: bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for t, b in pure.items():
            self.bytes_of[vocab[t]] = b
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # merges in order of their ids are ranks, which a quicker encoder takes
        self.ranked = None
        if all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            ranks = {pure[t]: i for t, i in vocab.items() if t in pure and i < 256 + len(merges)}
            self.ranked = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, pieces: list[str]) -> list[list[int]]:
        out = [self.ranked.encode_ordinary(p) if self.ranked and PLAIN(p) else None for p in pieces]
        odd = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(odd, self.whole.encode_batch([pieces[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class Pieces:
    """A SentencePiece file that puts a space before each text: ids of a piece that starts with a space, and each id's bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in range(n))]
        self.space = self.model.piece_to_id("\u2581")

    def encode(self, pieces: list[str]) -> list[list[int]]:
        out = self.model.encode([p[1:] for p in pieces], num_threads=1)
        return [ids if p != " " else [self.space] for p, ids in zip(pieces, out, strict=True)]


def pieces(text: str) -> list[str]:
    """Parts of a space and text that both tokenizers encode by themselves, without the space that each starts with."""
    return [p[1:] for p in CUT.split(" " + text)] if ODD.search(text) or text[:1] == " " else text.split(" ")


class Side:
    """Tokens of the pieces met so far, by one tokenizer: ids and lengths, one piece after another."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.lengths = tokenizer, np.array([len(b) for b in tokenizer.bytes_of], np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, new: list[str]) -> np.ndarray:
        """Whether each of new is spelled by its tokens."""
        got, of = self.tokenizer.encode(new), self.tokenizer.bytes_of
        true = np.array([b"".join([of[i] for i in ids]) == p.encode("utf-8", "surrogatepass") for p, ids in zip(new, got, strict=True)], bool)
        count = np.array([len(ids) for ids in got], np.int64)
        flat = np.fromiter((i for ids in got for i in ids), np.int32, int(count.sum()))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, flat])
        return true

    def tokens(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces named by codes, and how many each has."""
        n = self.count[codes]
        return self.ids[ragged(self.start[codes], n)], n


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + n[0] - 1, start[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Both tokenizers behind one table of pieces; a worker keeps it for its later chunks."""

    def __init__(self, a: str, b: str, pattern: str) -> None:
        self.a, self.b = Side(ByteLevel(a, pattern)), Side(Pieces(b))
        self.codes: dict[str, int] = {}
        self.true = np.empty(0, bool)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Codes of the pieces of each text."""
        if len(self.codes) > KEPT:
            self.codes, self.true = {}, np.empty(0, bool)
            self.a.clear()
            self.b.clear()
        known, codes = len(self.codes), self.codes
        out = [np.array([codes.setdefault(p, len(codes)) for p in pieces(t)], np.int64) for t in texts]
        new = list(codes)[known:] if known else list(codes)
        if new:
            new = [" " + p for p in new]
            a = self.a.learn(new)
            self.true = np.concatenate([self.true, a & self.b.learn(new)])
        return out


@lru_cache(2)
def encoder(a: str, b: str, pattern: str) -> Encoder:
    return Encoder(a, b, pattern)


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A and first B token of every group, in order; a_from and b_from are those of the texts, with the totals behind.

    a_end and b_end ascend over all texts, and the ends of a text are shared.
    """
    alo, ahi, blo, bhi = a_from[:-1], a_from[1:], b_from[:-1], b_from[1:]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(alo):
        leaf = (ahi - alo == 1) | (bhi - blo == 1)
        done.append((alo[leaf], blo[leaf]))
        alo, ahi, blo, bhi = (x[~leaf] for x in (alo, ahi, blo, bhi))
        middle, at, other = (alo + ahi - 2) // 2, np.full(len(alo), -1), np.full(len(alo), -1)
        look, near, far = np.arange(len(alo)), 0, 1
        while len(look):
            m, low, high = middle[look], alo[look], ahi[look] - 2
            left, right = np.maximum(low, m - far + 1), np.minimum(high, m + far - 1)
            n_left = np.maximum(0, m - near - left + 1)
            first = np.maximum(m + max(near, 1), low)  # the middle itself is of the left part
            n_right = np.maximum(0, right - first + 1)
            probe = ragged(np.stack([left, first], 1).ravel(), np.stack([n_left, n_right], 1).ravel())
            who = np.repeat(look, n_left + n_right)
            found = np.searchsorted(b_end, a_end[probe])
            hit = b_end[found] == a_end[probe]
            probe, who, found = probe[hit], who[hit], found[hit]
            if far > 1:  # of an interval's shared ends the nearest, the left one of two
                away = np.abs(probe - middle[who]) * 2 + (probe > middle[who])
                whose = np.flatnonzero(np.diff(who, prepend=-1))
                once = np.repeat(np.minimum.reduceat(away, whose), np.diff(whose, append=len(who))) == away if len(who) else slice(0)
                probe, who, found = probe[once], who[once], found[once]
            at[who], other[who] = probe, found
            more = (at[look] < 0) & ((left > low) | (right < high))
            look, near, far = look[more], far, far * 4
        cutless = at < 0
        done.append((alo[cutless], blo[cutless]))
        alo, ahi, blo, bhi, at, other = (x[~cutless] for x in (alo, ahi, blo, bhi, at + 1, other + 1))
        alo, ahi, blo, bhi = (np.stack(x, 1).ravel() for x in ((alo, at), (at, ahi), (blo, other), (other, bhi)))
    a, b = np.concatenate([x for x, _ in done] or [a_from[:0]]), np.concatenate([x for _, x in done] or [b_from[:0]])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


class Alignment:
    """Tokens and groups of a list of texts."""

    def __init__(self, texts: list[str | None], a: str, b: str, pattern: str) -> None:
        enc = encoder(a, b, pattern)
        some = [i for i, t in enumerate(texts) if t]
        codes = dict(zip(some, enc.encode([texts[i] for i in some]), strict=True))
        self.used = [i for i in some if enc.true[codes[i]].all()]
        own = [codes[i] for i in self.used]
        flat = np.concatenate(own) if own else np.empty(0, np.int64)
        of = np.repeat(np.arange(len(own)), [len(c) for c in own])
        self.a_ids, n_a = enc.a.tokens(flat)
        self.b_ids, n_b = enc.b.tokens(flat)
        ends = lambda n: np.concatenate([[0], np.cumsum(np.bincount(of, n, len(own)).astype(np.int64))]) if len(own) else np.zeros(1, np.int64)
        self.a_from, self.b_from = ends(n_a), ends(n_b)
        a_end, b_end = np.cumsum(enc.a.lengths[self.a_ids]), np.cumsum(enc.b.lengths[self.b_ids])
        self.a_group, self.b_group = shared_cuts(a_end, b_end, self.a_from, self.b_from)
        self.n_a, self.n_b = np.diff(self.a_group, append=len(self.a_ids)), np.diff(self.b_group, append=len(self.b_ids))
        self.g_from = np.searchsorted(self.a_group, self.a_from)
        self.b_vocab, self.a_vocab = len(enc.b.lengths), len(enc.a.lengths)

    def digests(self) -> list[bytes]:
        """SHA-256 of each text's groups as text."""
        table, width = _words(self.a_vocab, self.b_vocab)
        last = np.zeros(len(self.a_ids), np.int32)
        last[self.a_group + self.n_a - 1] = 1
        order = np.empty(len(self.a_ids) + len(self.b_ids), np.int32)
        order[np.arange(len(self.a_ids)) + np.repeat(self.b_group, self.n_a)] = self.a_ids * 2 + last
        last = np.zeros(len(self.b_ids), np.int32)
        last[self.b_group + self.n_b - 1] = 1
        order[np.arange(len(self.b_ids)) + np.repeat(self.a_group + self.n_a, self.n_b)] = (self.b_ids + self.a_vocab) * 2 + last
        out = []
        for lo, hi in zip((self.a_from + self.b_from)[:-1], (self.a_from + self.b_from)[1:], strict=True):
            out.append(sha256(table[order[lo:hi]].tobytes().translate(None, b"\0")[:-1]).digest())
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, pair (A id * B's vocabulary + B id) and number of links, for each distinct pair of each text, sorted."""
        group = np.repeat(np.arange(len(self.used)), np.diff(self.g_from))
        total, base = self.n_a * self.n_b, np.int64(self.a_vocab) * self.b_vocab
        g = np.flatnonzero(total <= DIRECT)
        k = ragged(np.zeros(len(g), np.int64), total[g])
        n = np.repeat(self.n_b[g], total[g])
        a = self.a_ids[np.repeat(self.a_group[g], total[g]) + k // n].astype(np.int64)
        b = self.b_ids[np.repeat(self.b_group[g], total[g]) + k % n]
        key = np.sort(np.repeat(group[g] * base, total[g]) + a * self.b_vocab + b)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[first], np.diff(first, append=len(key))
        large = [self._large(i, group[i] * base) for i in np.flatnonzero(total > DIRECT).tolist()]
        if large:
            keys, back = np.unique(np.concatenate([key, *[x for x, _ in large]]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, back, np.concatenate([times, *[x for _, x in large]]))
            key, times = keys, sums
        return key // base, key % base, times

    def _large(self, i: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        a, m = np.unique(self.a_ids[self.a_group[i]:self.a_group[i] + self.n_a[i]], return_counts=True)
        b, n = np.unique(self.b_ids[self.b_group[i]:self.b_group[i] + self.n_b[i]], return_counts=True)
        return (base + a.astype(np.int64)[:, None] * self.b_vocab + b[None]).ravel(), (m[:, None] * n[None]).ravel()


@lru_cache(2)
def _words(a_vocab: int, b_vocab: int) -> tuple[np.ndarray, int]:
    """Each id in decimal with the sign behind it, for A then B: within a group, at its end."""
    words = [f"{i}{c}".encode() for i in range(a_vocab) for c in ",|"] + [f"{i}{c}".encode() for i in range(b_vocab) for c in ",;"]
    table = np.array(words)
    return table, table.itemsize


KINDS = ["<i8", "u1", "<i8", "<i8", "<i8", "<i8", "u1", "<i8", "<i4", "<i4"]


def _pack(arrays: list[np.ndarray]) -> bytes:
    body = [squeeze(np.ascontiguousarray(x, k)) for x, k in zip(arrays, KINDS, strict=True)]
    return np.array([[len(x), len(y)] for x, y in zip(arrays, body, strict=True)], "<i8").tobytes() + b"".join(body)


def _unpack(b: bytes) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(b, "<i8", 2 * len(KINDS)).reshape(-1, 2).tolist(), 16 * len(KINDS), []
    for kind, (n, size) in zip(KINDS, sizes, strict=True):
        out.append(unsqueeze(b[at:at + size], kind, n))
        at += size
    return out


def _taken(batches: Iterator[pd.DataFrame], mb: float) -> Iterator[tuple[list, list]]:
    """doc_ids and texts of about mb MB at a time."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b["doc_id"], b["text"], strict=True):
            ids.append(None if pd.isna(i) else int(i))
            texts.append(t if isinstance(t, str) else None)
            size += len(texts[-1] or "")
            if size >= mb * (1 << 20):
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def chunks(docs: DataFrame, a: str, b: str, pattern: str, chunk_mb: float = 3) -> DataFrame:
    """chunk, body, pairs, held: documents of a chunk, its distinct pairs (A id << 32 | B id) and how many of its documents hold each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, (ids, texts) in enumerate(_taken(batches, chunk_mb)):
            x = Alignment(texts, a, b, pattern)
            text, pair, times = x.links()
            own = np.sort(pair)
            first = np.flatnonzero(np.diff(own, prepend=-1))
            distinct, held = own[first], np.diff(first, append=len(own))
            used = np.array(x.used, np.int64)
            per = lambda v: np.bincount(used, v, len(ids)).astype(np.int64) if len(used) else np.zeros(len(ids), np.int64)
            hashes = np.zeros((len(ids), 32), np.uint8)
            if len(used):
                hashes[used] = np.frombuffer(b"".join(x.digests()), np.uint8).reshape(-1, 32)
            links = np.concatenate([[0], np.cumsum(x.n_a * x.n_b)])[x.g_from]
            at = np.searchsorted(distinct, pair)
            body = _pack([np.array([i or 0 for i in ids]), np.array([i is None for i in ids]), per(np.diff(x.a_from)), per(np.diff(x.b_from)), per(np.diff(x.g_from)), per(np.diff(links)),
                          hashes.ravel(), per(np.bincount(text, minlength=len(used))), np.diff(at, prepend=0), times])
            yield pd.DataFrame({"chunk": [(TaskContext.get().partitionId() << 32) + k], "body": [body], "pairs": [(distinct // x.b_vocab << 32) + distinct % x.b_vocab], "held": [held.astype(np.int32)]})

    return docs.select("doc_id", "text").mapInPandas(run, "chunk long, body binary, pairs array<long>, held array<int>")


def pair_counts(written: DataFrame) -> DataFrame:
    """pair, n, best: how many documents of all chunks hold a pair, and whether no pair of its A id is held by more."""
    own = written.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("n"))
    top = own.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return own.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: str, pattern: str, chunk_mb: float = 3) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each document."""
    written = cut(chunks(docs, a, b, pattern, chunk_mb))
    asked = written.select(F.col("chunk").alias("of"), F.explode("pairs").alias("pair"))
    counts = pair_counts(written).withColumnRenamed("pair", "p")
    answers = asked.join(counts, F.col("pair") == F.col("p")).select("of", "pair", "n", "best")

    def run(bodies: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        known = known.sort_values("pair")
        n, best = known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)
        for body in bodies["body"]:
            ids, null, n_a, n_b, n_groups, n_links, hashes, n_pairs, at, times = _unpack(body)
            ends = np.cumsum(n_pairs)
            at, times = np.cumsum(at), times.astype(np.int64)
            to = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends], prepend=0)  # noqa: B023, E731
            said = [bytes(h).hex() if g else "" for h, g in zip(hashes.reshape(-1, 32), n_groups, strict=True)]
            out.append(pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64").mask(null.astype(bool)), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                                     "n_best": to(times * best[at]), "count_sum": to(times * n[at]), "groups_sha256": said}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})

    return written.select("chunk", "body").groupBy("chunk").cogroup(answers.groupBy("of")).applyInPandas(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def groups(docs: DataFrame, a: str, b: str, pattern: str, chunk_mb: float = 3) -> DataFrame:
    """doc_id, group, a_ids, b_ids: the groups of each document, from 0."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _taken(batches, chunk_mb):
            x = Alignment(texts, a, b, pattern)
            for d, (lo, hi) in zip(x.used, zip(x.g_from[:-1].tolist(), x.g_from[1:].tolist(), strict=True), strict=True):
                spans = [(x.a_ids[p:p + m], x.b_ids[q:q + n]) for p, m, q, n in zip(x.a_group[lo:hi], x.n_a[lo:hi], x.b_group[lo:hi], x.n_b[lo:hi], strict=True)]
                yield pd.DataFrame({"doc_id": pd.array([ids[d]] * len(spans), "Int64"), "group": range(len(spans)), "a_ids": [p for p, _ in spans], "b_ids": [q for _, q in spans]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, group long, a_ids array<int>, b_ids array<int>")
