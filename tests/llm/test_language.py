import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tallyworks.llm import language

PATH = P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, word string, at int, score double"
PIECES = ["", "", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "▁abcab", "cab", "abca", "bcabcabc"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "w", 0, 0.5) for i, t, x in rows], SCHEMA)


def ways(word, pieces):
    """All ways to spell word, as lists of ids; a letter without a piece is spelled by its bytes."""
    if not word:
        return [[]]
    out = [[pieces[word[:n]], *rest] for n in range(1, len(word) + 1) if word[:n] in pieces for rest in ways(word[n:], pieces)]
    if word[0] not in pieces:
        out += [[2 + b for b in word[0].encode()] + rest for rest in ways(word[1:], pieces)]
    return out


@pytest.fixture(scope="module")
def small():
    rnd = np.random.default_rng(1)
    table = rnd.random((len(PIECES), 3))
    own = {p: i for i, p in enumerate(PIECES) if p and not p.startswith("<0x")}
    words = ["▁" + "".join(random.Random(i).choice("aabbccé日") for _ in range(i % 9)) for i in range(60)]
    return language.Lattice(PIECES), table / table.sum(0), own, words


def test_forward_sums_all_ways(small):
    lat, table, own, words = small
    got = language.forward(lat, words, table)
    for w, g in zip(words, got, strict=True):
        want = sum(np.prod(table[way], axis=0) for way in ways(w, own))
        assert np.allclose(g, np.log(want), rtol=1e-10)


def test_expected_counts_of_all_ways(small):
    lat, table, own, words = small
    column, weight = np.arange(len(words)) % 3, np.arange(len(words)) % 4 + 1.0
    want = np.zeros_like(table)
    for w, c, n in zip(words, column, weight, strict=True):
        all_ways = ways(w, own)
        p = np.array([np.prod(table[way, c]) for way in all_ways])
        for way, share in zip(all_ways, p / p.sum(), strict=True):
            for i in way:
                want[i, c] += share * n
    assert np.allclose(language.expected(lat, words, column, weight, table), want)


def test_long_words_keep_their_sums(small):
    """Against sums of logarithms, where plain products would be lost."""
    lat, table, own, _ = small
    tiny = table * 1e-9
    word = "▁" + "".join(random.Random(5).choice("abc") for _ in range(3000))
    logs = [np.zeros(3)]
    for j in range(1, len(word) + 1):
        parts = [logs[i] + np.log(tiny[own[word[i:j]]]) for i in range(max(0, j - 8), j) if word[i:j] in own]
        logs.append(np.logaddexp.reduce(parts, axis=0))
    assert np.allclose(language.forward(lat, [word, "▁ab"], tiny)[0], logs[-1], rtol=1e-10)


def plain_tables(rows, passes=2):
    """Counts and probabilities by enumeration of ways, over the whole vocabulary."""
    pieces = language.vocabulary(PATH)
    own = {p: i for i, p in enumerate(pieces) if p and not p.startswith("<0x")}
    names = sorted({x for _, t, x in rows if x and t is not None})
    table = np.full((len(pieces), len(names)), 1 / len(pieces))
    words = Counter((names.index(x), "▁" + w) for _, t, x in {(0, t, x) for _, t, x in rows if x and t is not None} for w in language.words_of(t))
    for _ in range(passes):
        counts = np.zeros_like(table)
        for (c, w), n in words.items():
            all_ways = ways(w, own)
            p = np.array([np.prod(table[way, c]) for way in all_ways])
            for way, share in zip(all_ways, p / p.sum(), strict=True):
                for i in way:
                    counts[i, c] += share * n
        table = language.smoothed(counts)
    prior = Counter(x for _, t, x in rows if x and t is not None)
    return names, table, np.log([prior[x] / sum(prior.values()) for x in names]), own


def test_same_as_plain(spark):
    rnd = random.Random(2)
    make = lambda words: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))
    rows = [(i, make(["the", "and", "ing", "is"]) if i % 2 else make(["der", "und", "ist", "über"]), "en" if i % 2 else "de") for i in range(60)]
    rows += [(70, None, "en"), (71, "", "en"), (72, "12 ½ ³ !?", "en"), (73, "und the", None), (None, "the is", "de"), (None, "the is", "de"), (3, rows[4][1], "de"), (74, "日本 é́", "de")]
    train = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    names, table, prior, own = plain_tables(train)
    want = []
    for i, t, _ in rows:
        z = prior.copy()
        words = language.words_of(t)
        for w in words:
            z += np.log(sum(np.prod(table[way], axis=0) for way in ways("▁" + w, own)))
        p = np.exp(z - z.max())
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, names[int(z.argmax())] if words else "und", round(float(p.max() / p.sum()), 6) if words else 0.0))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in language.identify(frame(spark, rows).repartition(3), PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_words_are_runs_of_letters():
    assert language.words_of("Don't 2x ½ abc_def ÉCOLE é́t ²n") == ["don", "t", "x", "abc", "def", "école", "é́t", "n"]
    assert language.words_of(None) == [] and language.words_of("1 2 ½ ³ ___") == []


def test_nothing_learned(spark):
    rows = [(i, "some text", None) for i in range(8)]
    assert {(r.lang_pred, r.score) for r in language.identify(frame(spark, rows), PATH).collect()} == {("und", 0.0)}
    assert language.identify(frame(spark, []), PATH).count() == 0


def test_too_many_languages(spark):
    with pytest.raises(ValueError):
        language.learn(frame(spark, [(i, "a", f"l{i}") for i in range(6)]), PATH, max_languages=5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, PATH).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
