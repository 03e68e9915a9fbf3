import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyworks.llm import crosstoken

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pair long, chunk string, n int"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def made(seed, n):
    rnd = random.Random(seed)
    words = ["the", "Blaneth", "éèçñ", "don't", "x2000", "日本語", "\U0001f600\U0001f468‍\U0001f469", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "<unk>", "ing,", "ﬁＡ①", "À́", "\x00", "\x1c", "aaaaaaa", "́", "́́", "שלום", "..!!", "#$%", "ßüx", "𝔘"]
    gaps = [" ", " ", " ", " ", "  ", "\n", " \n ", "\n\n  ", "\t", " \t ", "   ", "\r\n", " ", "  ", "　", "\x85", "\v ", "᠎ ", "​ ", "\x1c ", "- ", "\n "]
    out = []
    for _ in range(n):
        t = "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(1, 40)))
        out.append(rnd.choice(["", " ", "  ", "\n"]) + t if rnd.random() < 0.4 else t.strip(" ") if rnd.random() < 0.5 else t)
    return out


def whole(text, tokenizers):
    """A's ids, B's ids and the groups of ids, by the set of shared ends."""
    a, sp = tokenizers
    if not text:
        return [], [], []
    letters = crosstoken.byte_alphabet()
    e = a.encode(" " + text, add_special_tokens=False)
    ab = [bytes(letters[c] for c in t) for t in e.tokens]
    b = sp.encode(text)
    bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
        return [], [], []
    both = set(np.cumsum([len(x) for x in ab]).tolist()) & set(np.cumsum([len(x) for x in bb]).tolist())
    groups, i, j, at_a, at_b = [], 0, 0, 0, 0
    for end in sorted(both):
        p, q = i, j
        while at_a < end:
            at_a += len(ab[i])
            i += 1
        while at_b < end:
            at_b += len(bb[j])
            j += 1
        groups.append((e.ids[p:i], b[q:j]))
    return e.ids, b, groups


def plain(rows, tokenizers):
    parsed = [whole(r[1], tokenizers) for r in rows]
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for _, _, g in parsed]
    held = Counter(p for c in links for p in c)
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for r, (a, b, g), c in zip(rows, parsed, links, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((r[0], len(a), len(b), len(g), sum(c.values()), sum(n for p, n in c.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in c.items()), sha256(said.encode()).hexdigest() if g else ""))
    return out


def key(r):
    return tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r)


def test_pieces_join_to_whole_texts(tokenizers):
    a, sp = tokenizers
    enc = crosstoken.Encoder(A, B, P.PATTERN)
    for t in made(1, 3000):
        (codes,) = enc.encode([t])
        assert enc.a.tokens(codes)[0].tolist() == a.encode(" " + t, add_special_tokens=False).ids
        if enc.true[codes].all():
            assert enc.b.tokens(codes)[0].tolist() == sp.encode(t)


@pytest.mark.parametrize("mb", [5, 0.001])
def test_same_as_plain(spark, tokenizers, mb):
    texts = [*made(2, 250), None, "", " ", "▁ under", "word " * 20_000, "x" * 30_000, "日本語" * 3000, "the same", "the same"]
    rows = [(i, t, 1, "a", 2) for i, t in enumerate(texts)] + [(None, "no id", 1, "a", 2), (None, "no id", 1, "a", 2), (5, "id again", 1, "a", 2)]
    got = crosstoken.align(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B, P.PATTERN, mb).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, tokenizers), key=key)


def test_groups_are_the_tokens(spark, tokenizers):
    rows = [(i, t, 1, "a", 2) for i, t in enumerate(made(3, 60))]
    got = defaultdict(list)
    for r in sorted(crosstoken.groups(spark.createDataFrame(rows, SCHEMA), A, B, P.PATTERN).collect(), key=lambda r: (r.doc_id, r.group)):
        got[r.doc_id].append((list(r.a_ids), list(r.b_ids)))
    assert dict(got) == {r[0]: g for r in rows if (g := whole(r[1], tokenizers)[2])}


def test_cuts_of_any_intervals():
    """Against the set of shared ends, where they are rare as well."""
    rnd = random.Random(4)
    for share in (0.0, 0.01, 0.1, 0.6, 1.0):
        a, b, a_from, b_from, base = [], [], [0], [0], 0
        want = []
        for _ in range(30):
            n = rnd.randint(1, 400)
            x, y = sorted(rnd.sample(range(1, n + 1), rnd.randint(1, n)) + [n]), sorted(rnd.sample(range(1, n + 1), rnd.randint(1, n)) + [n])
            keep = {v for v in set(x) & set(y) if rnd.random() < share} | {n}
            x, y = sorted(set(x) - (set(y) - keep) | {n}), sorted(set(y))
            y = [v for v in y if v in keep or v not in x]
            shared = sorted(set(x) & set(y))
            starts = [0, *shared[:-1]]
            want += [(len(a) + sum(v <= s for v in x), len(b) + sum(v <= s for v in y)) for s in starts]
            a += [base + v for v in x]
            b += [base + v for v in y]
            a_from.append(len(a))
            b_from.append(len(b))
            base += n
        got = crosstoken.shared_cuts(np.array(a), np.array(b), np.array(a_from), np.array(b_from))
        assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


def test_many_links_in_a_group():
    x = crosstoken.Alignment.__new__(crosstoken.Alignment)
    rnd = np.random.default_rng(1)
    x.used, x.a_vocab, x.b_vocab = [0, 1], 50, 40
    x.a_group, x.b_group, x.g_from = np.array([0, 100, 103]), np.array([0, 70, 72]), np.array([0, 1, 3])
    x.n_a, x.n_b = np.array([100, 3, 5]), np.array([70, 2, 6])
    x.a_ids, x.b_ids = rnd.integers(0, 50, 108).astype(np.int32), rnd.integers(0, 40, 78).astype(np.int32)
    want = Counter()
    for d, i in ((0, 0), (1, 1), (1, 2)):
        for p in x.a_ids[x.a_group[i]:x.a_group[i] + x.n_a[i]].tolist():
            for q in x.b_ids[x.b_group[i]:x.b_group[i] + x.n_b[i]].tolist():
                want[d, p * 40 + q] += 1
    assert {(t, p): n for t, p, n in zip(*(v.tolist() for v in x.links()), strict=True)} == want


def test_none(spark):
    assert crosstoken.align(spark.createDataFrame([], SCHEMA), A, B, P.PATTERN).count() == 0
    got = crosstoken.align(spark.createDataFrame([(1, None, 1, "a", 2)], SCHEMA), A, B, P.PATTERN).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")]
