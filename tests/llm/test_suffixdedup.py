import hashlib
import random

import numpy as np
import pytest

from tallyworks.llm import suffixdedup as sd

SCHEMA = "doc_id long, text string, part long, n int"


def brute(rows, length):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for s in range(len(b) - length + 1):
                g = b[s:s + length]
                first[g] = min(first.get(g, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for s in range(len(b) - length + 1):
                if first[b[s:s + length]] < i:
                    gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n, a="abcdefgh é\n": "".join(rnd.choice(a) for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 60, 75, 200, 1000)]
    rows = []
    for i in range(60):
        t = text(rnd.randint(0, 300))
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 2)
            t += rnd.choice([s, s[a:], s[:a + 30], s + s]) + text(rnd.randint(0, 40))
        rows.append((i * 3 % 61, t))
    rows += [(i, rows[5][1]) for i in range(100, 110)] + [(200 + i, "ab" * rnd.randint(20, 200)) for i in range(6)] + [(300, "a" * 500), (301, "a" * 120), (302, "\0" * 100), (303, "\0" * 70 + "x")]
    rows += [(None, rows[5][1]), (400, None), (401, ""), (402, "short"), (5, rows[7][1]), (5, rows[7][1]), (403, text(3000) + shared[6] + text(100))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    got = sd.dedup(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=str) == brute(rows, 50)


def test_empty(spark):
    assert sd.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_anchors_are_chosen_by_content():
    rnd = random.Random(3)
    text = bytes(rnd.choice(b"abc ") for _ in range(5000))
    k, length = 26, 50
    whole, _ = sd.anchors_of(np.frombuffer(text, np.uint8), np.array([5000]), length, k)
    for s in rnd.sample(range(4950), 200):
        at, _ = sd.anchors_of(np.frombuffer(text[s:s + length], np.uint8), np.array([length]), length, k)
        assert len(at) and set((at + s).tolist()) <= set(whole.tolist())
    long = text * 600  # cut into overlapping pieces
    place, _ = sd.part_anchors([b"x", long, b"", b"y" * 60], [False] * 4, length, k)
    one, _ = sd.anchors_of(np.frombuffer(long, np.uint8), np.array([len(long)]), length, k)
    assert set((one + 1).tolist()) <= set(place.tolist()) and len(place) - len(one) <= 60


def test_loser_tree_merges_with_known_prefixes():
    rnd = random.Random(4)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(12)) for _ in range(rnd.randint(0, 60))) for _ in range(7)]
    coded = []
    for r in runs:
        m = np.array([list(x) for x in r], np.uint8).reshape(len(r), 12)
        if len(r):
            lcps, back = sd.decoded(*sd.front_coded(m), len(r), 12)
            assert back == r
            coded.append((lcps.tolist(), back))
    merged = [(coded[r][1][i], h) for r, i, h in sd.merge(coded)]
    assert [x for x, _ in merged] == sorted(x for r in runs for x in r)
    for (a, _), (b, h) in zip(merged, merged[1:]):
        assert h == next((i for i in range(12) if a[i] != b[i]), 12)


def test_equal_hashes_of_other_bytes_are_told_apart():
    run = np.array([0, 0, 0, 1, 1])
    before = np.array([[1, 2], [3, 4], [1, 2], [1, 2], [1, 2]], np.uint8)
    order, start = sd._told_apart(run, np.zeros(5, np.uint64), before)
    ends = [*start[1:].tolist(), 5]
    assert sorted(sorted(order[a:b].tolist()) for a, b in zip(start.tolist(), ends)) == [[0, 2], [1], [3, 4]]


def test_copies_that_one_part_alone_holds(spark):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    a, b, c = text(90), text(400), text(70)
    rows = [(1, a), (2, a), (3, b + text(30)), (4, text(30) + b), (5, text(80)), (5, c), (5, c), (7, c + text(60)), (None, a)]
    got = sd.dedup(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA).coalesce(1)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=str) == brute(rows, 50)


def test_a_suffix_alone_in_its_run_is_held_by_its_own_documents():
    length, k = 6, 4
    rows = [(b"abcdef", 6, b"xy", 2), (b"abcdeg", 6, b"xz", 2), (b"qrstu\0", 5, b"x\0", 1)]
    m = np.array([[*after, n, *before, o] for after, n, before, o in rows], np.uint8)
    least, most = np.array([3, 4, 5]), np.array([9, 4, 8])
    got = sd.smallest_holders(m, np.array([0, 5, 0]), least, most, length, k)
    assert got.tolist() == [[3, sd.NONE, sd.NONE], [3, 3, 5], [3, 4, sd.NONE]]


def test_ids_and_bytes_go_as_they_are(spark, tmp_path):
    rnd = random.Random(8)
    a, b = ("".join(rnd.choice("abcdefgh é\n") for _ in range(n)) for n in (80, 200))
    rows = [(None, a), (2**53, b), (2**53 + 1, b), (2**53 + 2, b + a), (-2**63, a), (2**63 - 1, a), (None, None)]
    got = sd.dedup(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA).coalesce(1)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=str) == brute(rows, 50)
    # bytes that are no UTF-8 are bytes all the same
    path = str(tmp_path / "documents.parquet")
    spark.sql("SELECT 1L AS doc_id, CAST(concat(CAST(repeat('abcdefghijkl', 9) AS BINARY), unhex('FF80C3')) AS STRING) AS text "
              "UNION ALL SELECT 2L, CAST(concat(unhex('FF'), CAST(repeat('abcdefghijkl', 9) AS BINARY)) AS STRING)").write.parquet(path)
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in sd.dedup(spark.read.parquet(path)).collect()}
    assert got == {1: (111, 0, b"abcdefghijkl" * 9 + b"\xff\x80\xc3"), 2: (109, 108, b"\xff")}
