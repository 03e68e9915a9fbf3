import random
import zlib
from hashlib import sha256

import pytest

from tallyworks.llm import merkle
from tallyworks.llm.queries import OP11

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, pos string"


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row[:5]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def lower(t):
    return t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tree(digests):
    """The root, and for each digest its way up: (place in the run, the run)."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for w, x in zip(ways, at, strict=True):
            w.append((x % 16, level[x // 16 * 16:x // 16 * 16 + 16]))
        level = [h("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
        at = [x // 16 for x in at]
    return level[0], ways


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = tree([x[0] for x in by[s]])
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (d, r), way in zip(by[s], trees[s][1], strict=True):
            now = leaf(r, lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else d
            proof = ""
            for at, run in way + top:
                proof += "".join(run[:at] + run[at + 1:])
                now = h("".join([*run[:at], now, *run[at + 1:]]))
            out.append((r[0], s, d, trees[s][0], root, h(proof), now, now == root))
    return out


def key(r):
    return tuple((v is not None, v if v is not None else 0) for v in r)


def made(seed):
    rnd = random.Random(seed)
    text = lambda: rnd.choice([None, "", "lower", "Some Words É", "x" * 50_000 + "Y"])
    source = lambda: rnd.choices(["hot", "b", "é", "", None], [30, 3, 2, 1, 1])[0]
    rows = [(i, text(), rnd.choice(["en", None]), source(), rnd.choice([None, 7]), "x", "y") for i in range(900)]
    rows += [(1000 + i, "Own", "en", f"s{i}", 3, "x", "y") for i in range(40)]
    rows += [(None, "Null", "en", "b", 4, "x", "y"), (None, "Null", "en", "b", 4, "x", "y"), (None, None, None, None, None, None, None)]
    rows += [(-5, "Negative", "en", "hot", 8, "x", "y"), rows[3], rows[3], (7, "Another Text", "en", rows[7][3], 1, "x", "y")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_plain(spark, seed):
    rows = made(seed)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_more_than_one_block(spark):
    """Two rounds within a source: 16^3 leaves make a block."""
    rows = [(i, f"Text {i}", "en", "hot" if i % 7 else None, i, "x", "y") for i in range(10_000)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257, 4096])
def test_block_sizes(n):
    digests = [h(str(i)) for i in range(n)]
    height = merkle.height_of(n)
    nodes = merkle.forward(digests, height)
    root, ways = tree(digests)
    assert (merkle.joined([d for _, d in nodes[n, height]]) if height else digests[0]) == root
    got = merkle.backward(nodes, n, height, ())
    assert [merkle.packed(w) for w in got] == [";".join(f"{at}:{''.join(run)}" for at, run in w) for w in ways]
    assert all(merkle.unpacked(merkle.packed(w)) == w for w in got)


def test_one_and_none(spark):
    rows = [(10, "A", "en", None, 1, "x", "y")]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == h("")
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_says_the_same(spark):
    import duckdb

    rows = made(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    documents = docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"})  # noqa: F841
    want = con.sql(OP11).fetchall()
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=key) == sorted(want, key=key)
