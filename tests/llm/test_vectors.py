import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import collisions, pqdedup

SCHEMA = "vec_id long, embedding array<float>, label int, h int, id string"


def ok(v):
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    out, i = [], 0
    for b, times in zip(base, [300, *rng.integers(1, 12, 39)], strict=True):
        for _ in range(times):
            out.append((i, (b + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist(), int(i % 3)))
            i += 1
    out += [(i + k, rng.standard_normal(16).astype(np.float32).tolist(), 1) for k in range(600)]
    out += [(9000 + k, out[5][1], out[5][2]) for k in range(30)] + [out[7], out[7]]
    out += [(9100, None, 1), (9101, [0.0] * 16, 1), (9102, [float("nan")] + [1.0] * 15, 1), (9103, [None] + [1.0] * 15, 1), (9104, [float("inf")] * 16, 1), (9105, out[5][1], None), (None, out[5][1], 1), (9106, [1.0, 2.0], 1), (9200, [0.0] * 16, 1)]
    return out


def test_links_and_components(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = pqdedup.link(df, block=64).collect()
    assert len(got) == len(rows)
    good = [k for k, (i, v, lab) in enumerate(rows) if ok(v) and lab is not None and i is not None]
    x = np.array([rows[k][1] for k in good], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([rows[k][2] for k in good])
    ids = np.array([rows[k][0] for k in good])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab) & ~np.eye(len(good), dtype=bool)
    comp = ids.copy()
    while True:
        low = np.array([min([comp[k], *comp[near[k]]]) for k in range(len(ids))])
        if (low == comp).all():
            break
        comp = low
    want = [(rows[k][0], int(c), int(r)) for k, c, r in zip(good, near.sum(1), comp, strict=True)]
    want += [(r[0], 0, r[0]) for k, r in enumerate(rows) if k not in set(good)]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(want, key=str)
    n = {r.vec_id: r.n_links for r in got}
    assert all(n[i] == 0 for i in (9100, 9101, 9102, 9103, 9104, 9105, 9106, None)) and all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_nearest(spark, rows):
    rows = [*rows, *[(200, v, 1) for _, v, _ in rows[:3]], rows[300], rows[300]]  # ids of queries again
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = collisions.search(df, F.col("vec_id") % 100 == 0, block=400, queries=8).collect()
    assert sorted(got) == sorted(collisions.search(df.repartition(3), F.col("vec_id") % 100 == 0, block=400, queries=8).collect())
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and ok(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good])
    asking = [k for k, i in enumerate(ids) if i % 100 == 0]
    assert len(got) == 10 * len(asking)
    hit = 0
    for q in sorted(set(ids[asking].tolist())):
        far, right = [], []
        for k in [k for k in asking if ids[k] == q]:
            d = np.sqrt(((x - x[k]) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if j != k][:10]
            far.append(d[order[-1]])
            right += [(rank, int(ids[j]), round(float(d[j]), 9)) for rank, j in enumerate(order, 1)]
        mine = [(r.rank, r.vec_id, round(r.score, 9)) for r in got if r.query_id == q]
        assert sorted(r for r, *_ in mine) == sorted(list(range(1, 11)) * len(far))
        hit += len(set(mine) & set(right)) if len(far) == 1 else sum(1 for m in mine if m in right)
    assert hit >= 0.9 * len(got)
    assert not {r.query_id for r in got} & {9100, 9200}


def test_rows_that_share_an_id(spark):
    """Equal, near and orthogonal vectors under one vec_id are rows of their own."""
    e = np.eye(16)
    near = lambda v: (v + 0.01 * e[15]).tolist()
    rows = [(1, e[0].tolist(), 1), (1, e[1].tolist(), 1), (2, near(e[0]), 1), (3, near(e[1]), 1), (0, (e[0] + 0.02 * e[14]).tolist(), 1), (7, e[2].tolist(), 1), (7, near(e[2]), 1), (8, e[3].tolist(), 1), (8, e[3].tolist(), 1), (9, e[0].tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for parts in (1, 4):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in pqdedup.link(df.repartition(parts)).collect())
        assert got == [(0, 2, 0), (1, 1, 1), (1, 2, 0), (2, 2, 0), (3, 1, 1), (7, 1, 7), (7, 1, 7), (8, 1, 8), (8, 1, 8), (9, 0, 9)]
        hits = collisions.search(df.repartition(parts), F.col("vec_id") % 7 == 0, k=1).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in hits) == [(0, 1, 1, 0.02), (7, 1, 7, 0.01), (7, 1, 7, 0.01)]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, 1, ""), (1, [1.0, 0.1], 1, 1, ""), (2, [5.0, 5.0], None, 1, "")], SCHEMA)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in collisions.search(df, F.col("vec_id") == 0).collect()) == [(0, 1, 1), (0, 2, 2)]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pqdedup.link(df).collect()) == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)]
    none = df.limit(0)
    assert collisions.search(none, F.col("vec_id") == 0).count() == 0 and pqdedup.link(none).count() == 0


def test_huge_and_tiny_components(spark):
    """Finite components near the ends of the range of doubles link, are found, and spoil nobody else's search."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 16))
    v = [*base, *(base[:20] * 1e200), *(base[:20] * 1e-200), *(base[20:40] / np.abs(base[20:40]).max() * 1e308)]
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in pqdedup.link(df).collect()}
    unit = np.array([x / np.abs(x).max() for x in v])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98).sum(1) - 1
    assert [got[i].n_links for i in range(len(v))] == near.tolist() and got[405].component_id == got[425].component_id == 5
    hits = collisions.search(df, F.col("vec_id") % 100 == 0, block=200).collect()
    x = np.array(v)
    found = total = 0
    for q in range(0, len(v), 100):
        mine = [r for r in sorted(hits, key=lambda r: r.rank) if r.query_id == q]
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.array([np.hypot.reduce(x[q] - y) for y in x])
        d[q] = np.inf
        want = np.sort(d)[:10]
        assert len(mine) == 10
        assert all(abs(r.score - d[r.vec_id]) <= 1e-12 * d[r.vec_id] for r in mine)
        found += sum(r.score <= want[-1] * (1 + 1e-12) for r in mine)
        total += 10
    assert found >= 0.9 * total
