import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyworks.llm import simhash
from tallyworks.llm.components import components

SCHEMA = "doc_id long, text string, fp string, key int"


def brute(rows, radius=3):
    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    fps = [(i, fp(t)) for i, t in rows]
    comp = {i: i for i, _ in fps if i is not None}
    changed = True
    while changed:
        changed = False
        for i, f in fps:
            for j, g in fps:
                if i is not None and j is not None and (f ^ g).bit_count() <= radius and comp[i] > comp[j]:
                    comp[i], changed = comp[j], True
    return sorted(((i, f, comp.get(i)) for i, f in fps), key=str)


@pytest.fixture(scope="module")
def rows():
    base = " ".join(f"word{i % 37}x{i}" for i in range(400))
    out = [(i, base + f" tail{i}") for i in range(40)] + [(100 + i, base) for i in range(5)]
    out += [(200, None), (201, ""), (202, "  \t"), (203, "One"), (204, "one"), (205, "two words"), (None, base), (7, base + " tail7"), (300, "x " * 30000), (301, "É é a b C"), (302, "é é a b c")]
    return out


def test_same_as_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_filter_keeps_one_of_each_group(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    want = {c for _, _, c in brute(rows) if c is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == want and ids.count(None) == 1 and len(ids) == len(want) + 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0 and simhash.without_near_duplicates(df).count() == 0


@pytest.mark.parametrize("radius", [2, 3])
def test_crowded_values_are_dealt_again_and_lose_no_link(spark, radius):
    """A third of all fingerprints share one half: with a small crowd they meet by quarters, and components stay those of all pairs."""
    import numpy as np

    rng = np.random.default_rng(4)
    shared = [(0xABCD1234 << 32) | int(x) for x in rng.integers(0, 2**32, 300)]
    low = [0x0F0F0F0F | int(x) << 32 for x in rng.integers(0, 2**32, 200)]
    free = [int(x) for x in rng.integers(0, 2**62, 300)]
    near = []
    for f in [*shared[:120], *low[:60], *free[:60]]:
        for bits in (1, 2, 3, 4):
            at = rng.choice(64, bits, replace=False)
            near.append(f ^ sum(1 << int(i) for i in at))
    fps = sorted({*shared, *low, *free, *near})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    hot = {r.key for r in simhash.crowded(df, radius, 40).collect()}
    assert (1 << 32 | 0xABCD1234) in hot and 0x0F0F0F0F in hot

    def roots(links):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {f: find(f) for f in fps}

    a = np.array(fps, np.uint64)
    pairs = np.argwhere(np.bitwise_count(a[:, None] ^ a[None]) <= radius)
    want = roots([(fps[i], fps[j]) for i, j in pairs if i < j])
    got = [(r.fa & (2**64 - 1), r.fb & (2**64 - 1)) for r in simhash.near_links(df, radius, crowd=40).collect()]
    assert all((x ^ y).bit_count() <= radius for x, y in got)
    assert roots(got) == want and len(set(want.values())) < len(fps)


def test_no_key_is_met_by_more_than_its_last_quarter_allows(spark):
    """40,000 fingerprints of one half: no key gathers more than a twentieth of them."""
    import numpy as np

    fps = np.unique(np.random.default_rng(1).integers(0, 2**31, 40_000)) | (77 << 32)
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    assert [r.key for r in simhash.crowded(df, 3, 16_384).filter("key >= 4294967296").collect()].count(77 | 1 << 32) == 1
    rows = df.mapInPandas(simhash._emit(3), "key long, fp long, centre boolean").filter(f"key = {77 | 1 << 32}")
    dealt = rows.mapInPandas(simhash._again(3), "key long, fp long, centre boolean").groupBy("key").count()
    assert dealt.agg(F.max("count")).first()[0] < len(fps) / 20


def test_forest_connects_a_large_block():
    import numpy as np

    fps = np.array([1 << (i % 60) | 1 << (i % 7) for i in range(500)] + [2**63 + 2**40 + 2**20 + 7], np.uint64)
    fps = np.unique(fps)
    links = simhash._forest(fps[:300], fps[300:], 3)
    assert len(links) < len(fps)


def test_components_of_a_path(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = components(edges).collect()
    assert len(got) == 200 and {r.component for r in got} == {0}
