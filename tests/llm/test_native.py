import random
import re
from collections import Counter, defaultdict

import pytest

from tallyworks.llm import linededup, mixing

SCHEMA = "doc_id long, text string, source string, size long, line string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 5, "x") for i, t, s in rows], SCHEMA)


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: rate * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(i, " ".join("w" for _ in range(rnd.randint(0, 60))), rnd.choices(["a", "b", "c", "d", "é", None], [40, 5, 1, 20, 3, 4])[0]) for i in range(1500)]
    return out + [(2000, None, "a"), (2001, "", "empty"), (None, "x y z", "a"), (None, "x y", "a"), (7, out[7][1], out[7][2]), (2002, "w " * 30000, "d")]


def test_mix_meets_targets(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = targets(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = mixing.mix(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_rows_are_those_taken(spark, rows):
    df = frame(spark, rows)
    copies = Counter()
    for r in mixing.mix(df).collect():
        copies[r.doc_id] += r.copies
    got = mixing.mixed(df)
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({k: v for k, v in copies.items() if v})


@pytest.mark.parametrize("sizes", [[10] * 6, [10, 20], [10, 20, 30] * 2, [5, 1000, 3, 5], [0, 0, 0, 9], [7] * 40, [1, 1, 1, 60, 1, 1, 1]])
def test_targets_of_equal_sources(spark, sizes):
    """Sources that meet their limit at one rate: shares still add up to all words."""
    of = {chr(97 + i) if i < 26 else f"z{i}": n for i, n in enumerate(sizes)}
    d = spark.createDataFrame(list(of.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(d).collect()}
    want = targets(of)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)
    assert abs(sum(got.values()) - sum(sizes)) < 1e-6


def test_equal_sources_in_sql(spark):
    import duckdb

    from tallyworks.llm.queries import OP6
    docs = frame(spark, [(i, "w " * 10, f"s{i % 6}") for i in range(60)])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.sql(OP6).fetchall())
    assert want == sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs).collect())


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None)])).collect()] == [0]


def lines():
    rnd = random.Random(4)
    out = []
    for i in range(400):
        s = rnd.choice(["big", "big", "big", "mid", None, f"tiny{i % 40}"])
        body = [f"line {rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 6))]
        if rnd.random() < 0.3:
            body += ["Menu | Home ", "", "Menu | Home"]
        if rnd.random() < 0.05:
            body.append("rare footer")
        out.append((i, "\n".join(body), s))
    return out + [(900, None, "big"), (901, "", "big"), (902, "Menu | Home", "big"), (902, "Menu | Home", "big"), (903, "é\n" * 20000, "mid")]


def brute_lines(rows, ratio=0.05):
    pages, held = Counter(), defaultdict(Counter)
    strip = lambda x: x.strip(" \t\r\x0b\x0c")
    for t, s in {(t, s) for _, t, s in rows}:
        if s is not None:
            pages[s] += 1
            held[s].update({strip(x) for x in (t or "").split("\n")} - {""} if t is not None else set())
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        all_ = t.split("\n")
        bad = {x for x, n in held[s].items() if n >= 3 and n > ratio * pages[s]} if s is not None else set()
        kept = [x for x in all_ if strip(x) not in bad]
        out.append((i, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("salted", [False, True])
def test_lines(spark, monkeypatch, salted):
    rows = lines()
    df = frame(spark, rows)
    out = linededup.dedup_lines(df, broadcast_mb=-1 if salted else 32)
    assert sorted(((r.row.doc_id, r.clean, r.n_lines, r.n_dropped) for r in out.collect()), key=str) == brute_lines(rows)
    kept = linededup.without_boilerplate(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(not (d and c == "") for _, c, _, d in brute_lines(rows))


def test_no_lines(spark):
    assert linededup.dedup_lines(frame(spark, [])).count() == 0 and linededup.without_boilerplate(frame(spark, [])).count() == 0


def test_copies_of_a_document_are_one_page(spark):
    """A copy group of a third of a source, and six copies in a source of fifty, keep their text; a shared line still goes."""
    rows = [(i, f"own words {i}\nMenu | Home", "s") for i in range(40)] + [(100 + i, "the one text\nof a copied page", "s") for i in range(20)]
    rows += [(200 + i, f"page {i}", "t") for i in range(44)] + [(300 + i, "copied six times", "t") for i in range(6)]
    kept = {r.doc_id: r.text for r in linededup.without_boilerplate(frame(spark, rows)).collect()}
    assert len(kept) == len(rows)
    assert all(kept[i] == (f"own words {i}" if i < 40 else t) for i, t, _ in rows)
    pages = {r.site: r.n_pages for r in linededup.boilerplate(frame(spark, rows)).collect()}
    assert pages == {"s": 41}


def test_mix_of_rows_without_ids(spark):
    """Null and repeated ids do not stand or fall together."""
    rnd = random.Random(11)
    rows = [(None if k % 2 else 5, " ".join(f"w{rnd.randint(0, 999)}" for _ in range(rnd.randint(1, 30))), "ab"[k % 3 == 0]) for k in range(900)]
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in mixing.mix(frame(spark, rows)).collect():
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert sum(words(r.text) for r in mixing.mixed(frame(spark, rows)).collect()) == sum(taken.values())
