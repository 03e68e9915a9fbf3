import pytest

from tallyworks.llm import toxicity
from tallyworks.llm.toxicity import FuzzyTrie

DOCS = "doc_id long, text string, score double, toxic int"


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_walk_finds_what_the_distance_finds():
    import random

    rnd = random.Random(1)
    terms = ["horrid", "awful", "mean", "despicable", "horror"]
    trie = FuzzyTrie(terms, ["zork"])
    words = ["horrid", "horid", "horrrid", "awfull", "mean", "meen", "despicabl", "dspicble", "zorkmid", "zor", "", "horri"]
    words += ["".join(rnd.choice("horidafulmenspcbz") for _ in range(rnd.randint(1, 9))) for _ in range(500)]
    for t in terms:
        words += [t[:i] + rnd.choice("abcdeor") * rnd.randint(0, 1) + t[i + rnd.randint(0, 1):] for i in range(len(t))]
    for w in words:
        best = min((lev(w, t), t) for t in terms if lev(w, t) <= toxicity.edits_for(t)) if any(lev(w, t) <= toxicity.edits_for(t) for t in terms) else None
        got = trie.find(w)
        if w.startswith("zork"):
            assert got == ("stem", 0)
        else:
            assert (got is None) == (best is None) and (best is None or got[1] == best[0]), w


@pytest.fixture(scope="module")
def tables(spark):
    import random

    rnd = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("n", "r", "st", "lk")]
    docs, labels = [], []
    for i in range(900):
        w = [rnd.choice(vocab) for _ in range(40)]
        bad = i % 8 == 0
        if bad:
            for _ in range(4):
                w.insert(rnd.randint(0, len(w)), rnd.choice(["horrid", "despicable", "zorkmid", "zorkel", "zorkan", "zorkon"]))
        docs.append((i, " ".join(w), 0.0, 1))
        labels.append((i, int(bad)))
    docs += [(5000, None, 0.0, 1), (5001, "", 0.0, 1), (None, "horrid despicable", 0.0, 1), (5002, "horrid " * 20000, 0.0, 1), (5003, "ban horid dar desspicable", 0.0, 1), (0, docs[0][1], 0.0, 1)]
    labels += [(None, 1), (5000, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(tables):
    docs, labels = tables
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == docs.count()
    own = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert len(own) > 200 and all(r.predicted == truth[r.doc_id] for r in own)
    by = {r.doc_id: r for r in rows}
    assert by[5000].score == by[5001].score < 0.5 and by[5002].predicted == 1 and by[None].predicted == 1 and not by[None].held_out


def test_filter_keeps_clean_rows_and_columns(tables):
    docs, labels = tables
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 5000 in ids and 5001 in ids and 1 in ids and 0 not in ids and None not in ids


def test_without_labels_or_documents(tables, spark):
    docs, labels = tables
    assert {round(r.score, 6) for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.1}
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_quotation_is_counted_apart():
    trie = FuzzyTrie(["horrid"], [])
    assert toxicity.hits('they wrote "you horrid man" today', trie) == {"exact_quoted": 1}
    assert toxicity.hits("you horrid man", trie) == {"exact": 1}
    for plain in ('"hello" you horrid thing, "bye"', "he said nothing and you horrid man go away", 'he said "you horrid man', 'a 5" horrid pipe of 6" width', 'you" horrid "man', '"one\nhorrid" two',
                  "\u00abhello\u00bb you horrid thing \u00abbye\u00bb", "\u201chello\u201d horrid \u201cbye\u201d", 'he said: no. You horrid man', 'he said "no" and: you horrid man'):
        assert toxicity.hits(plain, trie) == {"exact": 1}, plain
    for quoted in ('"you horrid man", they wrote', '("horrid")', "\u00abyou horrid man\u00bb", "\u00bbdu horrid\u00ab", "\u201eyou horrid man\u201c sagte er", "\u201cyou horrid man\u201d", 'x "a" y "b horrid c" z', 'stray " mark. Then "you horrid man"',
                   "she said: you horrid man", "he wrote to us that you are horrid people", "elle a dit que horrid"):
        assert toxicity.hits(quoted, trie) == {"exact_quoted": 1}, quoted
    assert toxicity.hits('horrid "horrid" horrid said: horrid! horrid', trie) == {"exact": 3, "exact_quoted": 2}


def test_misspellings_of_short_and_stemmed_words():
    trie = FuzzyTrie(["scum", "zorkmid", "moron"], ["zork"], frozenset(["oron", "moron"]))
    assert trie.find("scumm")[0] == trie.find("scm")[0] == "near_short" and trie.find("zrkmid") == ("near_short", 1)
    assert trie.find("zorkmids") == ("stem", 0) and trie.find("oron") is None and trie.find("moron") == ("exact", 0)


def test_documents_with_misspelled_words_alone(spark):
    """Each of short words, long words and words of a stem, misspelled; a clean word one edit from a term is none."""
    import random

    rnd = random.Random(6)
    vocab = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("nt", "rst", "lks")] + ["horrit"]
    insults = ["horrid", "scum", "despicable", "zorkmid", "zorkelan", "zorkanib", "zorkonel"]
    docs, labels = [], []
    for i in range(1200):
        w = [rnd.choice(vocab) for _ in range(40)]
        if i % 8 == 0:
            for _ in range(4):
                w.insert(rnd.randint(0, len(w)), rnd.choice(insults))
        docs.append((i, " ".join(w), 0.0, 1))
        labels.append((i, int(i % 8 == 0)))
    plain = [rnd.choice(vocab) for _ in range(30)]
    wrong = {"scum": "scuum", "horrid": "horid", "despicable": "desspicabl", "zorkmid": "zrkmid", "zorkelan": "zokelan", "zorkanib": "xorkanib"}
    for i, x in enumerate(wrong.values()):
        docs.append((9000 + i, " ".join([*plain[:10], x, *plain[10:20], x, *plain[20:]]), 0.0, 1))
    docs.append((9100, " ".join([*plain, *["horrit"] * 3]), 0.0, 1))
    got = {r.doc_id: r.predicted for r in toxicity.scored(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")).filter("doc_id >= 9000").collect()}
    assert {x: got[9000 + i] for i, x in enumerate(wrong.values())} == dict.fromkeys(wrong.values(), 1) and got[9100] == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_quoted(text, a, b):
    """Whether text[a:b] is quoted, from its own line alone."""
    import re

    start, end = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    line = text[start:end if end >= 0 else len(text)]
    a, b = a - start, b - start
    opened = None
    for i, x in enumerate(line):
        if x not in '"\u201c\u201d\u201e\u00ab\u00bb\u2039\u203a':
            continue
        free = i == 0 or line[i - 1].isspace() or line[i - 1] in "([{"
        ended = i + 1 == len(line) or not line[i + 1].isalnum()
        fits = opened is not None and (opened[1], x) in {('"', '"'), ("\u201c", "\u201d"), ("\u201d", "\u201d"), ("\u201e", "\u201c"), ("\u201e", "\u201d"), ("\u00ab", "\u00bb"), ("\u00bb", "\u00ab"), ("\u2039", "\u203a"), ("\u203a", "\u2039")}
        if fits and not (x == '"' and free and not ended):
            if opened[0] < a and b <= i:
                return True
            opened = None
        elif x != '"' or free or not ended:
            opened = (i, x)
    sentence = re.split(r"[.!?]", line[:a])[-1]
    words = re.findall(r"[^\W_]+", sentence)
    for i, w in enumerate(words):
        if w in toxicity.REPORTING:
            rest = sentence[[m.end() for m in re.finditer(r"[^\W_]+", sentence)][i]:]
            if re.match(r"(?:\s+[^\W_]+){0,5}?(?:\s*:|\s*,?\s+(?:that|que|qu'|dass)(?!\w))", rest):
                return True
    return False


def plain_score(text, m):
    """The score by looking at every word, every term and every window, without trie or automata."""
    import math
    import re

    text = (text or "").lower()
    found = [(w.group(), w.start(), w.end()) for w in re.finditer(r"[^\W_]+", text)]
    z = m.prior
    for i, (w, a, b) in enumerate(found):
        allowed = lambda t: 0 if len(t) < 4 else 1 if len(t) < 10 else 2
        near = sorted((plain_distance(w, t), t) for t in m.terms if plain_distance(w, t) <= allowed(t))
        if any(w.startswith(s) for s in m.stems):
            kind = "stem"
        elif not near or (near[0][0] and w in m.harmless):
            continue
        else:
            kind = "exact" if near[0][0] == 0 else "near_short" if len(near[0][1]) < 8 else "near_long"
        quoted = plain_quoted(text, a, b)
        z += m.weights.get(kind + "_quoted" * quoted, 0.0)
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_are_those_of_a_plain_scorer(spark):
    import random

    rnd = random.Random(8)
    m = toxicity.Model(["horrid", "scum", "despicable", "zorkmid", "abc"], ["zork", "vile"], -1.5, {"exact": 2.0, "stem": 1.5, "near_short": 1.0, "near_long": 1.2, "exact_quoted": -0.5, "stem_quoted": -0.3, "near_short_quoted": 0.1}, frozenset(["horrit"]))
    words = ["horrid", "horid", "horrit", "scum", "scuum", "scu", "despicable", "despicabel", "desspicabl", "zorkmid", "zrkmid", "zorkish", "vilest", "abc", "abd", "clean", "said", "other", "words", "und", "Straße", "x_y"]
    texts = [" ".join(rnd.choice([w, w.upper(), f'"{w}', f'{w}"', f"{w},", f"{w}:", f"that {w}", f"{w}.", f"{w}\n", f"«{w}»"]) for w in rnd.choices(words, k=rnd.randint(0, 25))) for _ in range(300)] + [None, "", "clean " * 3000 + "scum"]
    got = toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), m).collect()
    assert all(abs(r.score - plain_score(texts[r.doc_id], m)) < 1e-12 for r in got) and len(got) == len(texts)
