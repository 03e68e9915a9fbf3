"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from labelled documents: words, and stems that start several such words, which occur in many
different contexts (neighbouring words) of toxic documents and hardly elsewhere. Counting contexts instead of
documents keeps copies of one document from lending weight to its words. The lexicon becomes a trie; walking a
word along the trie and a Levenshtein automaton at once finds terms within a bounded number of edits: one from four letters
on, two from ten. Words that a stem covers are terms as well, so that their misspellings are found. The walk's states are sets of
(node, edits), made when first met and kept, so that most words end after a few characters. A word near a term that the
labelled documents show to be harmless is no hit. A hit
between marks that open and close a quotation, or governed by a word of reporting, is counted apart from a plain one. Each kind of hit has a log likelihood ratio measured on the
labelled documents, that of misspellings being drawn towards that of the words themselves, and a score is the logistic of their sum.

Bound: at most max_labelled labelled documents (those of the smallest hash) are used to learn, which bounds the lexicon as well;
scoring covers every whole text. Labels, lang, source and doc_id are no input of a score.

Nulls: a null or empty text has no hits and gets the prior; labels with a null id or label are ignored; a
document with several labels counts once for each. Without any usable label the lexicon is empty, and every score is the
prior 0.1. Repeated rows are scored alike. Ties: of terms equally near to a word the alphabetically first counts; of labelled
documents with one hash that of the smaller id comes first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash60

TOKEN = re.compile(r"[^\W_]+")
#: Quotation marks, or the end of a line, beyond which none is closed.
MARKS = re.compile("[\"\u201c\u201d\u201e\u00ab\u00bb\u2039\u203a\n]")
#: What closes a quotation, by what opens it; a straight mark opens or closes by the side on which it stands.
CLOSED_BY = {'"': '"', "\u201c": "\u201d", "\u201d": "\u201d", "\u201e": "\u201c\u201d", "\u00ab": "\u00bb", "\u00bb": "\u00ab", "\u2039": "\u203a", "\u203a": "\u2039"}
#: Words that report somebody else's words, in the languages of the corpus.
REPORTING = frozenset("said says wrote called quote quoted quotes reported allegedly dit écrit cité selon sagte schrieb zitat zitiert laut dijo escribió citó según".split())
#: A reporting word governs what follows it up to the sentence's end, behind a colon or a word for "that" within so many words of it.
WINDOW = 6
GOVERNED = re.compile(r"\b(?:" + "|".join(sorted(REPORTING)) + r")\b(?:[^\S\n]+[^\W_]+){0,%d}?(?:[^\S\n]*:|[^\S\n]*,?[^\S\n]+(?:that|que|qu'|dass)(?!\w))([^.!?\n]*)" % (WINDOW - 1))
KINDS = ("exact", "stem", "near_short", "near_long")
CACHE_WORDS = 400_000
#: Letters of a stem at most: more than any word's stem has, so that a run of letters without end is not cut at every one of them.
LONGEST = 64
#: Hits of a kind of misspelling that count as much as what is known of the words themselves.
SHRINK = 20
#: The share of a word's contexts in toxic documents that makes it a term; below it, a word met in clean ones is no misspelling.
SHARE = 0.95


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    prior: float = math.log(0.1 / 0.9)
    weights: dict[str, float] = field(default_factory=dict)  # by kind, or kind + "_quoted"
    harmless: frozenset[str] = frozenset()  # words near a term that are words of their own


def edits_for(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 10 else 2


class FuzzyTrie:
    """The intersection of the trie and the automata, made a state at a time."""

    DEAD, STEM = 0, 1

    def __init__(self, terms: list[str], stems: list[str], harmless: frozenset[str] = frozenset()):
        self.harmless = harmless
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.deep: list[int] = [-1]  # most edits that a term below a node allows
        self.stem_at: set[int] = set()
        for w, stem in [(t, False) for t in terms] + [(s, True) for s in stems]:
            n = 0
            for c in w:
                n = self.next[n].setdefault(c, len(self.next))
                if n == len(self.next):
                    self.next.append({})
                    self.word.append(None)
                    self.deep.append(-1)
                self.deep[n] = max(self.deep[n], 0 if stem else edits_for(w))
            if stem:
                self.stem_at.add(n)
            else:
                self.word[n] = w
        self.deep[0] = max(self.deep)
        self._reset()
        self.cache: dict[str, tuple[str, int] | None] = {}

    def _reset(self) -> None:
        self.sets: list[frozenset] = [frozenset(), frozenset(["stem"]), self._closed({0: 0})]
        self.ids = {s: i for i, s in enumerate(self.sets)}
        self.steps: list[dict[str, int]] = [{}, {}, {}]

    def _closed(self, at: dict[int, int]) -> frozenset:
        """With what skipping term characters reaches; at has the fewest edits by node."""
        todo = list(at.items())
        while todo:
            n, e = todo.pop()
            for m in self.next[n].values():
                if e + 1 <= self.deep[m] and at.get(m, 9) > e + 1:
                    at[m] = e + 1
                    todo.append((m, e + 1))
        return frozenset(at.items())

    def _step(self, state: int, c: str) -> int:
        at: dict[int, int] = {}
        for n, e in self.sets[state]:
            if e + 1 <= self.deep[n] and at.get(n, 9) > e + 1:  # a character too many
                at[n] = e + 1
            for d, m in self.next[n].items():
                if d == c:
                    if e == 0 and m in self.stem_at:
                        self.steps[state][c] = self.STEM
                        return self.STEM
                    if e <= self.deep[m]:
                        at[m] = min(at.get(m, 9), e)
                elif e + 1 <= self.deep[m]:  # another character
                    at[m] = min(at.get(m, 9), e + 1)
        s = self._closed(at)
        i = self.ids.get(s)
        if i is None:
            i = self.ids[s] = len(self.sets)
            self.sets.append(s)
            self.steps.append({})
        self.steps[state][c] = i
        return i

    def find(self, word: str) -> tuple[str, int] | None:
        """(kind, edits) of the nearest term, or None."""
        try:
            return self.cache[word]
        except KeyError:
            pass
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        if len(self.sets) >= 100_000:
            self._reset()
        state = 2
        for c in word:
            i = self.steps[state].get(c)
            state = self._step(state, c) if i is None else i
            if state < 2:
                break
        found = None
        if state == self.STEM:
            found = ("stem", 0)
        elif state:
            ends = [(e, self.word[n]) for n, e in self.sets[state] if self.word[n] is not None and e <= edits_for(self.word[n])]
            if ends:
                e, term = min(ends)
                if e == 0 or word not in self.harmless:
                    found = ("exact" if e == 0 else "near_short" if len(term) < 8 else "near_long", e)
        self.cache[word] = found
        return found


def quotations(text: str) -> list[tuple[int, int]]:
    """Where others are quoted: between marks that open and close on one line, and what a reporting word governs.

    A straight mark with white space or an opening bracket before it opens, one with no word behind it closes, and otherwise it does what is due. A mark that
    opens again stands for the one before it, which was never closed; one that closes nothing is no mark.
    """
    out, opened, at = [], "", 0
    for m in MARKS.finditer(text):
        mark, i = m[0], m.start()
        if mark == "\n":
            opened = ""
            continue
        closes = mark in CLOSED_BY.get(opened, "")
        opens = True
        if mark == '"':
            before, behind = text[i - 1:i], text[i + 1:i + 2]
            opens, shuts = (not before or before.isspace() or before in "([{"), not behind.isalnum()
            closes = closes and (shuts or not opens)
            opens = opens or not shuts
        if closes:
            out.append((at, i))
            opened = ""
        elif opens:
            opened, at = mark, i
    return sorted(out + [m.span(1) for m in GOVERNED.finditer(text)])


def hits(text: str | None, trie: FuzzyTrie) -> dict[str, int]:
    """How often each kind of hit occurs; those quoted or reported under kind + "_quoted"."""
    text = (text or "").lower()
    found = list(map(trie.find, TOKEN.findall(text)))
    out: dict[str, int] = {}
    if not any(found):
        return out
    spans = quotations(text)
    at, ends = 0, 0
    for f, m in zip(found, TOKEN.finditer(text), strict=True):
        if f:
            while at < len(spans) and spans[at][0] <= m.start():
                ends = max(ends, spans[at][1])
                at += 1
            kind = f[0] + "_quoted" * (m.end() <= ends)
            out[kind] = out.get(kind, 0) + 1
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """text, toxic of at most max_labelled labelled documents outside the held-out third."""
    use = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter("label_id IS NOT NULL AND toxic IS NOT NULL")
    use = use.filter(~held_out(F.col("label_id")))
    ids = use.orderBy(hash60(F.lit("toxic"), F.col("label_id").cast("string")), "label_id", "toxic").limit(max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, min_contexts: int = 5) -> Model:
    train = cut(labelled(docs, labels, max_labelled).distinct())
    size = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Model()

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                w = TOKEN.findall((text or "").lower())
                ring = ["", *w, ""]
                c = [xxhash.xxh32_intdigest(f"{x} {z}") for x, z in zip(ring, ring[2:], strict=False)]
                yield pd.DataFrame({"word": w, "context": c, "toxic": toxic, "doc": xxhash.xxh32_intdigest(text or "")}).drop_duplicates()

    # a context counts once, for one document that has it, and a word mostly met in the same contexts is that of near copies
    seen = train.mapInPandas(contexts, "word string, context long, toxic int, doc long").groupBy("word", "context", "toxic").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n"))
    words = cut(seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("doc"))).alias("d"), F.sum(F.col("toxic") * F.col("n")).alias("n")))
    fit = lambda share: (F.col("t") >= min_contexts) & (F.col("t") >= share * (F.col("t") + F.col("c")))
    stems = (words.withColumn("stem", F.explode(F.transform(F.filter(F.sequence(F.lit(4), F.lit(LONGEST)), lambda n: n < F.length("word")), lambda n: F.substr("word", F.lit(1), n))))
             .groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum((F.col("t") > 0).cast("int")).alias("n"))
             .filter(fit(0.995) & (F.col("t") > min_contexts) & (F.col("n") >= 3)))
    found = {r["stem"]: r["t"] for r in stems.select("stem", "t").collect()}  # of the labelled documents, at most max_labelled
    chosen: list[str] = []
    for s in sorted(found, key=lambda x: (len(x), x)):
        if not any(s.startswith(x) for x in chosen):  # as long as it may be without losing words
            chosen.append(max((x for x in found if x.startswith(s) and found[x] >= 0.98 * found[s]), key=lambda x: (len(x), x)))
    terms = [r["word"] for r in words.filter(fit(SHARE) & (F.col("d") >= 3) & (2 * F.col("t") > F.col("n"))).orderBy(F.desc("t"), "word").select("word").collect()]

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = FuzzyTrie(terms, chosen)
        for b in batches:
            b = b.assign(kind=[(trie.find(w) or ("",))[0] for w in b["word"]])
            yield b[b["kind"].str.startswith("near")][["word", "kind", "once"]]

    own = words.filter((F.col("c") > 0) & (F.col("t") < SHARE * (F.col("t") + F.col("c")))).select("word", (F.col("t") + F.col("c") == 1).alias("once"))
    harmless = own.mapInPandas(near, "word string, kind string, once boolean").collect()
    model = Model(terms, chosen, harmless=frozenset(r["word"] for r in harmless))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = FuzzyTrie(terms, chosen, model.harmless)
        for b in batches:
            rows = [(k, int(y), n) for t, y in zip(b["text"], b["toxic"], strict=True) for k, n in hits(t, trie).items()]
            rows += [("words", int(y), len((t or "").split())) for t, y in zip(b["text"], b["toxic"], strict=True)]
            yield pd.DataFrame(rows, columns=["kind", "toxic", "n"])

    n = {(r["kind"], r["toxic"]): r["n"] for r in train.mapInPandas(count, "kind string, toxic int, n long").groupBy("kind", "toxic").agg(F.sum("n").alias("n")).collect()}
    total = {y: max(1, n.get(("words", y), 0)) for y in (0, 1)}
    for r in harmless:  # as many new harmless words are to be expected as were met once
        if r["once"]:
            n[r["kind"], 0] = n.get((r["kind"], 0), 0) + 1
    bound = lambda x: max(-1.0, min(6.0, x))
    for tail, guess in (("", 1.0), ("_quoted", -0.5)):
        seen = lambda y, *kinds: sum(n.get((k + tail, y), 0) for k in kinds)  # noqa: B023, E731
        ratio = lambda *kinds: math.log((seen(1, *kinds) + 0.5) / total[1]) - math.log((seen(0, *kinds) + 0.5) / total[0])  # noqa: B023, E731
        # a hit not met in training gets a guess: abuse if plain, rather not if quoted
        known = bound(ratio("exact", "stem")) if seen(0, "exact", "stem") + seen(1, "exact", "stem") >= 5 else guess
        for k in KINDS:
            hits_of = seen(0, k) + seen(1, k)
            if k.startswith("near"):
                model.weights[k + tail] = bound((hits_of * ratio(k) + SHRINK * known) / (hits_of + SHRINK))
            else:
                model.weights[k + tail] = guess if hits_of < 5 else bound(ratio(k))
    model.prior = math.log(min(0.5, size[1] / size[0])) - 0.5
    return model


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with a column out, from the text alone."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = FuzzyTrie(model.terms, model.stems, model.harmless)
        for b in batches:
            z = np.array([model.prior + sum(n * model.weights.get(k, 0.0) for k, n in hits(t, trie).items()) for t in b["text"]], float)
            yield b.assign(**{out: 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return docs.mapInPandas(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs, labels, **bounds))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.7, **bounds) -> DataFrame:
    """The rows of docs whose score is below limit, all columns as they were."""
    model = learn(docs, labels, **bounds)
    wrapped = docs.select(F.struct("*").alias("row"), "text")

    @F.pandas_udf("double")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = FuzzyTrie(model.terms, model.stems, model.harmless)
        for s in parts:
            z = np.array([model.prior + sum(n * model.weights.get(k, 0.0) for k, n in hits(t, trie).items()) for t in s], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return wrapped.filter(toxic("text") < limit).select("row.*")
