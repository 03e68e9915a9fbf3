"""Main text of web pages: flat text blocks, classified by a decision tree on their own and their neighbours' shape.

A page is cut into blocks at block-level tags. Each block has its word count and link density, those of the
blocks before and after it, and what encloses it: content tags (article, main), tags of page furniture (nav,
header, footer, aside, form ...), class or id words of furniture, and whether it is a heading. Such a word counts as a whole
class, as its last part (site-header), or as its first before a word for a place (comments-area). It counts neither on article or main, nor on
a wrapper of all of a page's article and main elements, nor after no-, has- or with-, nor, on a page without article and main, on what holds most of the words
outside links, unless it is of readers' comments; a hidden element always counts. A small decision tree,
trained here on the labelled table below, tells main text from the rest. Pages are independent rows: no shuffle.

Embedded elements (video, object, iframe, svg ...) go with their content where they have an end tag; one that is closed by an enclosing
element's end, or never, holds nothing, and what follows it is read on.

A null or empty html, or one without main text, gives an empty text. Markup may be unclosed, badly nested or
cut off; scripts may hold tags in strings. Repeated rows are extracted alike; a null page_id or url is carried.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|!--|[!?/])")
CLOSING = re.compile(r""">|=\s*+(["'])""")
#: Numbers of character references without their leading zeros, and those that no character has.
ZEROS = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])")
TOO_LARGE = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{8,}+);?")
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NONE = re.compile(r"display\s*:\s*none", re.I)
#: Class words that tell of a layout, not of what an element is.
LAYOUT = re.compile(r"(?:no|not|has|with|without)[-_]", re.I)
# fixed values: element names of the HTML standard
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript".split())
#: Elements that stand for something else than their content, which goes with them where they have an end tag.
EMBEDDED = frozenset("template iframe svg math object canvas audio video".split())
CONTENT = frozenset(("article", "main"))
FURNITURE = frozenset("nav header footer aside form menu dialog button select option fieldset legend".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_ITSELF = HEADING | {"p", "li", "a"}
#: Class, id or role values that name furniture, whole, as their last part, or as their first before a word for a place.
HINTS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent contentinfo cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted related reply replies response responses search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split())
PLACES = frozenset("area articles bar block body box buttons container content div form grid group holder inner items left links list panel posts right section slot stories thread top unit zone".split())
#: Hints of what readers write, which may well be more than the article.
READERS = frozenset("comment comments commentlist disqus replies responses".split())
WORDS = re.compile(r"[\W_]+")
EMBED = re.compile(r"<(?:" + "|".join(sorted(EMBEDDED)) + r")[\s/>]", re.I)

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "in_content", "in_furniture", "hinted", "heading")
#: Labelled blocks, written by hand: the features above, then 1 for main text.
LABELLED = """
45 0 8 0 60 0 1 0 0 0 1
8 0 0 0 45 0 1 0 0 1 1
3 0 1 1 90 0 1 0 0 1 1
120 .02 40 0 33 0 1 0 0 0 1
4 0 120 0 80 0 1 0 0 0 1
1 0 60 0 2 1 1 0 0 0 1
2 0 3 0 1 0 1 0 0 0 1
15 .4 70 0 66 0 1 0 0 0 1
9 1 80 0 75 0 1 0 0 0 1
60 0 22 0 12 0 1 0 0 0 1
33 .1 5 0 2 1 1 0 0 0 1
6 0 9 0 70 0 1 0 0 1 1
250 0 10 0 5 0 1 0 0 0 1
12 0 12 0 11 0 1 0 0 0 1
7 .3 40 0 30 0 1 0 0 0 1
5 0 0 0 0 0 1 0 0 0 1
12 0 30 0 2 1 1 0 0 0 1
7 0 22 0 1 1 1 0 0 0 1
20 0 40 0 3 1 1 0 0 0 1
3 0 50 0 4 1 1 0 0 0 1
4 0 25 0 12 .9 1 0 0 0 1
2 0 18 0 2 1 1 0 0 1 1
9 0 1 1 30 0 1 0 0 0 1
16 .3 3 1 2 1 1 0 0 0 1
28 .1 2 1 3 1 1 0 0 0 1
2 1 14 0 3 1 1 0 0 0 1
1 1 1 1 1 1 0 1 0 0 0
1 1 0 0 1 1 0 1 0 0 0
2 1 1 1 6 0 0 1 0 0 0
3 0 0 0 1 1 0 1 0 0 0
14 0 55 0 0 0 0 1 0 0 0
40 0 90 0 0 0 0 1 0 0 0
22 .2 30 0 3 1 0 1 0 0 0
65 .1 20 0 30 0 0 1 0 0 0
5 0 120 0 0 0 0 1 0 1 0
110 0 2 1 40 0 0 1 0 0 0
6 0 1 1 9 0 0 0 1 0 0
25 0 2 1 10 0 0 0 1 0 0
80 0 30 0 60 0 0 0 1 0 0
17 0 6 0 8 0 0 0 1 0 0
60 0 4 1 70 0 0 0 1 0 0
40 0 100 0 0 0 0 0 1 0 0
21 .1 5 0 9 0 0 0 1 0 0
130 0 44 0 51 0 0 0 1 0 0
90 .05 12 0 140 0 0 0 1 0 0
75 0 120 0 40 0 0 1 0 0 0
150 .02 60 0 20 0 0 1 0 0 0
4 1 12 0 50 0 0 0 1 0 0
35 0 140 0 28 0 0 0 1 0 0
9 0 1 1 7 0 0 0 1 1 0
12 0 60 0 80 0 1 0 1 0 0
55 0 44 0 50 0 1 0 1 0 0
3 1 70 0 75 0 1 0 1 0 0
30 .5 66 0 58 0 1 0 1 0 0
95 0 40 0 25 0 1 0 1 0 0
2 0 50 0 50 0 1 0 1 1 0
10 0 66 0 40 0 1 1 0 0 0
3 1 80 0 70 0 1 1 0 0 0
48 0 60 0 52 0 1 1 0 0 0
6 0 45 0 33 0 1 1 0 1 0
70 0 30 0 75 0 0 0 0 0 1
55 .05 6 0 48 0 0 0 0 0 1
38 0 44 0 5 .9 0 0 0 0 1
130 .01 3 1 90 0 0 0 0 0 1
18 0 60 0 72 0 0 0 0 0 1
24 .1 35 0 40 0 0 0 0 0 1
7 0 2 1 64 0 0 0 0 1 1
10 0 4 0 88 0 0 0 0 1 1
5 0 75 0 82 0 0 0 0 1 1
20 0 3 0 30 0 0 0 0 0 1
48 0 1 1 50 0 0 0 0 0 1
50 0 50 0 1 1 0 0 0 0 1
90 0 55 0 60 0 0 0 0 0 1
200 .03 90 0 110 0 0 0 0 0 1
61 0 18 0 14 0 0 0 0 0 1
33 0 80 0 75 0 0 0 0 0 1
42 .1 1 1 2 1 0 0 0 0 1
77 0 0 0 0 0 0 0 0 0 1
28 0 64 0 0 0 0 0 0 0 1
115 0 7 0 3 0 0 0 0 0 1
58 .15 66 0 41 0 0 0 0 0 1
36 0 29 0 95 0 0 0 0 0 1
2 1 2 1 2 1 0 0 0 0 0
1 1 3 1 50 0 0 0 0 0 0
4 .9 70 0 3 1 0 0 0 0 0
6 .8 5 .9 4 1 0 0 0 0 0
12 .9 9 1 10 1 0 0 0 0 0
30 .95 25 .9 40 .9 0 0 0 0 0
3 0 2 1 2 1 0 0 0 0 0
5 0 1 1 2 1 0 0 0 0 0
6 0 60 0 2 1 0 0 0 0 0
4 0 3 0 3 0 0 0 0 0 0
2 0 1 1 1 1 0 0 0 1 0
3 0 90 0 2 1 0 0 0 1 0
8 .5 2 1 7 .6 0 0 0 0 0
25 .7 10 1 12 .8 0 0 0 0 0
"""


@dataclass
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 2) -> Node:
    """A classification tree by Gini impurity; of equal cuts the first feature's lowest."""
    node = Node(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = (2 * node.share * (1 - node.share) * len(y) - 1e-9,)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for c in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= c
            if min(low.sum(), (~low).sum()) >= least:
                impurity = sum(2 * s.mean() * (1 - s.mean()) * len(s) for s in (y[low], y[~low]))
                if impurity < best[0] - 1e-12:
                    best = (impurity, f, c, low)
    if len(best) > 1:
        _, node.feature, node.cut, low = best
        node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def trained(table: str = LABELLED) -> Node:
    rows = np.array([[float(v) for v in line.split()] for line in table.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


def is_main(tree: Node, features: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.low if features[tree.feature] <= tree.cut else tree.high
    return tree.share >= 0.5


def is_hidden(attributes: str) -> bool:
    """By the attribute hidden, aria-hidden=true or display:none."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for name, *value in ATTRIBUTE.findall(low):
        v = "".join(value)
        if name == "hidden" or (name == "aria-hidden" and v.strip() == "true") or (name == "style" and NONE.search(v)):
            return True
    return False


def hint_of(attributes: str) -> str:
    """The word of a class, id or role that names furniture, or nothing."""
    for found in NAME.findall(attributes):
        for v in "".join(found).lower().split():
            parts = [x for x in WORDS.split(v) if x]
            if not parts or LAYOUT.match(v):
                continue
            if parts[-1] in HINTS:
                return parts[-1]
            if parts[0] in HINTS and parts[-1] in PLACES:
                return parts[0]
    return ""


def tags(page: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(text before, "/" or nothing, name, attributes, place behind) of each tag; at last ("text", "", "", "", end). Every character is looked at a fixed number of times.

    As browsers do: a quote opens a value only behind =, a tag goes on to the first > outside values whatever it meets, and one that the
    page's end cuts off takes the rest with it. A quote that is never closed opens nothing. Whoever reads may send the place to go on from.
    """
    at, n = 0, len(page)
    while m := OPENING.search(page, at):
        before = page[at:m.start()]
        name, i = m[2], m.end()
        if not name:
            if m[0] == "<!--":
                end = page.find("-->", i - 2)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", i)
                at = n if end < 0 else end + 1
            yield before, "", "", "", at
            continue
        while (e := CLOSING.search(page, i)) and e[1]:
            end = page.find(e[1], e.end())
            i = e.end() if end < 0 else end + 1
        if not e:
            yield before, "", "", "", n
            return
        at = e.end()
        at = (yield before, m[1], name.lower(), page[m.end():e.start()], at) or at
    yield page[at:], "", "", "", n


def decoded(text: str) -> str:
    """With character references decoded; a number of any length is read."""
    return entities.unescape(TOO_LARGE.sub("\ufffd", ZEROS.sub(r"&#\1", text)) if "&#" in text else text)


def embedded(page: str) -> dict[int, int]:
    """Where the content of embedded elements ends, by where it starts. One that an enclosing element's end closes holds nothing."""
    out: dict[int, int] = {}
    if not EMBED.search(page):
        return out
    stack: list[tuple[str, int]] = []
    names: dict[str, int] = {}
    reader, at = tags(page), None
    while True:
        try:
            _, slash, name, attributes, go_on = reader.send(at)
        except StopIteration:
            return out
        at = None
        if not name:
            continue
        if slash:
            closed = None if names.get(name) else name
            while closed != name:
                closed, start = stack.pop()
                names[closed] -= 1
                if closed == name and name in EMBEDDED:
                    out[start] = go_on
        elif name in RAW:
            at = raw_end(page, name, go_on)
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            if name in CLOSES_ITSELF and stack and stack[-1][0] == name:
                names[stack.pop()[0]] -= 1
            stack.append((name, go_on))
            names[name] = names.get(name, 0) + 1


def raw_end(page: str, name: str, at: int) -> int:
    """Behind the end tag of an element that holds text only, or the page's end."""
    end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
    end = page.find(">", end.end() - 1) if end else -1
    return end + 1 if end >= 0 else len(page)


def blocks(page: str | None) -> list[tuple[str, int, int, bool, bool, bool, bool]]:
    """(text, words, words in links, in content, in furniture, hinted, heading) in page order."""
    out: list = []
    stack: list[tuple[str, int]] = []  # open elements that matter, and the number of a hint, -1 if hidden, else 0
    content = furniture = hidden = link = heading = contents = 0
    open_hints = [0]
    inside = [0]  # by number of a hint: article and main elements before it, then within it
    around, hints = [0], [""]  # by number of a hint: the one around it, and its word
    names: dict[str, int] = {}  # open elements by name
    text: list[str] = []
    linked = 0
    begun = False
    state: tuple = (False, False, 0, False)

    def flush() -> None:
        nonlocal linked, begun
        body = " ".join(decoded("".join(text)).split())
        if body:
            out.append((body, body.count(" ") + 1, linked, *state))
        text.clear()
        linked, begun = 0, False

    def add(part: str) -> None:
        nonlocal linked, state, begun
        if not part:
            return
        if part.strip():
            if not begun:
                begun = True
                state = (content > 0, furniture > 0, -1 if hidden else open_hints[-1], heading > 0)
            if link:
                linked += len(part.split())
        text.append(part)

    def count(name: str, hint: int, by: int) -> None:
        nonlocal content, furniture, hidden, link, heading, contents
        names[name] = names.get(name, 0) + by
        contents += by > 0 and name in CONTENT
        content += by * (name in CONTENT)
        furniture += by * (name in FURNITURE)
        heading += by * (name in HEADING)
        link += by * (name == "a")
        hidden += by * (hint < 0)
        if hint > 0:
            inside[hint] = contents - inside[hint]
            if by > 0:
                open_hints.append(hint)
            else:
                open_hints.pop()

    page = page or ""
    ends = embedded(page)
    reader = tags(page)
    at = None
    while True:
        try:
            before, slash, name, attributes, at = reader.send(at)
        except StopIteration:
            break
        add(before)
        go_on, at = at, None
        if not name:
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            add(" ")
        if slash:  # an end tag closes all that was opened since, but nothing if there is no such element
            closed = None if names.get(name) else name
            while closed != name:
                closed, h = stack.pop()
                count(closed, h, -1)
            continue
        if name in RAW:
            at = raw_end(page, name, go_on)
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in EMBEDDED:
            at = ends.get(go_on)
            continue
        if name in CLOSES_ITSELF and stack and stack[-1][0] == name:  # these do not nest
            count(*stack.pop(), -1)
        hint = 0
        if attributes and name not in ("html", "body"):
            if is_hidden(attributes):
                hint = -1
            elif name not in CONTENT and (word := hint_of(attributes)):
                hint = len(inside)
                inside.append(0)
                around.append(open_hints[-1])
                hints.append(word)
        stack.append((name, hint))
        count(name, hint, 1)
    flush()
    while stack:
        count(*stack.pop(), -1)
    held = [0] * len(inside)  # by number of a hint: unlinked words within it
    for _, words, in_links, _, in_furniture, hint, _ in out:
        if hint >= 0 and not in_furniture:
            held[hint] += words - in_links
    for h in range(len(held) - 1, 0, -1):
        held[around[h]] += held[h]

    def names_furniture(h: int) -> bool:
        if contents:
            return not 0 < inside[h] == contents
        return hints[h] in READERS or 2 * held[h] <= held[0]

    # the innermost hint decides: if it holds all content, so do those around it
    counts = [h > 0 and names_furniture(h) for h in range(len(inside))]
    return [(*row[:5], row[5] < 0 or counts[row[5]], row[6]) for row in out]


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page)
    shape = [(0, 0.0), *((w, k / w) for _, w, k, *_ in found), (0, 0.0)]
    kept = []
    for i, (text, _, _, *where) in enumerate(found, 1):
        if is_main(tree, (*shape[i], *shape[i - 1], *shape[i + 1], *where)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    tree = trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h, tree) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
