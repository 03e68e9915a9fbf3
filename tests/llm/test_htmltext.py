import html
import random
import re
import time
from html.parser import HTMLParser
from pathlib import Path

import pytest

from tallyworks.llm import htmltext

TREE = htmltext.trained()
PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>"; x = "<p>no</p>";</script></head>
<body class="page"><header><a href=/>Home</a> Site name</header><nav><ul><li><a href="/a">One</a></li><li><a>Two</a></ul></nav><!-- <p>ad</p> --><div class="ad">Buy now, it is cheap.</div>
<div class="cookie-notice"><p>We use cookies on this site to make it work better for all of you who read it.</p></div>
<article><h1>A head&shy;line &amp more</h1><p><b>First   paragraph\n of   text.<br>Next line.<p>Second &lt;b&gt; one.</p><aside>Read also this</aside><p>Short.</p><ul><li>item one<li>item two</ul>
<section id="comments"><p>I think this is a very good article, thanks for writing it, says a reader.</p></section></article>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; site"""


def test_page():
    assert htmltext.main_text(PAGE, TREE).split("\n") == ["A head­line & more", "First paragraph of text. Next line.", "Second <b> one.", "Short.", "item one", "item two"]


def test_without_content_tags():
    text = "word " * 50
    page = f"<body><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul><div>{text}</div><div>{text}</div><p><a href=4>More</a></p><p><a href=5>Yet more</a></p>"
    assert htmltext.main_text(page, TREE) == "\n".join([text.strip()] * 2)


def test_broken_pages():
    for page in (None, "", "<", "<p", "<article><p>a", "</div></p>", "<script>never closed", "<!-- never closed", "a < b > c", "<a href='x>y", "<article>" * 3000 + "deep" + "</article>" * 3000):
        assert isinstance(htmltext.main_text(page, TREE), str)
    assert htmltext.main_text("<article><p>some words <foo", TREE) == "some words"


def test_table(spark):
    rows = [(1, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1), (None, None, None, "x", 1), (3, "v", "", None, None), (4, "w", "<article><p>" + "long " * 200000, "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(htmltext.extract(df).collect(), key=str)
    assert len(got) == 5 and {r.n_chars for r in got} >= {0, 999999} and all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_hints_of_layout_and_hidden():
    body = "word " * 40
    article = f"<article><p>{body}</p><p>{body}</p></article>"
    both = "\n".join([body.strip()] * 2)
    for wrap in ("class='overflow-hidden'", "aria-hidden='false'", "style='overflow:hidden'", "data-x='hidden'", "class='no-sidebar'", "class='page has-comments'", "class='with-banner'", "class='sidebar'", "id=search class='a'"):
        assert htmltext.main_text(f"<body><div {wrap}>{article}</div>", TREE) == both, wrap
        assert htmltext.main_text(f"<body>{article.replace('<article', '<article ' + wrap)}", TREE) == both, wrap
    for wrap in ("hidden", "hidden=''", "aria-hidden=true", 'aria-hidden="true"', "style='color:red; display : none'"):
        assert htmltext.main_text(f"<body><div {wrap}>{article}</div>", TREE) == "", wrap
    # furniture beside the article, or one that holds only some of the articles, is still none of it
    for other in (f"<div class='sidebar'><p>{body}other</p></div>", f"<div class='related'><article><p>{body}other</p></article></div>", f"<div class='has-x comments'><p>{body}other</p></div>"):
        assert htmltext.main_text(f"<body><div class='has-sidebar'>{article}{other}</div>", TREE) == both, other


BODY = "word " * 40
PARAGRAPHS = [f"{i} {BODY.strip()}" for i in range(5)]
MARKUP = [f"<p>{p}</p>" for p in PARAGRAPHS]


@pytest.mark.parametrize("name", sorted(htmltext.EMBEDDED))
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>", "<main>{}"])
def test_embedded_elements(name, around):
    read = lambda *parts: htmltext.main_text("<body><nav><a href=/>Home</a></nav>" + around.format("".join(parts)) + "<footer>Own site</footer>", TREE).split("\n")
    a, *rest = MARKUP
    for tag in (f"<{name} src=x>", f"<{name}>", f"<{name} src=x />", f"<div><{name} src=x></div>", f"<p><{name} src=x></p>", f"<{name} src=x></{name}>", f"<{name}>Your browser <b>can't</b> show this.</{name}>",
                f"<{name} src=x><source src=y><{name}>no</{name}>", f"<{name}><{name}>no</{name}>no</{name}>"):
        assert read(a, tag, *rest) == PARAGRAPHS, tag
    assert read(a, f"<{name} src=x>", *rest[:2], f"<div><{name}>no</{name}></div>", *rest[2:]) == PARAGRAPHS
    assert read("<p>" + PARAGRAPHS[0] + f" <{name}>no</{name}></p>", *rest) == PARAGRAPHS


@pytest.mark.parametrize("tag", ["article", "div", "main", "section"])
@pytest.mark.parametrize("wrap", ["post comments-open", "page-header-wrap", "article-footer-visible", "menu-open page", "sidebar-right-layout", "share-enabled", "notice-shown", "social", "site-header"])
def test_wrappers_with_hint_words(tag, wrap):
    other = "<div class='site-header'><p>Name of the site</p></div><div class='cookie-notice'>We use cookies here.</div>"
    comments = "<div class='comments-area'><p>Thanks for a good read, this was new to me.</p></div>"
    for inner in ("{}", "<div>{}</div>"):
        page = f"<body>{other}<{tag} class='{wrap}'>{inner.format(''.join(MARKUP))}</{tag}>{comments}"
        assert htmltext.main_text(page, TREE).split("\n") == PARAGRAPHS
        page = f"<body>{other}<div class='{wrap}'><article>{inner.format(''.join(MARKUP))}</article></div>{comments}"
        assert htmltext.main_text(page, TREE).split("\n") == PARAGRAPHS


def test_furniture_by_hint_words():
    for wrap in ("comments", "comment-list", "comments-area", "site-footer", "cookie-notice", "related-posts", "ad", "ad-slot", "sidebar-left", "newsletter-form", "share-buttons", "main-menu"):
        for page in (f"<article>{''.join(MARKUP)}</article>", f"<div class=post>{''.join(MARKUP)}</div>"):
            assert htmltext.main_text(f"<body>{page}<div class='{wrap}'><p>{BODY}</p></div>", TREE).split("\n") == PARAGRAPHS, wrap
    many = "".join(f"<p>{BODY} by a reader</p>" for _ in range(20))
    assert htmltext.main_text(f"<body><div>{''.join(MARKUP)}</div><div id=comments>{many}</div>", TREE).split("\n") == PARAGRAPHS


HOSTILE = {
    "embedded": "<video>" * 50_000 + "<object></p>" * 20_000,
    "embedded and ended": "<svg>" * 30_000 + "</svg>" * 30_000,
    "quotes": "<a title=" + "\"" * 100_001,
    "mixed quotes": "<a title=" + "\"'" * 50_000 + "x",
    "values": "<a " + "b=\"c" * 50_000,
    "unclosed tags": "<a " * 100_000,
    "unclosed values": "<a b='" * 50_000 + "<a b=\"" * 50_000,
    "spaces": "<a b =" + " " * 100_000 + "= " * 50_000,
    "end tags of nothing": "<div>" * 50_000 + "</x>" * 50_000,
    "blank inlines": "<p>" + "<b> </b>" * 50_000 + "word",
    "scripts": "<script>" + "</script " * 50_000,
    "comments": "<!--" * 50_000,
    "deep": "<b>" * 50_000 + "x" + "</b>" * 50_000,
    "angles": "<" * 100_000,
    "class words": "<p class='" + "a " * 50_000 + "'>x",
    "classes": "<p " + "class=" * 50_000 + ">x",
    "references": "<p>" + "&" * 100_000 + "&#" * 50_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    page = "<article><p>some words here</p>" + HOSTILE[name]
    t = time.process_time()
    assert htmltext.main_text(page, TREE).startswith("some words here")
    assert time.process_time() - t < 1.5


def test_numbers_of_references():
    page = "<article><p>a&#65;&#0000000000066;&#x43;&#X000000000044; &#" + "9" * 5000 + "; &#x" + "f" * 5000 + "; &#" + "0" * 5000 + "69;</p>"
    assert htmltext.main_text(page, TREE) == "aABCD \ufffd \ufffd E"


def test_tags_end_as_in_browsers():
    for tag, rest in (("<a title='1 > 0'>", "x"), ('<a title=">">', "x"), ("<a title = '>'>", "x"), ("<a b\"c>", "x"), ("<a 'b>", "x"), ("<a href=it's>", "x"), ("<a b=\"never closed>", "x"),
                      ("<!-- > -->", "x"), ("<!-->", "x"), ("<!doctype x>", "x"), ("<?php echo ?>", "x"), ("</>", "x"), ("</ b>", "x"), ("<svg/>", "x"), ("<script>'<p>'</script >", "x")):
        assert htmltext.main_text(f"<article><p>some words {tag}{rest}</p>", TREE) == f"some words {rest}", tag
    assert htmltext.main_text("<article><p>1 < 2 and 2 > 1</p>", TREE) == "1 < 2 and 2 > 1"


class Plain(HTMLParser):
    """The blocks' texts by the standard library's parser, without looking at what encloses them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.skip = [], [], 0

    def flush(self):
        body = " ".join("".join(self.text).split())
        self.text = []
        if body:
            self.out.append(body)

    def handle_starttag(self, tag, attrs):
        self.flush() if tag in htmltext.BLOCK else self.text.append(" ") if tag == "br" else None
        self.skip += tag in htmltext.RAW | htmltext.EMBEDDED

    def handle_startendtag(self, tag, attrs):
        self.flush() if tag in htmltext.BLOCK else self.text.append(" ") if tag == "br" else None

    def handle_endtag(self, tag):
        if tag in htmltext.BLOCK and tag not in htmltext.RAW:
            self.flush()
        self.skip -= tag in htmltext.RAW | htmltext.EMBEDDED

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def plain_blocks(page):
    p = Plain()
    p.feed(page)
    p.close()
    p.flush()
    return p.out


def made_page(rng):
    """Well-nested markup of random tags, attributes and references."""
    words = ["word", "a &amp; b", "&lt;i&gt;", "caf&eacute;", "&#233;t&#xe9;", "x > y", "1 &copy 2", "tab\tnew\nline"]

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        name = rng.choice(["p", "div", "span", "b", "a", "ul", "h2", "section", "article", "nav", "aside", "script", "td"])
        attribute = rng.choice(["", " class='x'", ' href="/a?b=1&c=2"', " title='1 > 0'", ' alt="it\'s"', " hidden", "\n id = y"])
        body = "var a = '<p>no</p>';" if name == "script" else "".join(part(depth - 1) for _ in range(rng.randint(1, 4)))
        return f"<{name}{attribute}>{body}</{name}>" + rng.choice(["", "<br>", "<!-- <p>gone</p> -->", " tail ", "<img src=x>"])

    return "<html><body>" + "".join(part(4) for _ in range(5)) + "</body></html>"


def test_blocks_are_those_of_another_parser():
    rng = random.Random(3)
    for _ in range(300):
        page = made_page(rng)
        if "<p" in page and any(f"<p{x}" in page for x in ("><p", "><div")):
            continue
        assert [b[0] for b in htmltext.blocks(page)] == plain_blocks(page), page


class Tree(HTMLParser):
    """Blocks with what encloses them, from the elements as a tree; for well-nested pages only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.rows, self.parts, self.all = [], [], [], []

    def flush(self):
        body = " ".join("".join(p for p, _ in self.parts).split())
        if body:
            first = next(c for p, c in self.parts if p.strip())
            linked = sum(len(p.split()) for p, c in self.parts if any(e["name"] == "a" for e in c))
            self.rows.append((body, len(body.split()), linked, first))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in htmltext.BLOCK:
            self.flush()
        if tag == "br":
            self.parts.append((" ", list(self.open)))
        elif tag not in htmltext.VOID:
            self.open.append({"name": tag, "hidden": "hidden" in dict(attrs), "class": dict(attrs).get("class") or "", "content": 0})
            self.all.append(self.open[-1])
            if tag in ("article", "main"):
                for e in self.open:
                    e["content"] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in htmltext.BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in htmltext.BLOCK:
            self.flush()
        assert self.open.pop()["name"] == tag

    def handle_data(self, data):
        if not any(e["name"] in htmltext.RAW | htmltext.EMBEDDED for e in self.open):
            self.parts.append((data, list(self.open)))

    def text(self, page):
        self.feed(page)
        self.close()
        self.flush()
        contents = sum(e["name"] in ("article", "main") for e in self.all)
        word = lambda e: {"comments": "comments", "comments-area": "comments", "site-header": "header", "ad": "ad", "related-posts": "related"}.get(e["class"]) if e["name"] not in ("article", "main") else None
        in_furniture = lambda c: any(e["name"] in htmltext.FURNITURE for e in c)
        held = lambda e: sum(w - k for _, w, k, c in self.rows if (e is None or any(x is e for x in c)) and not in_furniture(c) and not any(x["hidden"] for x in c))

        def hinted(c):
            if any(e["hidden"] for e in c):
                return True
            named = [e for e in c if word(e) and not e["hidden"]]
            if not named:
                return False
            e = named[-1]
            if contents:
                return not (e["content"] and e["content"] == contents)
            return word(e) == "comments" or 2 * held(e) <= held(None)

        shape = [(0, 0.0), *((w, k / w) for _, w, k, _ in self.rows), (0, 0.0)]
        out = []
        for i, (body, _, _, c) in enumerate(self.rows, 1):
            where = (any(e["name"] in ("article", "main") for e in c), in_furniture(c), hinted(c), any(e["name"] in htmltext.HEADING for e in c))
            if htmltext.is_main(TREE, (*shape[i], *shape[i - 1], *shape[i + 1], *where)):
                out.append(body)
        return "\n".join(out)


def test_main_text_is_that_of_a_plain_classifier():
    rng = random.Random(8)
    said = 0

    def part(depth, inline):
        if depth == 0 or rng.random() < 0.25:
            return " ".join("word &amp; more".split()[rng.randint(0, 2)] for _ in range(rng.choice([1, 3, 8, 40])))
        names = ["b", "a", "span"] if inline else ["p", "div", "ul", "h2", "section", "nav", "aside", "table", "b", "footer", "blockquote"] + ["article", "main"] * rng.randint(0, 1)
        name = rng.choice(names)
        attribute = rng.choice([""] * 6 + [" class='comments'", " class='comments-area'", " class='site-header'", " class='ad'", " class='related-posts'", " class='post comments-open'", " class='no-sidebar'", " hidden"])
        body = "".join(part(depth - 1, inline or name in ("p", "h2", "b", "a", "span")) for _ in range(rng.randint(1, 4)))
        return f"<{name}{attribute}>{body}</{name}>" + rng.choice(["", "", "<br>", "<video>no</video>", "<svg><b>no</b></svg>", " tail "])

    for _ in range(600):
        page = "<html><body>" + "".join(part(4, False) for _ in range(4)) + "</body></html>"
        if re.search(r"<a\b[^>]*>(?:(?!</a>).)*<a\b", page):  # links do not nest
            continue
        got = htmltext.main_text(page, TREE)
        assert got == Tree().text(page), page
        said += bool(got)
    assert said > 150


def test_given_pages(spark):
    """Each given page has one article: the extracted text is its blocks, less what is furniture inside it."""
    path = Path("/root/testdata/sf0.001/pages.parquet")
    if not path.exists():
        pytest.skip("no given tables")
    pages = spark.read.parquet(str(path))
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        every = plain_blocks(r.html)
        lines = got[r.page_id].split("\n") if got[r.page_id] else []
        at = iter(every)
        assert all(line in at for line in lines)  # blocks of the page, in its order
        article = html.unescape(r.html[r.html.find("<article"):r.html.find("</article>")]) if "<article" in r.html else None
        assert article is None or all(line.split(" ")[0] in article for line in lines)
