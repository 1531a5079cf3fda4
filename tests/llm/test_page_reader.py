"""The page reader against a slow one that builds the whole tree, and names of elements."""

import random
import time
from html.parser import HTMLParser

import pytest

from tarnflow.llm import html_extract

GONE = ["ad", "advert", "notice", "comment", "advert-slot-300x250", "user-comment", "comment-body", "comment__body", "share-this", "gdpr-message", "adsbygoogle", "notice-board", "advert-premium"]
STAYS = ["lead", "legal-analysis", "search-results", "comment-analysis", "has-sidebar", "no-comments", "share-price-history", "cookie-policy-explained", "market-news", "layout-sidebar-left", "adventure", "shared"]


@pytest.mark.parametrize("tag", ["p", "div", "h2", "section", "li"])
def test_names_that_say_what_an_element_is(tag):
    for name in GONE:
        assert html_extract.text_of(f"<article><p>kept</p><{tag} class='{name}'>out</{tag}></article>")[0] == "kept", name
    for name in STAYS:
        assert html_extract.text_of(f"<article><p>kept</p><{tag} class={name}>in</{tag}></article>")[0] == "kept\nin", name


def test_ids_of_headings_are_content():
    assert html_extract.text_of("<article><h2 id='data-sharing'>Sharing</h2><div id=comments>out</div><p>text</p></article>")[0] == "Sharing\ntext"


def test_cdata_is_a_comment():
    assert html_extract.text_of("<p>a</p><![CDATA[x]]><p>b</p>")[0] == "a\nb"


@pytest.mark.parametrize("make", [lambda n: "<b><div>" + "<i>" * n + "</b>" * n + "x", lambda n: "<ul>" + "<div>" * n + "<li>" * n + "x", lambda n: "<p>" + "<span>" * n + "<li>" * n + "x"])
def test_end_tags_take_time_in_proportion(make):
    took = []
    for n in (8_000, 32_000):
        began = time.process_time()
        assert html_extract.text_of(make(n))[0] == "x"
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.05)


class Tree(HTMLParser):
    """The whole tree of a page whose elements are all ended."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.at = self.root = {"tag": "body", "class": "", "in": [], "up": None}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "class": dict(attrs).get("class", ""), "in": [], "up": self.at}
        self.at["in"].append(node)
        if tag != "br":
            self.at = node

    def handle_endtag(self, tag):
        assert self.at["tag"] == tag
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["in"].append(data)


BLOCKS = {"body", "div", "section", "article", "p", "ul", "li", "h2", "td", "tr", "table"}


def lines(node, link=False):
    """(text, text in links) of the blocks of a tree, in order; an empty pair between blocks."""
    out = []
    for x in node["in"]:
        if isinstance(x, str):
            out.append((x, x if link else ""))
        elif x["tag"] == "br":
            out.append((" ", " " if link else ""))
        elif x["class"] not in GONE and x["tag"] not in ("nav", "aside", "script"):
            inner = lines(x, link or x["tag"] == "a")
            out += [None, *inner, None] if x["tag"] in BLOCKS else inner
        elif x["tag"] != "script":
            out.append(None)  # what is left out parts lines
    return out


def blocks(node):
    got, text, links = [], "", ""
    for piece in [*lines(node), None]:
        if piece:
            text, links = text + piece[0], links + piece[1]
        else:
            words = " ".join(text.split())
            got += [(words, max(0, len(words) - len(" ".join(links.split()))))] if words else []
            text, links = "", ""
    return got


def slow_text(html):
    root = Tree(html).root
    size = lambda node: sum(n for _, n in blocks(node))
    need, best = 0.85 * size(root), root
    while best["tag"] != "article":
        within, stack = None, [best]
        while stack and not within:
            for x in stack.pop()["in"]:
                if isinstance(x, dict) and x["class"] not in GONE and x["tag"] not in ("nav", "aside", "script"):
                    if x["tag"] in ("div", "section", "article", "td") and size(x) >= need and size(x) > 0:
                        within = x
                        break
                    stack.append(x)
        if not within:
            break
        best = within
    return "\n".join(words for words, _ in blocks(best))


def some_page(rng):
    word = lambda: rng.choice(["one", "two&amp;", "thr&eacute;e", "four", "&lt;b&gt;", "five\n"])
    words = lambda: " ".join(word() for _ in range(rng.randint(0, 6)))

    def inline(depth):
        parts = []
        for _ in range(rng.randint(1, 3)):
            tag = rng.choice(["", "", "b", "a", "span", "br"])
            parts.append(words() if not tag else "<br>" if tag == "br" else f"<{tag}>{inline(depth - 1) if depth else words()}</{tag}>")
        return rng.choice(["", " "]).join(parts)

    def block(depth):
        name = rng.choice(["", "", "", *GONE[:5], "story", "legal-analysis"])
        tag = rng.choice(["p", "h2", "ul", "table"] + ["div", "section", "article", "aside", "nav"] * (depth > 0))
        if tag in ("p", "h2"):
            return f"<{tag} class='{name}'>{inline(2)}</{tag}>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{inline(1)}</li>" for _ in range(rng.randint(0, 3))) + "</ul>"
        if tag == "table":
            return "<table>" + "".join(f"<tr><td>{inline(1)}</td><td>{inline(0)}</td></tr>" for _ in range(rng.randint(0, 2))) + "</table>"
        name = "" if tag == "article" else name
        return f"<{tag} class='{name}'>" + rng.choice(["", " ", "loose "]).join(block(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    return "".join(block(4) for _ in range(rng.randint(1, 4))) + "<script>if (a < b) '</p>'</script>"


def test_pages_against_a_slow_reader():
    rng = random.Random(3)
    full = 0
    for _ in range(600):
        html = some_page(rng)
        assert html_extract.text_of(html)[0] == slow_text(html), html
        full += bool(slow_text(html))
    assert full > 300


def test_a_very_long_page():
    text = html_extract.text_of("<article>" + "<p>some words here</p>" * 100_000 + "</article>")[0]
    assert text == "\n".join(["some words here"] * 100_000)
