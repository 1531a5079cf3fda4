"""Main text of web pages, by containers that the pages of a host agree on.

1. Each page's containers are scored: the text of blocks outside links and outside what is never an article (menus, headers, footers, sidebars,
   notices, adverts, forms, comments, scripts, styles). The page votes for the deepest container that holds nearly all of it.
2. Votes are counted by host and generalised path: tags with classes from the body down, numbers in classes made equal.
3. Pages are read again with the winning paths of their host: text comes from the container of the first winning path that the page has,
   and from the page's own best container if it has none of them.

Text: character references decoded, white space within a block made one space, blocks trimmed and joined by a line end. A null page is
empty. Broken mark-up is read to its end: open elements end with those around them, an unfinished tag at the end is dropped, a quote that is
never closed ends with its tag. Reading takes time and memory in proportion to the page, however deep it is. Pages that repeat get equal texts.

A host's votes keep WINNERS paths, each with LEAST_SHARE of the first one's votes: a page that has none of them is read by its own best container,
so no text depends on the bound but that of layouts too rare to vote.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches, written

NEARLY = 0.85
WINNERS, LEAST_SHARE = 3, 0.02
HOSTS = 50_000
SALT = 16

# HTML's elements by role.
RAW = frozenset("script style noscript template iframe object svg canvas audio video textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center div main section td".split())
NEVER = frozenset("aside button dialog fieldset footer form head label legend menu nav search".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - frozenset("html body li dd dt td th tr".split())
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words of class, id and role names that say what an element is for, and words that say only that it is one.
ROLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead "
    "topbar toolbar comment comments commentlist respond replies disqus cookie cookies consent gdpr notice alert popup modal newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations widget copyright disclaimer skip adsbygoogle".split()
)
NEUTRAL = frozenset("site page main top bottom left right post article entry block box slot bar list item items link links button buttons wrapper wrap container inner outer section area unit form group panel content posts articles stories icons text thread the js this us user reader message board body title header heading count label".split())
# Words of ROLE that decide for a whole name where they are its first or last word, and words that then say that it is content or a layout.
HEAD = frozenset(
    "ad ads advert adverts advertisement advertising sponsored comment comments cookie cookies consent gdpr notice sidebar nav navbar navigation breadcrumb breadcrumbs "
    "pagination footer masthead newsletter subscribe disqus share sharing".split()
)
KEEPS = frozenset(
    "analysis chapter chart data essay explained feature guide history law layout market news period policy price prices report research result results review science "
    "story study summary table theme template value work has is no not with without hide show toggle".split()
)
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
PIECE = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<open>[^>]*)(?P<close>>|$))",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")


@lru_cache(4096)
def is_boilerplate(label: str) -> bool:
    """Whether a name among class, id and role says that the element is no article: all its words are of ROLE or NEUTRAL, and one is of ROLE; or its
    first or last word is of HEAD, and none is of KEEPS. So "site-footer", "comment-list" and "advert-premium" are, "legal-analysis",
    "comment-analysis" and "has-sidebar" are not.
    """
    for name in label.split():
        words = [w.lower() for w in WORD.findall(name)]
        if any(w in ROLE for w in words) and all(w in ROLE or w in NEUTRAL for w in words):
            return True
        if words and (words[0] in HEAD or words[-1] in HEAD) and not any(w in KEEPS for w in words):
            return True
    return False


class Node:
    """An element: its place in page order, the place of its last descendant, and what its ancestors pass on. Nothing grows with the depth."""

    __slots__ = ("tag", "step", "chain", "parent", "holder", "at", "last", "never", "link", "article", "size")

    def __init__(self, tag: str, step: str, parent: Node | None, at: int, never: bool, link: bool, article: bool):
        self.tag, self.step, self.parent, self.at, self.last = tag, step, parent, at, at
        self.never, self.link, self.article, self.size = never, link, article, 0
        block = parent is None or tag in BLOCK
        self.holder = self if block else parent.holder
        self.chain = hash((parent.chain, step)) if block and parent is not None else parent.chain if parent else 0

    @property
    def path(self) -> str:
        """Generalised tags and classes of the blocks from the body down."""
        steps: list[str] = []
        up: Node | None = self.holder
        while up is not None:
            steps.append(up.step)
            up = up.parent.holder if up.parent else None
        return ">".join(reversed(steps))


def _chain(path: str) -> int:
    chain = 0
    for step in path.split(">")[1:]:
        chain = hash((chain, step))
    return chain


@lru_cache(4096)
def _step(tag: str, classes: str) -> str:
    names = sorted({re.sub(r"\d+", "0", c).replace(">", "") for c in classes.split()})
    return ".".join([tag, *names])


class _Open:
    """Open elements, with the places of those of each tag: the innermost of a tag is known without looking through them."""

    def __init__(self, root: Node):
        self.nodes, self.of = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.of[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def inmost(self, tags: frozenset | set) -> int:
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=0)

    def end(self, tags: frozenset | set, stops: frozenset | set) -> None:
        """End the innermost element of these tags and all within it, unless one of stops is further in."""
        k = self.inmost(tags)
        if k and k >= self.inmost(stops):
            for node in self.nodes[k:]:
                self.of[node.tag].pop()
            del self.nodes[k:]


def _plain(pieces: list[str]) -> str:
    """Text of a block: character references decoded, white space made one space, trimmed."""
    return " ".join(unescape("".join(pieces)).split())


def read_page(html: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Blocks of text in page order, each with the node that holds it, and the containers."""
    root = Node("body", "body", None, 0, False, False, False)
    nodes, containers = [root], [root]
    opened = _Open(root)
    blocks: list[tuple[Node, str]] = []
    text: list[str] = []
    links: list[str] = []
    holder, filled = root, False

    def flush() -> None:
        nonlocal filled
        if text:
            words = _plain(text)
            text.clear()
            if words:
                blocks.append((holder, words))
                holder.size += max(0, len(words) - len(_plain(links))) if links else len(words)
            links.clear()
        filled = False

    def put(data: str) -> None:
        nonlocal holder, filled
        top = opened.nodes[-1]
        if data and not top.never:
            if not filled:
                holder = top.holder
                filled = bool(data.strip())
            text.append(data)
            if top.link:
                links.append(data)

    at, n = 0, len(html)
    while at < n:
        m = PIECE.search(html, at)
        if m is None:
            put(html[at:])
            break
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:  # a comment, a doctype, or what HTML takes for a comment, as it does <![CDATA[
            continue
        rest = m["rest"]
        if rest is None:  # a quote that is never closed: the tag ends at the first >
            if not m["close"]:
                break  # an unfinished tag at the end
            rest = m["open"]
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCK:
                flush()
            opened.end({tag}, frozenset() if tag in BLOCK else CONTAINER)
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                stop = _raw_end(tag).search(html, at)
                at = stop.end() if stop else n
            put(" ")
            continue
        if tag in ("html", "body") or (tag in BLOCK and opened.of["head"]):
            opened.end({"head"}, frozenset())  # its end tag may be left out
        if tag in ("html", "body"):
            flush()
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                opened.end({"p"}, CONTAINER | {"li", "td", "th", "blockquote"})
            if tag in SELF_ENDING:
                opened.end(SELF_ENDING[tag], STOPS[tag])
        elif tag in ("img", "input"):
            put(" ")
        if tag in VOID:
            continue
        top = opened.nodes[-1]
        named = {a.lower(): v.strip("\"'") for a, v in ATTRIBUTE.findall(rest)} if "=" in rest else {}
        classes = unescape(named.get("class", ""))
        never = top.never or tag in NEVER or (tag == "header" and not top.article) or "hidden" in named
        if not never and named and tag not in ("main", "h1") and (tag != "article" or top.article):
            own = "" if tag in HEADING else named.get("id", "")  # a heading's id is often made of its words
            never = is_boilerplate(f"{classes} {own} {named.get('role', '')}")
        node = Node(tag, _step(tag, classes) if tag in BLOCK else tag, top, len(nodes), never, top.link or tag == "a", top.article or tag in ("article", "main"))
        nodes.append(node)
        if not rest.endswith("/"):
            opened.push(node)
        if tag in CONTAINER and not never:
            containers.append(node)
    flush()
    for node in reversed(nodes[1:]):
        node.parent.size += node.size
        node.parent.last = max(node.parent.last, node.last)
    return blocks, containers


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def best_container(containers: list[Node]) -> Node:
    """The deepest container with nearly all of the page's text, but none within an article that holds it. Of two containers that both hold it one is
    within the other, so there are no ties.
    """
    best = containers[0]
    need = NEARLY * best.size
    for c in containers[1:]:
        if c.size >= need and c.size > 0 and _within(c, best) and best.tag != "article":
            best = c
    return best


def _within(node: Node, other: Node) -> bool:
    return other.at < node.at <= other.last


def text_of(html: str | None, paths: list[str] = ()) -> tuple[str, str]:
    """The main text, and the path of the container it is from. Of several containers of one path that with most text is taken, the first of equal ones."""
    if not html:
        return "", ""
    blocks, containers = read_page(html)
    chosen = None
    for path in paths:
        chain = _chain(path)
        found = [c for c in containers if c.chain == chain and c.size > 0]
        if found:
            chosen = max(found, key=lambda c: c.size)
            break
    chosen = chosen or best_container(containers)
    return "\n".join(words for node, words in blocks if node is chosen or _within(node, chosen)), chosen.path


def host(url):
    """Lower-case host of a URL column; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of each batch: host, path, pages."""
    for batch in batches:
        votes: dict[tuple[str, str], int] = {}
        for name, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = best_container(read_page(html.as_py() or "")[1])
            if own.size:
                votes[name, own.path] = votes.get((name, own.path), 0) + 1
        yield pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in votes], pa.string()), "path": pa.array([p for _, p in votes], pa.string()), "pages": pa.array(list(votes.values()), pa.int64())})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text_of(html.as_py(), paths or ()) for html, paths in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([p for _, p in texts], pa.string())],
            ["page_id", "url", "text", "n_chars", "path"],
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the paths that most pages of a host vote for, WINNERS at most, the first with most votes."""
    votes = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path string, pages long")
    votes = votes.groupBy("host", "path").agg(F.sum("pages").alias("pages"))
    by = Window.partitionBy("host")
    ranked = votes.withColumn("rank", F.row_number().over(by.orderBy(F.desc("pages"), "path"))).where(F.col("rank") <= WINNERS)
    ranked = ranked.withColumn("share", F.col("pages") / F.max("pages").over(by)).where(F.col("share") >= LEAST_SHARE)
    return ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).getField("path").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """pages: page_id long, url string, html string (other columns are ignored). A row per row: page_id, url, text, n_chars (code points), path
    of the container. Winning paths are broadcast for up to HOSTS hosts; beyond, they are joined by host with a salt, so that one
    host with a large share of all pages is spread over SALT tasks.
    """
    spark = pages.sparkSession
    short_batches(spark)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = written(host_paths(p), "host-paths")
    named = p.withColumn("host", host(F.col("url")))
    if winners.count() <= HOSTS:
        both = named.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        both = named.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")
    return both.select("page_id", "url", "html", "paths").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, path string")
