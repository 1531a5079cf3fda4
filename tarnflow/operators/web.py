"""Web evidence: public URLs, page text, passages of pages."""

from __future__ import annotations

import ipaddress
import re

from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import quote, urlsplit, urlunsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Refinement, WebSearch
from ..functions.batches import text_udf
from ..functions.text import shared, terms
from .chunking import strips

#: Elements without page text, and elements that end a line.
IGNORED = frozenset("script style nav footer header aside form svg noscript".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote tr".split())
LOCAL = (".local", ".localhost", ".internal")
PATH_SAFE = "/%:@!$&'()*+,;=-._~"
QUERY_SAFE = "/%?:@!$&'()*+,;=-._~"
REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);|([a-zA-Z][a-zA-Z0-9]*;))?")


def public_url(url: str | None, allowed: tuple[str, ...] = ()) -> str | None:
    """A web address in one form, or null if it is not public: other schemes, credentials, control characters, other ports than 80 and 443, local
    names, addresses that are not global, domains that are not allowed.
    """
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return None
    if parts.scheme.lower() not in ("http", "https") or not host or parts.username is not None or parts.password is not None:
        return None
    if any(ord(c) < 32 for c in url) or port not in (None, 80, 443) or "%" in host:
        return None
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        try:
            name = host.encode("idna").decode().lower().rstrip(".")
        except UnicodeError:
            return None
        if "." not in host or name == "localhost" or name.endswith(LOCAL):
            return None
    else:
        if not address.is_global:
            return None
        name = f"[{host}]" if address.version == 6 else host
    bare = name.strip("[]")
    domains = [d.casefold().lstrip(".") for d in allowed]
    if domains and not any(bare == d or bare.endswith("." + d) for d in domains):
        return None
    place = name + (f":{port}" if port else "")
    return urlunsplit((parts.scheme.lower(), place, quote(parts.path or "/", safe=PATH_SAFE), quote(parts.query, safe=QUERY_SAFE), ""))


def normalize_url(url, allowed: tuple[str, ...] = ()):
    """public_url of a column."""
    return text_udf(lambda u: public_url(u, allowed))(url)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth = 0

    def _mark(self, tag: str, opens: bool) -> None:
        if tag in IGNORED:
            self.depth = self.depth + 1 if opens else max(0, self.depth - 1)
        elif not self.depth:
            self.out.append("\n\n" if tag in LINES else " " if opens and tag in ("br", "td", "th") else "")

    def handle_starttag(self, tag, attrs):
        self._mark(tag, True)

    def handle_endtag(self, tag):
        self._mark(tag, False)

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def _ended(m: re.Match) -> str:
    """A reference as it is; an ampersand that begins none that is known and ended by a semicolon as one that stands for itself."""
    whole, name = m[0], m[1]
    return whole if len(whole) > 1 and (name is None or name in html5) else "&amp;" + whole[1:]


def html_text(html: str | None, ended: bool = False) -> str:
    """Text of a page without scripts, styles, menus and the like: blank lines between blocks, single spaces.

    ended: only references that end in a semicolon are decoded. Else also those that HTML lets end without one, as `&amp` before a tag.
    """
    reader = _Text()
    reader.feed(REFERENCE.sub(_ended, html or "") if ended else html or "")
    reader.close()
    text = re.sub(r"[ \t\r\f\v]+", " ", "".join(reader.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def page_text(html: Column, ended: bool = False) -> Column:
    """html_text of a column."""
    return text_udf(lambda page: html_text(page, ended))(html)


def fetched(pages: DataFrame, config: WebSearch = WebSearch(), url: str = "url", html: str = "html", ties: tuple = (), ended: bool = False) -> DataFrame:
    """Pages as a fetcher returns them: url in one form, text of at most max_page_chars without white space at its ends, content_sha256 of that text,
    truncated. Pages that are not public, larger than max_page_bytes or without text are left out; of one address the first by its raw form, then by
    the columns of ties, stays. ended: as of html_text.
    """
    size = F.octet_length(F.coalesce(html, F.lit("")))
    rows = pages.where(size <= config.max_page_bytes).withColumn("_url", normalize_url(F.col(url), config.allowed_domains)).where("_url is not null")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_url").orderBy(url, *ties))).where("_r = 1")
    rows = rows.withColumn("_text", page_text(F.col(html), ended))
    cut = F.regexp_replace(F.substring("_text", 1, config.max_page_chars), r"(?U)^\s+|\s+$", "")
    rows = rows.select(F.col("_url").alias("url"), cut.alias("text"), (F.length("_text") > config.max_page_chars).alias("truncated")).where("text <> ''")
    return rows.select("url", "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_sha256"), "truncated")


def web_queries(queries: DataFrame, limit: int = 2, query: str = "query_id") -> DataFrame:
    """queries: query, position, text. At most limit each, white space collapsed; blank ones, ones over 200 characters, with control characters or
    that differ in case only from an earlier one are dropped.
    """
    t = F.btrim(F.regexp_replace("text", r"(?U)\s+", " "), F.lit(" "))
    rows = queries.withColumn("text", t).where((F.length("text") > 0) & (F.length("text") <= 200) & ~F.col("text").rlike(r"[\x00-\x1f]"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(query, F.lower("text")).orderBy("position"))).where("_r = 1")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy("position"))).where(F.col("_r") <= limit).drop("_r")


def eligible(hits: DataFrame, config: WebSearch = WebSearch(), query: str = "query_id") -> DataFrame:
    """hits: query, search_no, search_rank, url. The first max_pages public addresses of each query, in the order of its searches."""
    rows = hits.where(F.col("search_rank") <= config.results_per_query).withColumn("url", normalize_url(F.col("url"), config.allowed_domains)).where("url is not null")
    order = [F.col("search_no"), F.col("search_rank")]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(query, "url").orderBy(*order))).where("_r = 1")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("place") <= config.max_pages).drop("_r")


def preselect(passages: DataFrame, config: WebSearch = WebSearch(), by: tuple = ("query_id", "url")) -> DataFrame:
    """passages: by, query_text (or its query_terms), passage_no (from 0), passage. Of a page with more than max_passages the first few and those that
    share most terms with the query (ties to the earlier). candidate_no counts what stays, from 0; shared is how many terms.
    """
    page = Window.partitionBy(*by)
    asked = F.col("query_terms") if "query_terms" in passages.columns else terms(F.col("query_text"))
    counted = passages.withColumn("shared", shared(asked, terms(F.col("passage")))).withColumn("_n", F.count("*").over(page))
    ranked = counted.withColumn("_r", F.row_number().over(page.orderBy(F.desc("shared"), "passage_no")))
    first = F.least(F.lit(config.first_passages), F.lit(config.max_passages))
    kept = ranked.where((F.col("_n") <= config.max_passages) | (F.col("passage_no") < first) | (F.col("_r") <= config.max_passages - first))
    return kept.withColumn("candidate_no", F.row_number().over(page.orderBy("passage_no")) - 1).drop("_n", "_r")


def passages(hits: DataFrame, pages: DataFrame, config: WebSearch = WebSearch(), refinement: Refinement = Refinement(), query: str = "query_id") -> DataFrame:
    """hits: query, query_text, url, search_rank; pages of fetched(). The best passages_per_page strips of each page by rerank score, ties to the earlier."""
    # Only pages that were found are read and cut.
    read = pages.join(hits.select("url").distinct(), "url", "left_semi").select(F.struct("url", "content_sha256").alias("page"), "text")
    cut = strips(read, "page", "text", refinement).select("page.url", "page.content_sha256", "start", "end", F.col("strip").alias("passage"))
    cut = cut.withColumn("passage_no", (F.row_number().over(Window.partitionBy("url").orderBy("start")) - 1).cast("int"))
    asked = hits.withColumn("query_terms", terms(F.col("query_text")))
    near = preselect(asked.join(cut, "url"), config, (query, "url")).withColumnRenamed("shared", "rerank_score").drop("query_terms")
    named = near.withColumn("_r", F.row_number().over(Window.partitionBy(query, "url").orderBy(F.desc("rerank_score"), "candidate_no"))).where(F.col("_r") <= config.passages_per_page).drop("_r")
    digest = F.substring(F.sha2(F.concat_ws("\0", "url", "content_sha256", F.col("start").cast("string"), F.col("end").cast("string")), 256), 1, 24)
    return named.withColumn("strip_id", F.concat(F.lit("web:"), digest)).withColumn("retrieval_score", 1 / (F.col("search_rank") + 1))


def web_strips(judged: DataFrame, config: WebSearch = WebSearch(), query: str = "query_id") -> DataFrame:
    """Relevant passages, the max_strips of best rerank score for each query; ties in the order of pages and passages."""
    rows = judged.where("relevance = 'relevant'")
    by = Window.partitionBy(query).orderBy(F.desc("rerank_score"), "place", "candidate_no")
    return rows.withColumn("position", F.row_number().over(by)).where(F.col("position") <= config.max_strips)


