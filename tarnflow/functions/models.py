"""Models and services as arguments: plain functions called in the tasks, batch by batch, whose results are checked before they become rows.

None of them needs a network here: a caller passes what calls its model. What a function returns is refused as a whole if it breaks its contract,
so a wrong count, a vector that is not finite or a judgment of a text that was not asked about never gets into a table.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import math
import re
import time
import unicodedata
from collections.abc import Callable, Iterator
from email.message import Message
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Answer

#: Labels of a judgment, and how far a vector's length may be from 1.
LABELS = ("Relevant", "Ambiguous", "Irrelevant")
LENGTH_SLACK = 0.02
#: Characters of one search query.
QUERY_CHARS = 200


class ModelError(ValueError):
    """A model's result breaks its contract."""


def _require(good: bool, message: str) -> None:
    if not good:
        raise ModelError(message)


# -- checks of single results --


def checked_vectors(texts: list[str], dense: list, lexical: list, dimensions: int) -> tuple[list[list[float]], list[dict[int, float]]]:
    """One unit vector and one map of positive weights by token id for each text."""
    _require(len(dense) == len(lexical) == len(texts), "as many vectors as texts are needed")
    vectors = [[float(x) for x in v] for v in dense]
    for v in vectors:
        _require(len(v) == dimensions and all(map(math.isfinite, v)), "a dense vector has wrong dimensions or values")
        _require(abs(math.sqrt(sum(x * x for x in v)) - 1) <= LENGTH_SLACK, "a dense vector is not of unit length")
    maps = []
    for weights in lexical:
        own = {}
        for token, weight in dict(weights).items():
            _require(re.fullmatch(r"\d+", str(token)) is not None and math.isfinite(float(weight)) and float(weight) > 0, "a lexical weight is not valid")
            _require(int(token) not in own, "a token id is repeated")
            own[int(token)] = float(weight)
        maps.append(own)
    return vectors, maps


def checked_scores(passages: list[str], scores: object) -> list[float]:
    """One finite score for each passage; a single number stands for a list of one."""
    if hasattr(scores, "tolist"):
        scores = scores.tolist()
    out = [float(x) for x in ([scores] if isinstance(scores, (int, float)) else scores)]
    _require(len(out) == len(passages) and all(map(math.isfinite, out)), "as many finite scores as passages are needed")
    return out


def _object(response: str, keys: set[str]) -> dict:
    try:
        data = json.loads(response)
    except (TypeError, ValueError) as error:
        raise ModelError("the response is not JSON") from error
    _require(isinstance(data, dict) and set(data) == keys, "the response has another shape")
    return data


def checked_judgments(response: str, ids: list[str]) -> list[tuple[str, str, str]]:
    """chunk_id, label, reason: each of ids judged once, with a known label and a reason."""
    rows = _object(response, {"judgments"})["judgments"]
    _require(isinstance(rows, list) and len(rows) == len(ids), "one judgment for each text is needed")
    out: dict[str, tuple[str, str]] = {}
    for row in rows:
        _require(isinstance(row, dict) and set(row) == {"chunk_id", "label", "reason"}, "a judgment has another shape")
        _require(row["chunk_id"] in ids and row["chunk_id"] not in out, "a judged text is unknown or repeated")
        _require(row["label"] in LABELS, "a label is unknown")
        _require(isinstance(row["reason"], str) and bool(row["reason"].strip()), "a judgment has no reason")
        out[row["chunk_id"]] = (row["label"], row["reason"].strip())
    return [(i, *out[i]) for i in ids]


def checked_claims(response: str, markers: list[str], config: Answer = Answer()) -> tuple[bool, list[tuple[str, list[str]]]]:
    """Whether there is an answer, and its claims: text (NFC, trimmed) and the markers it cites, known ones, each once."""
    data = _object(response, {"answerable", "claims"})
    able, rows = data["answerable"], data["claims"]
    _require(isinstance(able, bool) and isinstance(rows, list) and len(rows) <= config.max_claims, "claims are not valid")
    _require(able == bool(rows), "claims and answerability conflict")
    out = []
    for row in rows:
        _require(isinstance(row, dict) and set(row) == {"text", "citations"}, "a claim has another shape")
        text, refs = row["text"], row["citations"]
        _require(isinstance(text, str) and bool(text.strip()) and len(text) <= config.max_claim_chars and "\n" not in text and not re.search(r"\[\d+\]", text), "a claim's text is not valid")
        _require(isinstance(refs, list) and bool(refs) and all(isinstance(x, str) and x in markers for x in refs) and len(set(refs)) == len(refs), "a citation is missing, unknown or repeated")
        out.append((unicodedata.normalize("NFC", text.strip()), refs))
    return able, out


def checked_queries(response: str, limit: int) -> list[str]:
    """Search queries: 1 to limit texts of one line, without repeats (by case and space)."""
    rows = _object(response, {"queries"})["queries"]
    _require(isinstance(rows, list) and 1 <= len(rows) <= limit and all(isinstance(x, str) for x in rows), "a number of queries is not valid")
    out: dict[str, str] = {}
    for row in rows:
        text = " ".join(row.split())
        _require(0 < len(text) <= QUERY_CHARS and not any(ord(c) < 32 for c in text), "a search query is not valid")
        out.setdefault(text.casefold(), text)
    return list(out.values())


def public_host(addresses: list[str]) -> bool:
    """Whether a host has addresses and all of them are public ones."""
    try:
        return bool(addresses) and all(ipaddress.ip_address(a.partition("%")[0]).is_global for a in addresses)
    except ValueError:
        return False


# -- tables --


def embedded(rows: DataFrame, model: Callable[[list[str]], tuple[list, list]], dimensions: int, batch: int = 32) -> DataFrame:
    """rows with a column text, and dense and lexical of it. model: texts to dense vectors and lexical maps. Blank texts are refused."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["text"].tolist()
            _require(all(isinstance(t, str) and t.strip() for t in texts), "a blank text has no vector")
            dense, lexical = [], []
            for lo in range(0, len(texts), batch):
                own = texts[lo : lo + batch]
                d, w = checked_vectors(own, *model(own), dimensions)
                dense += d
                lexical += w
            yield part.assign(dense=dense, lexical=lexical)

    return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", dense array<double>, lexical map<bigint,double>")


def reranked(pairs: DataFrame, model: Callable[[str, list[str]], object]) -> DataFrame:
    """pairs: query_id, question, chunk_id, text. query_id, chunk_id, rerank_score. model: a question and its passages to scores; one call a question."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        question, texts = part["question"].iloc[0], part["text"].tolist()
        _require(bool(question.strip()) and all(t.strip() for t in texts), "a question and passages are not blank")
        return part[["query_id", "chunk_id"]].assign(rerank_score=checked_scores(texts, model(question, texts)))

    kinds = dict(pairs.dtypes)
    return pairs.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, rerank_score double")


def judged(hits: DataFrame, model: Callable[[str, list[tuple[str, str]]], str]) -> DataFrame:
    """hits: query_id, question, chunk_id string, text. query_id, chunk_id, label, reason. model: a question and its (chunk_id, text) to JSON."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        items = list(zip(part["chunk_id"], part["text"], strict=True))
        rows = checked_judgments(model(part["question"].iloc[0], items), [i for i, _ in items])
        return pd.DataFrame(rows, columns=["chunk_id", "label", "reason"]).assign(query_id=part["query_id"].iloc[0])

    return hits.groupBy("query_id").applyInPandas(run, f"query_id {dict(hits.dtypes)['query_id']}, chunk_id string, label string, reason string")


def claimed(contexts: DataFrame, model: Callable[[str, str, str | None], str], config: Answer = Answer()) -> DataFrame:
    """contexts: query_id, question, text, marks (array of markers), retry (why it is asked again, or null). query_id, claim_no (from 1), text, refs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for q, question, text, marks, retry in zip(part["query_id"], part["question"], part["text"], part["marks"], part["retry"], strict=True):
                _, claims = checked_claims(model(question, text, retry), list(marks), config)
                rows += [(q, k, claim, refs) for k, (claim, refs) in enumerate(claims, 1)]
            yield pd.DataFrame(rows, columns=["query_id", "claim_no", "text", "refs"])

    return contexts.select("query_id", "question", "text", "marks", "retry").mapInPandas(run, f"query_id {dict(contexts.dtypes)['query_id']}, claim_no int, text string, refs array<string>")


def rewritten(questions: DataFrame, model: Callable[[str, int], str], limit: int) -> DataFrame:
    """questions: query_id, text. query_id, number (from 1), query."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(q, k, x) for q, text in zip(part["query_id"], part["text"], strict=True) for k, x in enumerate(checked_queries(model(text, limit), limit), 1)]
            yield pd.DataFrame(rows, columns=["query_id", "number", "query"])

    return questions.select("query_id", "text").mapInPandas(run, f"query_id {dict(questions.dtypes)['query_id']}, number int, query string")


SEARCHED = "number int, query string, hits array<struct<rank:int,title:string,url:string,snippet:string>>, attempts int, empty_urls int, error_types array<string>"


def searched(queries: DataFrame, provider: Callable[[str, int], list[dict]], limit: int, attempts: int = 3, backoff: float = 0.5) -> DataFrame:
    """queries: query_id, number, query. Each with its hits (title, href, body of the provider), tried again with a growing pause after an error or when
    there are no hits; attempts, empty_urls and error_types say what happened, without the errors' texts, which may hold the query.
    """
    if not 1 <= attempts <= 5 or not 0 <= backoff <= 5:
        raise ValueError("attempts are 1 to 5 and the pause 0 to 5 seconds")

    def one(query: str) -> tuple:
        empty, errors, hits = 0, [], []
        for turn in range(1, attempts + 1):
            try:
                for row in provider(query, limit):
                    if not str(row.get("href") or "").strip():
                        empty += 1
                        continue
                    hits.append({"rank": len(hits) + 1, "title": str(row.get("title") or ""), "url": str(row["href"]).strip(), "snippet": str(row.get("body") or "")})
            except Exception as error:  # whatever a provider raises
                errors.append(type(error).__name__)
            if hits or turn == attempts:
                return hits[:limit], turn, empty, errors
            time.sleep(backoff * 2 ** (turn - 1))
        raise AssertionError

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [one(q) for q in part["query"]]
            yield part.assign(**{name: [f[k] for f in found] for k, name in enumerate(("hits", "attempts", "empty_urls", "error_types"))})

    return queries.select("query_id", "number", "query").mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, {SEARCHED}")


def search_loop(questions: DataFrame, rewriter: Callable[[str, int], str], provider: Callable[[str, int], list[dict]], max_queries: int, per_query: int, attempts: int = 3, backoff: float = 0.5) -> DataFrame:
    """Hits of each question's rewritten queries, and, for questions whose rewritten queries found nothing, of the question itself (number 0)."""
    rewrites = rewritten(questions, rewriter, max_queries)
    first = searched(rewrites, provider, per_query, attempts, backoff).persist()  # providers are asked once
    empty = first.groupBy("query_id").agg(F.sum(F.size("hits")).alias("n")).where("n = 0").select("query_id")
    asked = rewrites.select("query_id", F.lower("query").alias("query")).distinct()
    plain = questions.join(empty, "query_id", "left_semi").select("query_id", F.lit(0).alias("number"), F.col("text").alias("query"))
    plain = plain.join(asked.withColumnRenamed("query", "_q"), (plain["query_id"] == asked["query_id"]) & (F.lower(plain["query"]) == F.col("_q")), "left_anti")
    return first.unionByName(searched(plain, provider, per_query, attempts, backoff))


FETCHED = "url string, final_url string, text string, content_sha256 string, truncated boolean, error string"
#: Statuses that name another address, and kinds of pages that are read.
REDIRECTS = (301, 302, 303, 307, 308)
KINDS = ("text/html", "text/plain")
Response = tuple[int, dict[str, str], bytes]


def read_page(content_type: str | None, body: bytes, max_chars: int) -> tuple[str | None, bool, str | None]:
    """(text, whether it was cut, error) of a page's body: its kind must be HTML or plain text; an unknown character set is read as UTF-8."""
    from ..operators.web import html_text

    header = Message()
    header["content-type"] = content_type or ""
    kind = header.get_content_type() if content_type else None
    if kind not in KINDS:
        return None, False, "not text"
    try:
        text = body.decode(header.get_content_charset() or "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    text = html_text(text) if kind == "text/html" else re.sub(r"[ \t]+", " ", text).strip()
    own = text[:max_chars].strip()
    return (own, len(text) > max_chars, None) if own else (None, False, "no text")


def fetched(urls: DataFrame, fetch: Callable[[str, int], Response], resolve: Callable[[str], list[str]], allowed: Callable[[str], str | None], max_bytes: int, max_chars: int = 40_000, redirects: int = 3) -> DataFrame:
    """urls: url. Pages by fetch(address, most bytes to read) -> (status, headers by lower-case name, body): each address, the first and those it redirects to (which
    may be relative), must pass allowed (the URL as it may be asked for, or None) and have public addresses only. At most max_bytes + 1 bytes are asked
    for, so a longer page is told without being read. text is what read_page makes, content_sha256 of it; error says why there is none.
    """

    def one(url: str) -> tuple:
        at, none = allowed(url), (None, None, None)
        for _ in range(redirects + 1):
            if at is None:
                return None, *none, "url not allowed"
            host = re.sub(r":\d+$", "", re.sub(r"^[a-z]+://(?:[^/@]*@)?([^/?#]+).*$", r"\1", at))
            if not public_host(resolve(host)):
                return at, *none, "address not public"
            try:
                status, headers, body = fetch(at, max_bytes + 1)
            except Exception as error:  # whatever a fetcher raises
                return at, *none, type(error).__name__
            if status in REDIRECTS:
                if not headers.get("location"):
                    return at, *none, "redirect without address"
                at = allowed(urljoin(at, headers["location"]))
                continue
            if status != 200:
                return at, *none, f"status {status}"
            if len(body) > max_bytes:
                return at, *none, "too large"
            text, cut, error = read_page(headers.get("content-type"), body, max_chars)
            return (at, *none, error) if error else (at, text, hashlib.sha256(text.encode()).hexdigest(), cut, None)
        return at, *none, "too many redirects"

    names = ["final_url", "text", "content_sha256", "truncated", "error"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [one(u) for u in part["url"]]
            yield pd.DataFrame({"url": part["url"]} | {n: pd.Series([r[k] for r in rows], index=part.index, dtype=object) for k, n in enumerate(names)})

    return urls.select("url").mapInPandas(run, FETCHED)
