import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tarnflow.functions import models
from tarnflow.functions.embedding import embedder
from tarnflow.operators.web import public_url
from tarnflow.plans.corrective import Corrective, searched_pages


def judgment(i, label="Relevant", reason="because"):
    return {"chunk_id": i, "label": label, "reason": reason}


@pytest.mark.parametrize(
    "dense",
    [[[1.0, 0.0]], [[1.0, 0.0, 0.0], [0.0, 1.0]], [[float("nan"), 1.0], [1.0, 0.0]], [[float("inf"), 1.0], [1.0, 0.0]], [[0.0, 0.0], [1.0, 0.0]], [[3.0, 4.0], [1.0, 0.0]]],
)
def test_vectors_are_refused(dense):
    with pytest.raises(models.ModelError):
        models.checked_vectors(["a", "b"], dense, [{1: 1.0}, {2: 1.0}], 2)


@pytest.mark.parametrize("weights", [{"x": 1.0}, {1: 0.0}, {1: float("nan")}, {-1: 1.0}, {"1": 1.0, 1: 2.0}])
def test_lexical_weights_are_refused(weights):
    with pytest.raises(models.ModelError):
        models.checked_vectors(["a"], [[1.0, 0.0]], [weights], 2)


@pytest.mark.parametrize("scores", [[1.0], [1.0, float("nan")], [1.0, 2.0, 3.0]])
def test_scores_are_refused(scores):
    with pytest.raises(models.ModelError):
        models.checked_scores(["a", "b"], scores)


@pytest.mark.parametrize(
    "rows",
    [[judgment("a")], [judgment("a"), judgment("a")], [judgment("a"), judgment("c")], [judgment("a"), judgment("b", "Good")], [judgment("a"), judgment("b", reason=" ")], [judgment("a"), judgment("b") | {"more": 1}]],
)
def test_judgments_are_refused(rows):
    with pytest.raises(models.ModelError):
        models.checked_judgments(json.dumps({"judgments": rows}), ["a", "b"])
    with pytest.raises(models.ModelError):
        models.checked_judgments("not json", ["a", "b"])


@pytest.mark.parametrize(
    ("able", "claims"),
    [
        (True, []),
        (False, [{"text": "x", "citations": ["[1]"]}]),
        (True, [{"text": "x [1]", "citations": ["[1]"]}]),
        (True, [{"text": "x", "citations": ["[9]"]}]),
        (True, [{"text": "x", "citations": ["[1]", "[1]"]}]),
        (True, [{"text": "x\ny", "citations": ["[1]"]}]),
        (True, [{"text": "x" * 701, "citations": ["[1]"]}]),
        (True, [{"text": "x", "citations": []}]),
        (True, [{"text": "x", "citations": ["[1]"]}] * 13),
    ],
)
def test_claims_are_refused(able, claims):
    with pytest.raises(models.ModelError):
        models.checked_claims(json.dumps({"answerable": able, "claims": claims}), ["[1]", "[2]"])


def test_embedder_and_reranker_over_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, text string")
    got = models.embedded(rows, lambda texts: ([[1.0, 0.0]] * len(texts), [{len(t): 0.5} for t in texts]), 2, batch=1).orderBy("id").collect()
    assert [(r["id"], r["dense"], r["lexical"]) for r in got] == [(1, [1.0, 0.0], {1: 0.5}), (2, [1.0, 0.0], {2: 0.5})]
    pairs = spark.createDataFrame([(1, "q", "a", "x"), (1, "q", "b", "xxx"), (2, "r", "a", "x")], "query_id long, question string, chunk_id string, text string")
    scores = models.reranked(pairs, lambda q, texts: [len(t) for t in texts]).collect()
    assert sorted(tuple(r) for r in scores) == [(1, "a", 1.0), (1, "b", 3.0), (2, "a", 1.0)]
    labels = models.judged(pairs, lambda q, items: json.dumps({"judgments": [{"chunk_id": i, "label": "Irrelevant", "reason": "r"} for i, _ in reversed(items)]})).collect()
    assert {(r["query_id"], r["chunk_id"], r["label"]) for r in labels} == {(1, "a", "Irrelevant"), (1, "b", "Irrelevant"), (2, "a", "Irrelevant")}


def test_search_tries_again_and_falls_back_to_the_question(spark):
    asked = spark.createDataFrame([(1, "First question"), (2, "second")], "query_id long, text string")

    def provider(query, limit):
        if query == "none":
            return []
        if query == "broken":
            raise OSError("secret query text")
        return [{"title": "t", "href": "", "body": "b"}, {"title": query, "href": f"https://example.org/{len(query)}", "body": "b"}][: limit + 1]

    rewriter = lambda text, limit: json.dumps({"queries": ["none", "broken"] if text.startswith("First") else ["good", "GOOD "]})
    got = models.search_loop(asked, rewriter, provider, 2, 5, attempts=2, backoff=0.0).collect()
    by = {(r["query_id"], r["query"]): r for r in got}
    assert set(by) == {(1, "none"), (1, "broken"), (1, "First question"), (2, "good")}
    assert by[1, "broken"]["error_types"] == ["OSError", "OSError"] and by[1, "none"]["attempts"] == 2
    assert by[2, "good"]["empty_urls"] == 1 and by[2, "good"]["hits"][0]["url"] == "https://example.org/4"
    with pytest.raises(ValueError):
        models.searched(asked, provider, 5, attempts=9)


HTML = {"content-type": "text/html; charset=utf-8"}


def test_fetched_pages_pass_every_address(spark):
    pages = {
        "https://good.org/": (200, HTML, b"<p>x</p>"),
        "https://moves.org/": (302, {"location": "https://good.org/"}, b""),
        "https://moves.org/a/b": (301, {"location": "../next?q=1"}, b""),
        "https://moves.org/next?q=1": (200, {"content-type": "text/plain"}, b" a  \t b "),
        "https://lost.org/": (302, {}, b""),
        "https://inward.org/": (302, {"location": "http://127.0.0.1/"}, b""),
        "https://loops.org/": (302, {"location": "/"}, b""),
        "https://large.org/": (200, HTML, b"x" * 200),
        "https://gone.org/": (404, HTML, b""),
        "https://same.org/": (304, {"location": "https://good.org/"}, b""),
        "https://image.org/": (200, {"content-type": "image/png"}, b"x"),
        "https://untold.org/": (200, {}, b"x"),
        "https://empty.org/": (200, HTML, b"<script>x</script>"),
        "https://latin.org/": (200, {"content-type": "text/html; charset=latin-1"}, "<p>é</p>".encode("latin-1")),
        "https://odd.org/": (200, {"content-type": "text/html; charset=none-such"}, "<p>é</p>".encode()),
        "https://long.org/": (200, {"content-type": "text/plain"}, b"word " * 15),
    }
    addresses = lambda host: ["10.0.0.1"] if host == "private.org" else ["93.184.216.34"]
    urls = spark.createDataFrame([(u,) for u in [*pages, "https://private.org/", "file:///etc/passwd"]], "url string")

    def fetch(url, limit):
        status, headers, body = pages[url]
        return status, headers, body[:limit]

    got = {r["url"]: r for r in models.fetched(urls, fetch, addresses, public_url, 100, 60).collect()}
    seen = {u: (r["final_url"], r["error"]) for u, r in got.items()}
    assert seen["https://good.org/"] == seen["https://moves.org/"] == ("https://good.org/", None)
    assert seen["https://moves.org/a/b"] == ("https://moves.org/next?q=1", None) and got["https://moves.org/a/b"]["text"] == "a b"
    assert seen["https://inward.org/"][1] == seen["file:///etc/passwd"][1] == "url not allowed"
    names = ("loops", "large", "gone", "private", "lost", "same", "image", "untold", "empty")
    errors = ["too many redirects", "too large", "status 404", "address not public", "redirect without address", "status 304", "not text", "not text", "no text"]
    assert [seen[f"https://{x}.org/"][1] for x in names] == errors
    assert got["https://latin.org/"]["text"] == got["https://odd.org/"]["text"] == "é"
    long = got["https://long.org/"]
    assert long["truncated"] and long["text"] == ("word " * 12).strip() and long["content_sha256"] == hashlib.sha256(long["text"].encode()).hexdigest()
    assert got["https://empty.org/"]["content_sha256"] is None and not got["https://good.org/"]["truncated"]


@pytest.mark.parametrize("queries", [[], ["a", "b", "c"], [" "], ["x" * 201], ["a\u0001b"], [1], "a"])
def test_search_queries_are_refused(queries):
    with pytest.raises(models.ModelError):
        models.checked_queries(json.dumps({"queries": queries}), 2)


def test_the_web_branch_from_question_to_context(spark):
    """A question that the index cannot answer: rewritten, searched, fetched, and its page's passage cited."""
    asked = spark.createDataFrame([(1, "Which river crosses the northern town?"), (2, "unrelated words entirely")], "query_id long, text string")
    body = b"<p>The river Lune crosses the northern town.</p><p>Nothing else.</p>"
    pages = {"https://a.org/x": (301, {"location": "/y"}, b""), "https://a.org/y": (200, HTML, body), "https://b.org/": (500, HTML, b"")}
    rewriter = lambda text, limit: json.dumps({"queries": [text[:20]]})
    provider = lambda query, limit: [{"title": "t", "href": u, "body": "b"} for u in ("https://a.org/x", "https://b.org/", "http://127.0.0.1/")]
    found, hits, report = searched_pages(asked, rewriter, provider, lambda u, n: pages[u], lambda host: ["93.184.216.34"], backoff=0.0)
    assert [(r["url"], r["text"]) for r in found.collect()] == [("https://a.org/y", "The river Lune crosses the northern town.\n\nNothing else.")]
    assert {(r["query_id"], r["url"]) for r in hits.collect()} == {(1, "https://a.org/y"), (2, "https://a.org/y")}
    assert {(r["url"], r["error"]) for r in report.collect()} == {("https://a.org/x", None), ("https://b.org/", "status 500")}
    chunks = spark.createDataFrame([("c", "completely different text")], "chunk_id string, text string").withColumn("e", embedder()(F.col("text")))
    index = chunks.select("chunk_id", "text", F.col("e.dense").alias("vector"), F.col("e.lexical").alias("lexical"))
    contexts, kept = Corrective(index, index, found, hits).assemble(asked, 5, 3)
    digest = hashlib.sha256(found.first()["text"].encode()).hexdigest()
    end = len("The river Lune crosses the northern town.")
    (row,) = kept.collect()
    assert (row["query_id"], row["source_type"], row["source_ref"], row["text"]) == (1, "web", "https://a.org/y", "The river Lune crosses the northern town.")
    assert row["strip_id"] == "web:" + hashlib.sha256(f"https://a.org/y\0{digest}\0{0}\0{end}".encode()).hexdigest()[:24]
    assert {r["query_id"]: r["status"] for r in contexts.collect()}[1] == "ready"
