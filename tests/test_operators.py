import math

import pytest
from pyspark.sql import functions as F

from tarnflow.config import Cleaning, Context, Ingestion, canonical_json
from tarnflow.functions import text as T
from tarnflow.operators import blocks, chat, evidence, index, retrieval, web


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column).first()[0]


def test_clean_text(spark):
    raw = "Xin chào  Việt\x00 Nam \r\n\r\n\r\n\r\n  dòng­ hai \t"
    assert one(spark, T.clean_text(F.col("t")), t=raw) == "Xin chào Việt Nam\n\ndòng hai"


def paged(spark, pages):
    rows = [("d", i, t, "paragraph", p, ["h "], None) for i, (t, p) in enumerate(pages)]
    return spark.createDataFrame(rows, "document_id string, ordinal int, text string, kind string, page int, heading_path array<string>, metadata string")


def test_running_heads_go(spark):
    pages = [(f"Report 2020\nbody {'abc'[n - 1] * 3}\nPage {n}", n) for n in (1, 2, 3)]
    out = blocks.cleaned(paged(spark, pages)).orderBy("ordinal").collect()
    assert [r["text"] for r in out] == ["body aaa", "body bbb", "body ccc"]
    two = blocks.cleaned(paged(spark, pages[:2])).collect()
    assert all("Report" in r["text"] for r in two)
    off = blocks.cleaned(paged(spark, pages), Cleaning(remove_repeated_margins=False)).collect()
    assert all("Report" in r["text"] for r in off)


def test_empty_blocks_go_and_ordinals_close_up(spark):
    out = blocks.cleaned(paged(spark, [("a", None), (" \n ", None), ("b", None)])).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["text"]) for r in out] == [(0, "a"), (1, "b")]


@pytest.mark.parametrize(("claim", "source", "out"), [("it fits well", "it does not fits well here", True), ("it does not fits well", "it does not fits well here", False), ("something else", "it does not fits well here", False), ("chỉ một cái", "không chỉ một cái", False), ("", "", False)])
def test_negation(spark, claim, source, out):
    assert one(spark, T.reverses_negation(F.col("c"), F.col("s")), c=claim, s=source) is out


@pytest.mark.parametrize(("text", "out"), [("Châu Âu", False), ("MÃ NGUỒN", False), ("Ã©t", True), ("a â€œb", True), ("x�", True), ("ke´ ", True)])
def test_corrupted(spark, text, out):
    assert one(spark, T.corrupted(F.col("t")), t=text) is out


def test_mmr_avoids_near_duplicates_and_meets_quotas():
    vectors = [[1, 0], [0.999, 0.001], [0.8, 0.6], [0, 1]]
    assert evidence.mmr([1, 0], vectors, ["internal"] * 4, 2) == [0, 2]
    assert evidence.mmr([1, 0], vectors, ["internal", "internal", "internal", "web"], 2, quotas={"internal": 1, "web": 1}) == [0, 3]
    with pytest.raises(ValueError, match="quota"):
        evidence.mmr([1, 0], vectors[:2], ["internal", "web"], 2, quotas={"internal": 1, "web": 1})
    with pytest.raises(ValueError):
        evidence.mmr([1, 0], [[0, 0]], ["internal"], 1)
    assert evidence.mmr([1, 0], [], [], 3) == []


def test_budget_passes_over_long_strips(spark):
    rows = [(1, k, f"s{k}", "internal", "r", t) for k, t in ((1, "a" * 10), (2, "b" * 500), (3, "é\"\n"))]
    strips = spark.createDataFrame(rows, "query_id int, place int, strip_id string, source_type string, source_ref string, text string")
    out = evidence.within_budget(strips, Context(max_chars=200)).orderBy("number").collect()
    assert [(r["strip_id"], r["number"]) for r in out] == [("s1", 1), ("s3", 2)]
    assert out[1]["line"] == '{"citation":"[2]","source_type":"internal","source_ref":"r","text":"é\\"\\n"}'


def test_routing(spark):
    queries = spark.createDataFrame([(k,) for k in range(1, 6)], "query_id int")
    judged = spark.createDataFrame([(1, "relevant"), (1, "irrelevant"), (2, "irrelevant"), (3, "uncertain"), (3, "irrelevant"), (4, "uncertain")], "query_id int, relevance string")
    got = {r["query_id"]: r["action"] for r in retrieval.route(queries, judged).collect()}
    assert got == {1: "Correct", 2: "Incorrect", 3: "Ambiguous", 4: "Ambiguous", 5: "Incorrect"}


def test_answers(spark):
    contexts = spark.createDataFrame([(1, "ready"), (2, "partial"), (3, "no_evidence"), (4, "ready")], "query_id int, status string")
    claims = spark.createDataFrame([(1, 1, "it is", ["[1]"]), (1, 2, "it fits well", ["[2]"]), (2, 1, "ok", ["[1]"])], "query_id int, claim_no int, text string, refs array<string>")
    sources = spark.createDataFrame([(1, "[1]", "x"), (1, "[2]", "does not fits well now"), (2, "[1]", "y")], "query_id int, marker string, text string")
    got = {r["query_id"]: (r["status"], r["text"]) for r in evidence.answers(contexts, claims, sources, "Part:").collect()}
    assert got == {1: ("answered", "it is [1]"), 2: ("partial", "Part:\nok [1]"), 3: ("insufficient_evidence", ""), 4: ("model_abstained", "")}
    why = {r["query_id"]: r["retry"] for r in evidence.retry_reason(claims, contexts, sources).collect()}
    assert why == {1: "citation_polarity_conflict", 2: None, 3: None, 4: "abstained_with_ready_context"}


def test_claims_are_checked(spark):
    claims = spark.createDataFrame([(1, 1, "fine", ["[1]"]), (1, 2, " ", ["[1]"]), (1, 3, "see [1]", ["[1]"]), (1, 4, "x", []), (1, 5, "x", ["[1]", "[1]"]), (1, 6, "x", ["[9]"]), (1, 7, "y" * 701, ["[1]"])], "query_id int, claim_no int, text string, refs array<string>")
    citations = spark.createDataFrame([(1, "[1]")], "query_id int, marker string")
    got = {r["claim_no"]: r["problem"] for r in evidence.valid_claims(claims, citations).collect()}
    assert got == {1: None, 2: "blank", 3: "line end or marker", 4: "no citation", 5: "repeated citation", 6: "unknown citation", 7: "long"}


@pytest.mark.parametrize(
    ("url", "out"),
    [
        ("HTTPS://Example.COM/a b?q=ç#x", "https://example.com/a%20b?q=%C3%A7"), ("http://example.com", "http://example.com/"), ("ftp://example.com", None), ("http://u:p@example.com/", None),
        ("http://localhost/", None), ("http://10.0.0.1/", None), ("http://8.8.8.8:443/x", "http://8.8.8.8:443/x"), ("http://example.com:8080/", None), ("http://a.internal/", None), ("http://x/", None), (None, None),
        ("http://bücher.example.com/", "http://xn--bcher-kva.example.com/"), ("http://[::1]/", None), ("http://e%78ample.com/", None),
    ],
)
def test_public_urls(url, out):
    assert web.public_url(url) == out


def test_allowed_domains():
    assert web.public_url("http://a.example.com/", ("example.com",)) and web.public_url("http://badexample.com/", ("example.com",)) is None


def test_page_text():
    html = "<title>T</title><nav>no</nav><div>d</div><p>a  b<br>c</p><script>var t='</p>';</script><ul><li>x<li>y</ul><form>f</form>"
    assert web.html_text(html) == "Td\n\na b c\n\nx\n\ny"


def rows_of(spark, document, path, n, text="t", dims=2):
    return spark.createDataFrame(
        [(document, path, "h", "s", n, f"{document}-{i}-{text}", i, text, len(text), [1.0] + [0.0] * (dims - 1), {5: 1.0}) for i in range(n)],
        "document_id string, source_path string, content_hash string, pipeline_signature string, chunk_count int, chunk_id string, ordinal int, text string, char_count int, dense array<double>, lexical map<bigint,double>",
    )


def test_index_store_replaces_by_version(spark, tmp_path):
    store = index.IndexStore(spark, f"file://{tmp_path}/index")
    assert store.read() is None
    store.replace(rows_of(spark, "a", "/a", 2).union(rows_of(spark, "b", "/b", 1)), 2)
    first = store.version()
    store.replace(rows_of(spark, "a", "/a", 3, "new"), 2)
    assert store.version() != first
    got = {r["document_id"]: r["n_chunks"] for r in index.documents(store.read()).collect()}
    assert got == {"a": 3, "b": 1}
    with pytest.raises(ValueError, match="ordinals"):
        store.replace(rows_of(spark, "c", "/c", 3).where("ordinal <> 1"), 2)
    with pytest.raises(ValueError, match="vectors"):
        store.replace(rows_of(spark, "c", "/c", 1), 3)
    assert store.chunks("a").count() == 3
    store.delete(["a"])
    store.vacuum()
    assert [r["document_id"] for r in index.documents(store.read()).collect()] == ["b"]


def test_index_issues(spark):
    good = rows_of(spark, "a", "/a", 2)
    assert index.issues(good, 2, declared_points=2).count() == 0
    bad = good.withColumn("char_count", F.lit(9)).withColumn("dense", F.array(F.lit(3.0), F.lit(0.0))).withColumn("lexical", F.lit(None).cast("map<bigint,double>")).withColumn("chunk_count", F.lit(5)).withColumn("ordinal", F.lit(7))
    codes = {r["code"] for r in index.issues(bad, 2, declared_points=9).collect()}
    assert codes == {"incomplete_update", "chunk_count_mismatch", "vector_norm", "sparse_vector_missing", "char_count", "ordinal_gap", "point_count"}


def test_stale_index_is_refused(spark):
    states = spark.createDataFrame([("a", "current"), ("b", "source_changed")], "document_id string, status string")
    with pytest.raises(RuntimeError, match="source_changed"):
        index.require_current(states)
    index.require_current(states, "a")


def test_chat(spark):
    sessions = spark.createDataFrame([("s", "New", False, 1, 1), ("t", "Mine", True, 2, 2)], "session_id string, title string, title_custom boolean, created_at int, updated_at int")
    none = spark.createDataFrame([], "message_id long, session_id string, role string, text string")
    assert [r["turn_count"] for r in chat.sessions(sessions, none).collect()] == [0, 0]
    new = spark.createDataFrame([("s", " What  is\nthis? ", "x", 1, 9), ("t", "q", "a", 3, 9), ("zz", "q", "a", 5, 9)], "session_id string, question string, answer string, message_id long, created_at int")
    s, m = chat.appended(sessions, none, new)
    assert {r["session_id"]: r["title"] for r in s.collect()} == {"s": "What is this?", "t": "Mine"}
    assert m.count() == 4
    s2, m2 = chat.deleted(s, m, "s")
    assert s2.count() == 1 and m2.count() == 2
    with pytest.raises(ValueError):
        chat.renamed(s, "s", " ")


def test_signature_covers_settings():
    assert Ingestion().signature() == Ingestion().signature() != Ingestion(dimensions=8).signature()
    assert canonical_json({"b": "é", "a": [1]}) == '{"a":[1],"b":"é"}'


def test_ingest_folder_and_stream(spark, tmp_path):
    from tarnflow.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Hello there.\n\nSecond part.")
    (folder / "b.md").write_text("# Title\n\nBody text.")
    (folder / "bad.pdf").write_bytes(b"nothing")
    store = index.IndexStore(spark, f"file://{tmp_path}/index")
    first = {r["source_path"].rpartition("/")[2]: r["status"] for r in ingest.ingest(spark, str(folder), store).collect()}
    assert first["a.txt"] == first["b.md"] == "indexed" and first["bad.pdf"] not in ("indexed", "skipped")
    again = {r["source_path"].rpartition("/")[2]: r["status"] for r in ingest.ingest(spark, str(folder), store).collect()}
    assert again["a.txt"] == again["b.md"] == "skipped"
    rows = store.read().collect()
    assert index.issues(store.read(), 64).count() == 0 and all(math.isclose(sum(x * x for x in r["dense"]), 1, abs_tol=1e-9) for r in rows)
    other = index.IndexStore(spark, f"file://{tmp_path}/other")
    ingest.start(spark, str(folder), other, f"{tmp_path}/ck").awaitTermination(90)
    assert other.read().count() == len(rows)




def test_searches_in_blocks_and_slices_equal_brute_force(spark, monkeypatch):
    import numpy as np

    for name, value in {"QUERY_ROWS": 3, "SLICE": 4, "PAIRS": 5, "SCAN_BYTES": 200}.items():
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(5)
    n, m, k = 40, 11, 6
    weights = np.where(rng.random((n, 9)) < 0.4, rng.integers(1, 4, (n, 9)), 0)
    asked = np.where(rng.random((m, 9)) < 0.5, rng.integers(1, 4, (m, 9)), 0)
    vectors, looked = rng.integers(-3, 4, (n, 2)).astype(float), rng.integers(-3, 4, (m, 2)).astype(float)
    held = [(i, vectors[i].tolist(), {t: float(w) for t, w in enumerate(weights[i]) if w}) for i in range(n)]
    held += [(100, None, {0: 1.0}), (101, [0.0, 1.0], None)]
    rows = spark.createDataFrame(held, "chunk_id long, vector array<double>, lexical map<bigint,double>").repartition(3)
    posts = spark.createDataFrame([(q, t, float(w)) for q in range(m) for t, w in enumerate(asked[q]) if w], "query_id int, token_id long, weight double")
    near = spark.createDataFrame([(q, looked[q].tolist()) for q in range(m)], "query_id int, vector array<double>")

    def best(score, keys, positive):
        return {(q, keys[i], r + 1) for q in range(m) for r, i in enumerate([i for i in sorted(range(len(keys)), key=lambda i: (-score[i][q], keys[i])) if score[i][q] > 0 or not positive][:k])}

    dense = best(np.vstack([vectors, [0.0, 1.0]]) @ looked.T, [*range(n), 101], False)
    sparse = best(np.vstack([weights, np.eye(9)[0]]) @ asked.T, [*range(n), 100], True)
    took = lambda table: {(r["query_id"], r["chunk_id"], r["rank"]) for r in table.collect()}
    assert took(retrieval.dense_top(near, rows, k)) == dense
    assert took(retrieval.sparse_top(posts, rows, k)) == sparse
    both = retrieval.hybrid_top(near, posts, rows, k)
    assert took(both.where("list = 0")) == dense and took(both.where("list = 1")) == sparse
    assert retrieval.sparse_top(posts.limit(0), rows, k).count() == retrieval.dense_top(near, rows.limit(0), k).count() == 0


def test_paragraphs_of_rows_alike_and_of_long_texts(spark):
    text = " a\n\n\n b \nc\n \t\n\nlast"
    rows = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, "", 0), (None, None, 0), (3, "x\n\n" * 50_000, 0)], "doc_id long, text string, ordinal int")
    got = blocks.paragraphs(rows)
    assert got.where("doc_id = 3").count() == 50_000
    same = sorted(tuple(r)[1:] for r in got.where("doc_id < 3").collect())
    assert same == sorted([(0, "a", 1, 2, 1, 1), (1, "b \nc", 6, 10, 4, 5), (2, "last", 15, 19, 8, 8)] * 2)
    assert got.where("doc_id is null").count() == 0
