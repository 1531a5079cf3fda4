"""What is searched, read or cut is so once, whatever is made of it later."""

import pytest
from pyspark.sql import functions as F

from tarnflow.functions.embedding import embedder
from tarnflow.operators import evidence, retrieval
from tarnflow.plans import queries
from tarnflow.plans.corrective import Corrective

TEXTS = ["The river Lune crosses the northern town.", "Nothing else is there.", "A town in the north has a river, and the river a bridge. The bridge of the town is old.", ""]


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_a_corrective_plan_searches_and_cuts_documents_once(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"{t} {i % 5}" if t else t) for i, t in enumerate(TEXTS * 6)], "chunk_id string, text string").withColumn("e", embedder()(F.col("text")))
    index = chunks.select("chunk_id", "text", F.col("e.dense").alias("vector"), F.col("e.lexical").alias("lexical"))
    asked = spark.createDataFrame([(1, "Which river crosses the northern town?"), (2, "bridge of the old town"), (3, " "), (4, "unheard")], "query_id long, text string")
    one, two = Corrective(index, index), Corrective(index, index.select("chunk_id", "lexical"))
    found = one.retrieve(asked, 5)
    # One pass over the index serves both searches; without it there are two.
    assert _plan(found).count("MapInArrow") == 1
    hits = found.collect()
    assert hits and sorted(hits) == sorted(two.retrieve(asked, 5).collect())
    contexts, kept = one.assemble(asked, 5, 3)
    assert "MapInArrow" not in _plan(contexts) and {r["query_id"]: r["status"] for r in contexts.collect()}[1] == "ready"
    assert kept.groupBy("query_id", "strip_id").count().where("count > 1").isEmpty()


def _tables(spark, folder):
    spark.createDataFrame([(i, f"http://a.example/{i}", f"<h1>Page {i}</h1><p>{TEXTS[i % 4]}</p>") for i in range(12)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, "Which river crosses the northern town?"), (2, "unheard")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pages_that_are_searched_and_cut_are_read_once(spark, tmp_path):
    out = queries.web_strips(spark, _tables(spark, tmp_path))
    assert "html" not in _plan(out) and {r["query_id"] for r in out.collect()} == {1}


def _documents(spark, folder):
    """Documents that share terms with the questions, long lists of them, and judgments of some."""
    rows = [(i, f"{TEXTS[i % 3]} {'river town ' * (i % 7)}", "en", f"src{i % 3}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i // 2 % 2, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return _tables(spark, folder)


#: Queries that read their contexts several times.
KEPT = {"run_summaries", "answer_lines"}


@pytest.mark.parametrize("name", ["context_status", "branch_problems", "run_summaries", "answer_lines"])
def test_documents_are_searched_once_for_actions_and_contexts(spark, tmp_path, name, monkeypatch):
    d, asked, search = _documents(spark, tmp_path), [], queries._sparse
    monkeypatch.setattr(queries, "_sparse", lambda *a: asked.append(a[-1]) or search(*a))
    out = queries.QUERIES[name](spark, d)
    assert asked == [12] and "MapInArrow" not in _plan(out)
    if name in KEPT:
        # Texts of documents are read, and put into the budget, once; the result has rows.
        assert "REPARTITION_BY" not in _plan(out) and "InMemoryTableScan" not in _plan(out) and out.count() == 2
        return
    # As from two searches of their own.
    actions = retrieval.route(queries._questions(spark, d), queries._judged(spark, d))
    kept = queries._budgeted(spark, d)
    wanted = evidence.contexts(actions, kept).select("query_id", "status", F.length("text").alias("chars"), "markers") if name == "context_status" else evidence.impure(kept, actions)
    assert asked == [12, 3, 12] and sorted(out.collect()) == sorted(wanted.collect())
