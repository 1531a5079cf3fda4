"""Queries of run states, of selections and of the index as a log, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.embedding import postings
from ..lineage import cut, shared_dir
from ..operators import evidence, pruned, runs
from ..operators.index import IndexStore
from .sql_parts import sparse
from .tables import dealt, read

#: Bytes of text whose words a task counts at a time.
COUNTED = 4 << 20

_SOURCE = "concat('src-', source)"


def _candidates(spark, d):
    """Documents of a source as the strips of a question, that of the source."""
    rows = read(spark, d, "documents").selectExpr("source AS query_id", "cast(doc_id AS string) AS strip_id", "text", "CASE WHEN doc_id % 2 = 0 THEN 'web' ELSE 'internal' END AS source_type", f"{_SOURCE} AS source_ref", "doc_id")
    return rows.where("source IS NOT NULL")


def selection_proof(spark, d):
    """Selections of every tenth document, some of them twice, changed, or of another source; too many where a source has over 200 of them."""
    have = _candidates(spark, d)
    chosen = have.where("doc_id % 10 = 0").withColumn("text", F.expr("CASE WHEN doc_id % 70 = 0 THEN concat(text, '.') ELSE text END"))
    chosen = chosen.withColumn("strip_id", F.expr("CASE WHEN doc_id % 110 = 0 THEN concat('no-', strip_id) ELSE strip_id END"))
    chosen = chosen.unionByName(chosen.where("doc_id % 130 = 0"))
    return evidence.selection_problems(chosen, have, 200).groupBy("query_id", "problem").agg(F.count("*").alias("n"))


def _state(version):
    """The state of a document's run as JSON, as that version wrote it."""
    strip = "named_struct('strip_id', concat(doc_id, ':strip:0'), 'text', text, 'source_type', 'internal', 'source_ref', concat(doc_id), 'metadata', map('lang', lang))"
    chunk = "named_struct('chunk_id', concat(doc_id), 'document_id', source, 'ordinal', 0, 'text', text, 'char_count', length(text)" + (", 'pages', array(1, 2), 'heading_path', array(lang)" if version > 1 else "") + ")"
    relevance = "CASE WHEN doc_id % 17 = 0 THEN 'good' WHEN doc_id % 2 = 0 THEN 'relevant' ELSE 'uncertain' END"
    hit = f"named_struct('chunk', {chunk}, 'score', 0.5D, 'source_path', source, 'stored_path', source, 'rerank_score', 1.5D, 'relevance', {relevance}, 'reason', 'r')"
    action = "CASE WHEN doc_id % 19 = 0 THEN 'Maybe' WHEN doc_id % 2 = 0 THEN 'Correct' ELSE 'Ambiguous' END"
    answer = f"named_struct('status', 'answered', 'text', substr(text, 1, 50), 'model', 'm', 'citations', array(named_struct('marker', '[1]', 'strip_id', concat(doc_id, ':strip:0'), 'source_type', 'internal', 'source_ref', concat(doc_id), 'metadata', map('lang', lang)))" + (", 'attempts', cast(doc_id % 3 AS int)" if version > 2 else "") + ")"
    context = f"named_struct('status', 'ready', 'context_text', text, 'selected_strips', array({strip}), 'citations', array(), 'warnings', array())"
    fields = {"question": "lang", "decision": f"named_struct('action', {action}, 'model', 'm', 'hits', array({hit}))", "internal_strips": f"array({strip})", "web_strips": "array()", "web_queries": "array(lang)", "source_urls": "array()", "context": context, "warnings": "array('w')"}
    if version > 1:
        fields["answer"] = answer
        fields["answer_pending"] = "doc_id % 23 = 0"
    return "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + "))"


def run_states(spark, d):
    """Runs of three versions, some of a version that is not known or cut off, read into one type, written again and read back."""
    docs = read(spark, d, "documents")
    version = "CASE WHEN doc_id % 29 = 0 THEN 9 ELSE 1 + doc_id % 3 END"
    state = f"CASE {' '.join(f'WHEN doc_id % 3 = {v - 1} THEN {_state(v)}' for v in (1, 2, 3))} END"
    rows = docs.selectExpr("doc_id AS run_id", f"cast({version} AS int) AS version", f"substr({state}, CASE WHEN doc_id % 31 = 0 THEN 2 ELSE 1 END) AS state")
    # Each state is read once: what is read is kept, and what is written again stays beside what is read of it, so no state is joined.
    first = cut(runs.judged_states(rows).drop("raw"))
    # Runs without an answer stay version 1: what is written now always has one.
    has_answer = F.coalesce(F.col("state.answer").isNotNull(), F.lit(False))
    again, legacy = runs.judged_states(runs.write_states(first.where(has_answer))), first.where(~has_answer)
    good = F.col("reason").isNull()
    shown = lambda rows, same: rows.select("run_id", "version", *(F.when(good, c).alias(n) for n, c in {
        "action": F.col("state.decision.action"), "n_hits": F.size("state.decision.hits"), "n_pages": F.size(F.col("state.decision.hits")[0]["chunk"]["pages"]),
        "attempts": F.col("state.answer.attempts"), "context_md5": F.md5("state.context.context_text"), "same": same,
    }.items()), "reason")
    return shown(again, F.to_json("state") == F.col("raw")).unionByName(shown(legacy, F.lit(None).cast("boolean")))


def logged_index(spark, d):
    """An index of documents, made by five changes and a later one that replaces every sixth document, read back."""
    docs = read(spark, d, "documents")
    rows = docs.where("text <> ''").dropDuplicates(["doc_id"]).selectExpr(
        "cast(doc_id AS string) AS document_id", "concat('/corpus/', doc_id) AS source_path", "md5(text) AS content_hash", "'now' AS pipeline_signature", "1 AS chunk_count",
        "concat('c', doc_id) AS chunk_id", "0 AS ordinal", "text", "length(text) AS char_count", "array(1.0D) AS dense", "map(1L, 1.0D) AS lexical", "doc_id",
    )
    store = IndexStore(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", fan=4)
    for k in range(5):
        store.replace(rows.where(F.col("doc_id") % 5 == k).drop("doc_id"), 1)
    changed = rows.where("doc_id % 6 = 0").withColumn("text", F.concat(F.lit("new "), "text")).withColumn("char_count", F.length("text"))
    store.replace(changed.drop("doc_id"), 1)
    out = cut(store.read().select(F.col("document_id").cast("long").alias("doc_id"), "chunk_id", "char_count", F.md5("text").alias("text_md5")))
    store.remove()
    return out


def pruned_topk(spark, d):
    """sparse_topk by postings in blocks."""
    asked = postings(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id")
    # Texts are dealt out by document once, so that counting their words moves nothing more.
    docs = read(spark, d, "documents").select("doc_id", "text")
    index = pruned.posting_blocks(postings(dealt(docs, "doc_id", "text", COUNTED), "doc_id"), "doc_id", documents=docs.count())
    out = cut(pruned.pruned_top(asked, index, 10)[0])
    index.remove()
    return out


QUERIES = {f.__name__: f for f in (selection_proof, run_states, logged_index, pruned_topk)}

SQL = {
    "pruned_topk": f"WITH {sparse(10)} SELECT query_id, doc_id, score, rank FROM sparse",
    "selection_proof": """
WITH have AS (SELECT source AS q, doc_id::VARCHAR AS s, text FROM documents WHERE source IS NOT NULL),
one AS (SELECT source AS q, CASE WHEN doc_id % 110 = 0 THEN 'no-' ELSE '' END || doc_id AS s, CASE WHEN doc_id % 70 = 0 THEN text || '.' ELSE text END AS text, doc_id FROM documents WHERE source IS NOT NULL AND doc_id % 10 = 0),
chosen AS (SELECT q, s, text FROM one UNION ALL SELECT q, s, text FROM one WHERE doc_id % 130 = 0),
found AS (SELECT q, 'too_many' AS problem, 1 AS n FROM chosen GROUP BY q HAVING count(*) > 200
  UNION ALL SELECT q, 'repeated', 1 FROM chosen GROUP BY q, s HAVING count(*) > 1
  UNION ALL SELECT q, 'unknown', 1 FROM (SELECT DISTINCT q, s FROM chosen WHERE starts_with(s, 'no-'))
  UNION ALL SELECT q, 'changed', 1 FROM (SELECT DISTINCT c.q, c.s FROM chosen c JOIN have h ON h.q = c.q AND h.s = c.s WHERE c.text <> h.text))
SELECT q AS query_id, problem, count(*) AS n FROM found GROUP BY ALL""",
    "run_states": """
WITH r AS (SELECT doc_id, 1 + doc_id % 3 AS v, text FROM documents),
w AS (SELECT *, CASE WHEN doc_id % 29 = 0 THEN 'version' WHEN doc_id % 31 = 0 THEN 'json' WHEN v > 1 AND doc_id % 23 = 0 THEN 'answer pending' WHEN doc_id % 19 = 0 THEN 'action' WHEN doc_id % 17 = 0 THEN 'relevance' END AS reason FROM r)
SELECT doc_id AS run_id, CASE WHEN doc_id % 29 = 0 THEN 9 WHEN reason IS NOT NULL OR v = 1 THEN v ELSE 3 END::INT AS version,
  CASE WHEN reason IS NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'Correct' ELSE 'Ambiguous' END END AS action, CASE WHEN reason IS NULL THEN 1 END AS n_hits,
  CASE WHEN reason IS NULL THEN CASE WHEN v = 1 THEN 0 ELSE 2 END END AS n_pages, CASE WHEN reason IS NULL THEN CASE v WHEN 2 THEN 0 WHEN 3 THEN doc_id % 3 END END::INT AS attempts,
  CASE WHEN reason IS NULL THEN md5(text) END AS context_md5, CASE WHEN reason IS NULL AND v > 1 THEN true END AS same, reason FROM w""",
    "logged_index": """
SELECT doc_id, 'c' || doc_id AS chunk_id, length(t)::INT AS char_count, md5(t) AS text_md5
FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'new ' || text ELSE text END AS t FROM documents WHERE text <> '')""",
}
