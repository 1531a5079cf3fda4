import json

import pytest

from tarnflow.operators import evidence, runs
from tarnflow.plans import run_queries

STRIP = {"strip_id": "s", "text": "t", "source_type": "internal", "source_ref": "c", "metadata": {"page": "3"}}
CITATION = {"marker": "[1]", "strip_id": "s", "source_type": "internal", "source_ref": "c", "metadata": {"page": "3"}}


def state(version=3, **changes):
    chunk = {"chunk_id": "c", "document_id": "d", "ordinal": 0, "text": "t", "char_count": 1, "pages": [2], "heading_path": ["h"], "metadata": {"k": "v"}}
    hit = {"chunk": chunk, "score": 0.5, "source_path": "/p", "stored_path": "/q", "rerank_score": 1.0, "relevance": "relevant", "reason": "r"}
    out = {
        "question": "q", "decision": {"action": "Correct", "model": "m", "hits": [hit]}, "internal_strips": [STRIP], "web_strips": [], "web_queries": ["w"], "source_urls": ["u"],
        "context": {"status": "ready", "context_text": "x", "selected_strips": [STRIP], "citations": [CITATION], "warnings": []},
        "answer": {"status": "answered", "text": "a", "model": "m", "citations": [CITATION], "attempts": 2, "retry_reason": "why"}, "answer_pending": False, "warnings": ["w"],
    }
    if version < 3:
        del out["answer"]["attempts"], out["answer"]["retry_reason"]
        out["internal_strips"] = [{k: v for k, v in STRIP.items() if k != "metadata"}]
    if version < 2:
        for k in ("pages", "heading_path", "metadata"):
            del chunk[k]
        del out["answer"], out["answer_pending"]
    return out | changes


def table(spark, rows):
    return spark.createDataFrame([(k, v, s if s is None or isinstance(s, str) else json.dumps(s)) for k, (v, s) in enumerate(rows)], "run_id long, version int, state string").selectExpr("*", "1 as reason")


def test_versions_are_read_into_one_type_and_back(spark):
    good, bad = runs.read_states(table(spark, [(3, state()), (2, state(2)), (1, state(1)), (None, state(1)), (3, state())]))
    rows = {r["run_id"]: (r["version"], r["state"].asDict(recursive=True)) for r in good.collect()}
    assert bad.count() == 0 and rows[0] == (3, state()) and rows[4] == rows[0]
    assert rows[1][0] == 2 and rows[1][1]["answer"]["attempts"] == 0 and rows[1][1]["answer"]["retry_reason"] is None and rows[1][1]["internal_strips"][0]["metadata"] == {}
    assert rows[2] == rows[3] and rows[2][1]["answer"] is None and rows[2][1]["answer_pending"] is False
    chunk = rows[2][1]["decision"]["hits"][0]["chunk"]
    assert (chunk["pages"], chunk["heading_path"], chunk["metadata"]) == ([], [], {})
    again, lost = runs.read_states(runs.write_states(good.where("state.answer IS NOT NULL")))
    assert lost.count() == 0
    assert {r["run_id"]: r["state"].asDict(recursive=True) for r in again.collect()} == {k: v for k, (_, v) in rows.items() if v["answer"]}


def test_states_that_are_refused(spark):
    decision = state()["decision"]
    cases = [
        ("version", 9, state()), ("version", 0, state()), ("json", 3, "{"), ("json", 3, None), ("json", 3, "[1]"), ("json", 3, ""), ("answer pending", 3, state(answer_pending=True)),
        ("missing context", 3, state(context=None)), ("missing hits", 3, state(decision=decision | {"hits": None})), ("missing web_queries", 1, state(1, web_queries=None)),
        ("action", 3, state(decision=decision | {"action": "Maybe"})), ("action", 3, state(decision=decision | {"action": None})),
        ("relevance", 3, state(decision=decision | {"hits": [decision["hits"][0] | {"relevance": "good"}]})), ("missing answer", 2, state(1)), ("missing attempts", 3, state(2)),
    ]
    good, bad = runs.read_states(table(spark, [(v, s) for _, v, s in cases]))
    assert good.count() == 0
    assert {r["run_id"]: r["reason"] for r in bad.collect()} == {k: c[0] for k, c in enumerate(cases)}
    empty = runs.read_states(table(spark, []))
    assert empty[0].count() == empty[1].count() == 0


HELD = "query_id long, strip_id string, text string, source_type string, source_ref string"


def test_a_selector_may_only_choose(spark):
    have = [(1, f"s{k}", f"t{k}", "web", "u") for k in range(5)] + [(1, "n", None, "web", None), (2, "s0", "other", "web", "u")]
    candidates = spark.createDataFrame(have, HELD).selectExpr("*", "1 as mark")
    problems = lambda rows, limit=8: sorted((r[0], r[1] or "", r[2]) for r in evidence.selection_problems(spark.createDataFrame(rows, HELD), candidates, limit).collect())
    assert problems(have) == problems([]) == problems(have[:1]) == []
    assert problems(have[:3], 2) == [(1, "", "too_many")]
    assert problems([have[0], have[0], have[5]]) == [(1, "s0", "repeated")]
    found = evidence.selection_problems(spark.createDataFrame([(2, "s1", "t1", "web", "u"), (None, "s1", "t1", "web", "u"), (1, None, "t", "web", "u")], HELD), candidates, 8)
    assert {tuple(r) for r in found.collect()} == {(2, "s1", "unknown"), (None, "s1", "unknown"), (1, None, "unknown")}
    assert problems([(1, "s0", "t0 ", "web", "u"), (1, "s1", "t1", "internal", "u"), (1, "n", "", "web", None)]) == [(1, "n", "changed"), (1, "s0", "changed"), (1, "s1", "changed")]
    assert problems([have[0], (1, "s0", "t9", "web", "u")]) == [(1, "s0", "changed"), (1, "s0", "repeated")]


def test_a_state_is_judged_in_one_pass_and_no_state_is_joined(spark, tmp_path):
    rows = table(spark, [(3, state()), (3, "{"), (1, state(1))])
    judged = {r["run_id"]: r for r in runs.judged_states(rows).collect()}
    assert [judged[k]["reason"] for k in range(3)] == [None, "json", None] and [judged[k]["state"] is None for k in range(3)] == [False, True, False]
    assert {k: r["raw"] for k, r in judged.items()} == {r["run_id"]: r["state"] for r in rows.collect()}
    documents = [(k, f"text {k}", "en", "s") for k in (1, 1, 2, 3, 17, 19, 29, 31)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = run_queries.run_states(spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    # Two runs of one id are two rows.
    assert sorted((r["run_id"], r["reason"] or "") for r in out.collect()) == [(1, ""), (1, ""), (2, ""), (3, ""), (17, "relevance"), (19, "action"), (29, "version"), (31, "json")]
