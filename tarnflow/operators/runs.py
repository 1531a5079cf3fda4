"""Whole results of runs as rows of JSON, of several versions, and back.

Version 1 is of runs before answers were kept; 2 has answers without the number of attempts; 3 is what is written now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 3
#: What a decision may be, and what a hit may be judged.
ACTIONS = ("Correct", "Ambiguous", "Incorrect")
RELEVANCE = ("relevant", "irrelevant", "uncertain")

_META = "metadata:map<string,string>"
STRIP = f"struct<strip_id:string,text:string,source_type:string,source_ref:string,{_META}>"
CITATION = f"struct<marker:string,strip_id:string,source_type:string,source_ref:string,{_META}>"
CHUNK = f"struct<chunk_id:string,document_id:string,ordinal:int,text:string,char_count:int,pages:array<int>,heading_path:array<string>,{_META}>"
HIT = f"struct<chunk:{CHUNK},score:double,source_path:string,stored_path:string,rerank_score:double,relevance:string,reason:string>"
CONTEXT = f"struct<status:string,context_text:string,selected_strips:array<{STRIP}>,citations:array<{CITATION}>,warnings:array<string>>"
ANSWER = f"struct<status:string,text:string,model:string,citations:array<{CITATION}>,attempts:int,retry_reason:string>"
STATE = (
    f"question:string,decision:struct<action:string,model:string,hits:array<{HIT}>>,internal_strips:array<{STRIP}>,web_strips:array<{STRIP}>,"
    f"web_queries:array<string>,source_urls:array<string>,context:{CONTEXT},answer:{ANSWER},answer_pending:boolean,warnings:array<string>"
)
_NEEDED = ["decision", "internal_strips", "web_strips", "web_queries", "source_urls", "context", "warnings"]


def write_states(results: DataFrame) -> DataFrame:
    """results: run_id, state (struct of STATE). run_id, version, state (JSON; null fields are left out)."""
    return results.select("run_id", F.lit(VERSION).alias("version"), F.to_json("state").alias("state"))


def _list(x: Column, kind: str) -> Column:
    return F.coalesce(x, F.array().cast(kind))


def _with(x: Column, fields: str, **new: Column) -> Column:
    """A struct of x's fields, some of them new; null where x is null. Built of single fields, as chained withField copies its input at each step."""
    own = F.struct(*(new.get(name, x[name]).alias(name) for name in fields.split()))
    return F.when(x.isNotNull(), own)


def _upcast(rows: DataFrame) -> DataFrame:
    """rows with state as it is written now. What earlier versions leave out: lists and maps are empty, attempts 0, nothing is pending."""
    none = F.create_map().cast("map<string,string>")
    metadata = lambda x: F.coalesce(x["metadata"], none)
    strips = lambda c: F.transform(c, lambda x: _with(x, "strip_id text source_type source_ref metadata", metadata=metadata(x)))
    citations = lambda c: F.transform(c, lambda x: _with(x, "marker strip_id source_type source_ref metadata", metadata=metadata(x)))

    def chunk(c: Column) -> Column:
        fields = "chunk_id document_id ordinal text char_count pages heading_path metadata"
        return _with(c, fields, pages=_list(c["pages"], "array<int>"), heading_path=_list(c["heading_path"], "array<string>"), metadata=metadata(c))

    hit = lambda h: _with(h, "chunk score source_path stored_path rerank_score relevance reason", chunk=chunk(h["chunk"]))
    decision, context, answer = (F.col(f"_s.{x}") for x in ("decision", "context", "answer"))
    new = {
        "decision": _with(decision, "action model hits", hits=F.transform(decision["hits"], hit)),
        "internal_strips": strips(F.col("_s.internal_strips")),
        "web_strips": strips(F.col("_s.web_strips")),
        "context": _with(context, "status context_text selected_strips citations warnings", selected_strips=strips(context["selected_strips"]), citations=citations(context["citations"])),
        "answer": _with(answer, "status text model citations attempts retry_reason", attempts=F.coalesce(answer["attempts"], F.lit(0)), citations=citations(answer["citations"])),
        "answer_pending": F.coalesce("_s.answer_pending", F.lit(False)),
    }
    names = [f.name for f in rows.schema["state"].dataType.fields]
    state = F.struct(*(new.get(x, F.col(f"_s.{x}")).alias(x) for x in names))
    return rows.withColumnRenamed("state", "_s").select("run_id", "version", F.when(F.col("reason").isNull(), state).alias("state"), "reason", F.col("_raw").alias("raw"))


def read_states(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: run_id, version (null: 1), state. (run_id, version, state as a struct of STATE, upcast), and (run_id, version, reason) of those refused.

    Every row is in one of the two; rows alike are read alike. Refused is what judged_states() has a reason for.
    """
    read = judged_states(rows)
    return read.where("reason IS NULL").select("run_id", "version", "state"), read.where("reason IS NOT NULL").select("run_id", "version", "reason")


def judged_states(rows: DataFrame) -> DataFrame:
    """run_id, version, state (null where refused), reason (null where not), raw (as it was given): both sides of read_states() in one pass.

    Refused: a version that is not known, what is no JSON object of these types, a missing part (from version 2 on, the answer too, and from 3 on its
    attempts), an action or relevance that is not known, a run whose answer is still to come.
    """
    version = F.coalesce(F.col("version"), F.lit(1))
    read = rows.select("run_id", version.alias("version"), F.from_json("state", f"struct<{STATE}>", {"mode": "PERMISSIVE"}).alias("state"), F.col("state").alias("_raw"))
    s = F.col("state")
    object_ = F.get_json_object("_raw", "$").isNotNull() & F.ltrim("_raw").startswith("{")
    missing = F.coalesce(*(F.when(s[x].isNull(), F.lit(f"missing {x}")) for x in _NEEDED), F.when(s["decision"]["hits"].isNull(), F.lit("missing hits")))
    late = F.when(F.col("version") >= 2, F.when(s["answer"].isNull(), F.lit("missing answer")))
    later = F.when(F.col("version") >= 3, F.when(s["answer"]["attempts"].isNull(), F.lit("missing attempts")))
    known = F.forall(s["decision"]["hits"], lambda h: F.coalesce(h["relevance"].isin(*RELEVANCE), F.lit(False)))
    reason = F.coalesce(
        F.when(~F.col("version").between(1, VERSION), F.lit("version")),
        F.when(~F.coalesce(object_, F.lit(False)), F.lit("json")),
        F.when(F.coalesce(s["answer_pending"], F.lit(False)), F.lit("answer pending")),
        missing,
        F.when(~F.coalesce(s["decision"]["action"].isin(*ACTIONS), F.lit(False)), F.lit("action")),
        F.when(~known, F.lit("relevance")),
        late,
        later,
    )
    read = read.withColumn("reason", reason)
    return _upcast(read)
