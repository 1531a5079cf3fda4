"""From strips to an answer: diverse selection, context within a budget, citations, claims.

Selection and the budget are greedy by nature. Each query has a bounded list of strips, so one group is one query's list.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Answer, Context
from ..functions.text import corrupted, nfc, reverses_negation

#: Statuses of contexts and answers, and reasons to ask again.
NO_EVIDENCE, READY, PARTIAL = "no_evidence", "ready", "partial"
ANSWERED, ABSTAINED, INSUFFICIENT = "answered", "model_abstained", "insufficient_evidence"
CORRUPTED, POLARITY, NOTHING = "corrupted_unicode", "citation_polarity_conflict", "abstained_with_ready_context"
#: What is said of an answer that cannot be given, or in part only.
NO_ANSWER_TEXT = "Không đủ bằng chứng đã kiểm chứng để trả lời câu hỏi."
ABSTAINED_TEXT = "Mô hình chưa tạo được câu trả lời có trích dẫn từ các bằng chứng đã chọn. Điều này không có nghĩa là tài liệu không chứa câu trả lời."
PARTIAL_NOTICE = "Bằng chứng hiện chưa đầy đủ; câu trả lời chỉ dựa trên các nguồn đã thu thập được."
QUOTA = "near-duplicate strips leave a source's quota unmet"


def mmr(query: list[float], vectors: list[list[float]], sources: list[str], limit: int, weight: float = 0.6, duplicate: float = 0.85, quotas: dict[str, int] | None = None) -> list[int]:
    """Maximal marginal relevance: the places of the chosen vectors, in order.

    What has nearness `duplicate` or more to one chosen is out. Each source's quota is met first. Ties go to the more relevant, then the earlier.
    """
    quotas = quotas or {}
    if limit < 0 or sum(quotas.values()) > limit or any(n < 0 for n in quotas.values()):
        raise ValueError("quotas must not be negative and fit the limit")
    if any(sources.count(s) < n for s, n in quotas.items()):
        raise ValueError("a source has too few strips for its quota")
    if not vectors or not limit:
        return []

    def unit(v: list[float]) -> list[float]:
        size = math.sqrt(sum(x * x for x in v)) if v else 0.0
        if not size or not math.isfinite(size):
            raise ValueError("vectors must be finite and not zero")
        return [x / size for x in v]

    def near(a: list[float], b: list[float]) -> float:
        if len(a) != len(b):
            raise ValueError("vectors differ in length")
        return max(0.0, sum(x * y for x, y in zip(a, b, strict=True)))

    q, units = unit(query), [unit(v) for v in vectors]
    worth = [near(q, u) for u in units]
    closest = [0.0] * len(units)
    chosen: list[int] = []
    steps = [s for s, n in quotas.items() for _ in range(n)] + [None] * limit
    for source in steps:
        if len(chosen) >= limit:
            break
        free = [i for i in range(len(units)) if i not in chosen and (source is None or sources[i] == source) and not (chosen and closest[i] >= duplicate)]
        if not free:
            if source is not None:
                raise ValueError(QUOTA)
            break
        best = max(free, key=lambda i: (weight * worth[i] - (1 - weight) * closest[i], worth[i], -i))
        chosen.append(best)
        closest = [max(c, near(u, units[best])) for c, u in zip(closest, units, strict=True)]
    return chosen


def select_diverse(strips: DataFrame, config: Context = Context(), query: str = "query_id") -> DataFrame:
    """strips: query, query_vector, strip_id, source_type, vector, position (order among the query's strips), action. The chosen ones with place (from 1).

    Where the action is Ambiguous and both sources have strips, each gets one place at least, unless only near-duplicates would fill it.
    """
    kind = strips.schema[query].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        sources, vectors = group["source_type"].tolist(), [list(v) for v in group["vector"]]
        if group["strip_id"].duplicated().any():
            raise ValueError("strip ids of a query must be unique")
        both = group["action"].iloc[0] == "Ambiguous" and {"internal", "web"} <= set(sources) and config.max_strips >= 2
        options = (list(group["query_vector"].iloc[0]), vectors, sources, config.max_strips, config.relevance_weight, config.duplicate_threshold)
        try:
            order = mmr(*options, {"internal": 1, "web": 1} if both else None)
        except ValueError as error:
            if not both or str(error) != QUOTA:
                raise
            order = mmr(*options)
        out = group.iloc[order]
        return pd.DataFrame({query: out[query], "strip_id": out["strip_id"], "place": range(1, len(out) + 1)})

    return strips.select(query, "query_vector", "strip_id", "source_type", "vector", "position", "action").groupBy(query).applyInPandas(run, f"{query} {kind}, strip_id string, place int")


def selection_problems(selected: DataFrame, candidates: DataFrame, limit: int, query: str = "query_id") -> DataFrame:
    """What a selector may not do: query, strip_id, problem. Both have query, strip_id, text, source_type, source_ref (others are left alone); candidates are unique by
    query and strip_id.

    too_many: a query has over limit strips (strip_id is null). repeated: a strip is there more than once. unknown: it is no candidate of the query.
    changed: it is one, but not as it was; nulls are compared as values. Strips are told by a hash of all they hold, so no text is joined.
    """
    mark = F.sha2(F.to_json(F.struct("text", "source_type", "source_ref"), {"ignoreNullFields": "false"}), 256)
    own = selected.select(query, "strip_id", mark.alias("mark"))
    had = candidates.select(query, "strip_id", mark.alias("_mark"), F.lit(True).alias("_known"))
    problem = lambda rows, name: rows.select(query, "strip_id", F.lit(name).alias("problem"))
    many = own.groupBy(query).agg(F.count("*").alias("n")).where(F.col("n") > limit).withColumn("strip_id", F.lit(None).cast("string"))
    again = own.groupBy(query, "strip_id").agg(F.count("*").alias("n")).where("n > 1")
    met = own.distinct().join(had, [query, "strip_id"], "left")
    unknown = met.where("_known IS NULL").select(query, "strip_id").distinct()
    changed = met.where("_known AND mark <> _mark").select(query, "strip_id").distinct()
    parts = [problem(many, "too_many"), problem(again, "repeated"), problem(unknown, "unknown"), problem(changed, "changed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def context_line(marker, source_type, source_ref, text):
    """One line of context: a JSON object of four strings, keys in this order, non-ASCII as it is."""
    return F.to_json(F.struct(marker.alias("citation"), source_type.alias("source_type"), source_ref.alias("source_ref"), text.alias("text")), {"ignoreNullFields": "false"})


def within_budget(selected: DataFrame, config: Context = Context(), query: str = "query_id") -> DataFrame:
    """selected: query, place, strip_id, source_type, source_ref, text. The strips that fit the budget of characters, with marker number and line.

    A strip too long for what is left is passed over and later ones are still tried; numbers have no gaps. A fold over a query's strips,
    which are few (max_strips).
    """
    item = F.struct("place", "strip_id", "source_type", "source_ref", "text")
    lists = selected.groupBy(query).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = "array<struct<place:int,strip_id:string,source_type:string,source_ref:string,text:string,number:int,line:string>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast(kept).alias("kept"))

    def step(state, x):
        number = F.size(state["kept"]) + 1
        line = context_line(F.concat(F.lit("["), number.cast("string"), F.lit("]")), x["source_type"], x["source_ref"], x["text"])
        used = state["used"] + F.length(line) + F.when(number > 1, 1).otherwise(0)
        more = F.struct(used.alias("used"), F.concat(state["kept"], F.array(F.struct(x["place"].cast("int").alias("place"), x["strip_id"].alias("strip_id"), x["source_type"].alias("source_type"), x["source_ref"].alias("source_ref"), x["text"].alias("text"), number.alias("number"), line.alias("line"))).cast(kept)).alias("kept"))
        return F.when(used <= config.max_chars, more).otherwise(state)

    folded = lists.select(query, F.aggregate("items", start, step).alias("state"))
    return folded.select(query, F.explode("state.kept").alias("k")).select(query, "k.*")


def contexts(queries: DataFrame, included: DataFrame, query: str = "query_id") -> DataFrame:
    """queries: query, action. query, status, text, markers: no_evidence, partial (Ambiguous with one source only) or ready."""
    rows = included.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("number", "line"))).alias("lines"), F.countDistinct("source_type").alias("sources"))
    status = F.when(F.col("lines").isNull(), NO_EVIDENCE).when((F.col("action") == "Ambiguous") & (F.col("sources") < 2), PARTIAL).otherwise(READY)
    both = queries.select(query, "action").join(rows, query, "left")
    return both.select(query, status.alias("status"), F.coalesce(F.array_join(F.col("lines.line"), "\n"), F.lit("")).alias("text"), F.coalesce(F.size("lines"), F.lit(0)).alias("markers"))


def impure(strips: DataFrame, actions: DataFrame, query: str = "query_id") -> DataFrame:
    """Strips that their branch may not hold, are of no known source, or miss a field. Empty if all is right."""
    both = strips.join(actions.select(query, "action"), query)
    blank = F.lit(False)
    for name in ("strip_id", "text", "source_type", "source_ref"):
        blank = blank | (F.coalesce(F.trim(name), F.lit("")) == "")
    problem = (
        F.when(blank, "blank field")
        .when(~F.col("source_type").isin("internal", "web"), "unknown source")
        .when((F.col("action") == "Correct") & (F.col("source_type") == "web"), "web strip in a Correct branch")
        .when((F.col("action") == "Incorrect") & (F.col("source_type") == "internal"), "internal strip in an Incorrect branch")
    )
    return both.select(query, "strip_id", problem.alias("problem")).where("problem is not null")


def valid_claims(claims: DataFrame, citations: DataFrame, config: Answer = Answer(), query: str = "query_id") -> DataFrame:
    """claims: query, claim_no, text, refs (markers); citations: query, marker. Claims with problem: null, or why the answer must be refused."""
    known = citations.groupBy(query).agg(F.collect_set("marker").alias("known"))
    both = claims.join(known, query, "left").withColumn("text", nfc(F.trim("text")))
    refs = F.coalesce(F.col("refs"), F.array().cast("array<string>"))
    problem = (
        F.when(F.coalesce(F.col("text"), F.lit("")) == "", "blank")
        .when(F.length("text") > config.max_claim_chars, "long")
        .when(F.col("text").contains("\n") | F.col("text").rlike(r"\[\d+\]"), "line end or marker")
        .when(F.size(refs) == 0, "no citation")
        .when(F.size(F.array_distinct(refs)) < F.size(refs), "repeated citation")
        .when(F.size(F.array_except(refs, F.coalesce("known", F.array().cast("array<string>")))) > 0, "unknown citation")
        .when(F.count("*").over(Window.partitionBy(query)) > config.max_claims, "too many claims")
    )
    return both.withColumn("problem", problem).drop("known")


def unsupported(claims: DataFrame, evidence: DataFrame, query: str = "query_id") -> DataFrame:
    """query, claim_no of claims that turn round a negation of a strip they cite. evidence: query, marker, text."""
    cited = claims.select(query, "claim_no", F.col("text").alias("claim"), F.explode("refs").alias("marker")).join(evidence.select(query, "marker", F.col("text").alias("source")), [query, "marker"])
    return cited.where(reverses_negation(F.col("claim"), F.col("source"))).select(query, "claim_no").distinct()


def retry_reason(claims: DataFrame, contexts_: DataFrame, evidence: DataFrame, query: str = "query_id") -> DataFrame:
    """query, retry: why a first answer is asked for again (null: it is not). Corrupted text before turned negations before none from a ready context."""
    bad = claims.groupBy(query).agg(F.bool_or(corrupted(F.col("text"))).alias("corrupt"), F.count("*").alias("n"))
    turned = unsupported(claims, evidence, query).select(query).distinct().withColumn("turned", F.lit(True))
    both = contexts_.select(query, "status").join(bad, query, "left").join(turned, query, "left")
    why = F.when(F.col("corrupt"), CORRUPTED).when(F.col("turned"), POLARITY).when(F.col("n").isNull() & (F.col("status") == READY), NOTHING)
    return both.select(query, why.alias("retry"))


def _in_order(markers: Column) -> Column:
    """Markers by their number, which is the order of the context."""
    number = lambda m: F.coalesce(F.regexp_extract(m, r"(\d+)", 1).try_cast("int"), F.lit(0))
    return F.transform(F.array_sort(F.transform(markers, lambda m: F.struct(number(m).alias("n"), m.alias("m")))), lambda x: x["m"])


def conflicts(responses: DataFrame, claims: DataFrame, query: str = "query_id") -> DataFrame:
    """responses: query, answerable. Queries whose response says it has an answer and brings no claims, or the other way round."""
    n = claims.groupBy(query).agg(F.count("*").alias("_n"))
    both = responses.join(n, query, "left")
    return both.where(F.col("answerable").isNull() | (F.col("answerable") != (F.coalesce("_n", F.lit(0)) > 0))).select(query)


def answer_rounds(contexts_: DataFrame, first: DataFrame, second: DataFrame, evidence: DataFrame, notice: str = PARTIAL_NOTICE, query: str = "query_id") -> DataFrame:
    """answers() after at most two attempts, with attempts, retry (why there was a second) and problem.

    first, second: claims of the two attempts (query, claim_no, text, refs); second counts only for queries that retry_reason() asks again. A second
    attempt that is corrupted still is an error: its problem is "corrupted_unicode" and its text is empty. Refusals have their fixed texts.
    """
    why = retry_reason(first, contexts_, evidence, query).where(F.col("retry").isNotNull())
    asked = contexts_.where(F.col("status") != NO_EVIDENCE).select(query)
    why = why.join(asked, query, "left_semi")
    used = first.join(why.select(query), query, "left_anti").unionByName(second.join(why.select(query), query, "left_semi").select(*first.columns))
    bad = second.join(why.select(query), query, "left_semi").groupBy(query).agg(F.bool_or(corrupted(F.col("text"))).alias("_bad"))
    out = answers(contexts_, used, evidence, notice, query).join(why, query, "left").join(bad, query, "left")
    wrong = F.coalesce("_bad", F.lit(False))
    text = F.when(wrong, F.lit("")).when(F.col("status") == ABSTAINED, F.lit(ABSTAINED_TEXT)).when(F.col("status") == INSUFFICIENT, F.lit(NO_ANSWER_TEXT)).otherwise(F.col("text"))
    return out.select(query, "status", text.alias("text"), "used", F.when(F.col("retry").isNull(), 1).otherwise(2).alias("attempts"), "retry", F.when(wrong, F.lit(CORRUPTED)).alias("problem"))


def answers(contexts_: DataFrame, claims: DataFrame, evidence: DataFrame, notice: str = PARTIAL_NOTICE, query: str = "query_id") -> DataFrame:
    """query, status, text, used: claims that no cited strip contradicts, a line each with its markers; partial contexts begin with a notice."""
    good = claims.join(unsupported(claims, evidence, query), [query, "claim_no"], "left_anti")
    line = F.concat_ws(" ", "text", F.array_join("refs", " "))
    rows = good.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("claim_no", line.alias("line")))).alias("lines"), _in_order(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("used"))
    both = contexts_.select(query, "status").join(rows, query, "left")
    status = (
        F.when(F.col("status") == NO_EVIDENCE, INSUFFICIENT)
        .when(F.col("lines").isNull() & (F.col("status") == READY), ABSTAINED)
        .when(F.col("lines").isNull(), INSUFFICIENT)
        .when(F.col("status") == PARTIAL, PARTIAL)
        .otherwise(ANSWERED)
    )
    text = F.array_join(F.col("lines.line"), "\n")
    given = F.col("lines").isNotNull() & (F.col("status") != NO_EVIDENCE)
    text = F.when(given & (F.col("status") == PARTIAL), F.concat(F.lit(notice + "\n"), text)).when(given, text).otherwise("")
    return both.select(query, status.alias("status"), text.alias("text"), F.when(given, F.col("used")).otherwise(F.array().cast("array<string>")).alias("used"))
