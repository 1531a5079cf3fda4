"""The whole question-answering plan as one dataflow over many questions: retrieve, judge, route, refine, search pages, select, assemble.

Branches are filters on each question's action, not control flow, so all questions of all branches run in the same jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Context, Refinement, WebSearch
from ..functions import models
from ..functions.embedding import dense, embedder, postings
from ..functions.text import overlap
from ..lineage import cut
from ..operators import evidence, provenance, retrieval, web
from ..operators.chunking import strips


def by_overlap(query_text: Column, text: Column) -> Column:
    """A stand-in judge: relevant from three shared terms, irrelevant without any."""
    n = overlap(query_text, text)
    return F.when(n >= 3, "relevant").when(n == 0, "irrelevant").otherwise("uncertain")


#: Columns of internal strips and citations where the index has source_spans; null for web strips.
PROVENANCE = ["pages", "heading_path", "heading_paths", "has_overlap"]


def searched_pages(
    questions: DataFrame,
    rewriter: Callable[[str, int], str],
    provider: Callable[[str, int], list[dict]],
    fetch: Callable[[str, int], models.Response],
    resolve: Callable[[str], list[str]],
    config: WebSearch = WebSearch(),
    attempts: int = 3,
    backoff: float = 0.5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """questions: query_id, text. What a corrective plan needs of the web: (pages, web_hits, report), by a rewriter, a search provider and a fetcher.

    Each query's hits are its first public addresses; an address is fetched once for all questions, and a page goes by the address that it came from after
    redirects. report: query_id, url, error (null where there is a page). Providers and pages are asked once: results are kept in the shared folder.
    """
    found = cut(models.search_loop(questions, rewriter, provider, config.max_queries, config.results_per_query, attempts, backoff))
    hits = found.select("query_id", F.col("number").alias("search_no"), F.explode("hits").alias("h"))
    wanted = web.eligible(hits.select("query_id", "search_no", F.col("h.rank").alias("search_rank"), F.col("h.url").alias("url")), config)
    allowed = partial(web.public_url, allowed=config.allowed_domains)
    got = cut(models.fetched(wanted.select("url").distinct(), fetch, resolve, allowed, config.max_page_bytes, config.max_page_chars))
    read = got.where("error IS NULL")
    pages = read.groupBy(F.col("final_url").alias("url")).agg(F.min_by(F.struct("text", "content_sha256", "truncated"), "url").alias("p")).select("url", "p.*")
    own = wanted.join(read.select("url", "final_url"), "url").select("query_id", "search_no", "search_rank", F.col("final_url").alias("url"))
    return pages, own, wanted.select("query_id", "url").join(got.select("url", "error"), "url")


@dataclass
class Corrective:
    """index: chunk_id, text, vector, and source_spans if strips are to say where they come from (PROVENANCE); lexical: chunk_id, lexical (if it
    is the index itself, both searches are one pass over it); pages: web.fetched(); web_hits: query_id, search_no, search_rank, url."""

    index: DataFrame
    lexical: DataFrame
    pages: DataFrame | None = None
    web_hits: DataFrame | None = None
    judge: Callable[[Column, Column], Column] = by_overlap
    rerank_score: Column | None = None
    rrf_k: int = 2
    dimensions: int = 64

    def retrieve(self, queries: DataFrame, candidates: int = 30) -> DataFrame:
        """queries: query_id, text. query_id, chunk_id, score, rank by fused dense and sparse search; blank questions find nothing."""
        asked = queries.where(F.trim("text") != "")
        posts = cut(postings(asked, "query_id"))
        vectors = dense(posts, "query_id", self.dimensions).withColumnRenamed("dense", "vector")
        n = retrieval.prefetch(candidates)
        if self.lexical is self.index:
            lists = [retrieval.hybrid_top(vectors, posts, self.index, n)]
        else:
            lists = [retrieval.dense_top(vectors, self.index, n), retrieval.sparse_top(posts, self.lexical, n)]
        return retrieval.fuse(lists, candidates, self.rrf_k)

    def evaluate(self, queries: DataFrame, candidates: int = 30, limit: int = 10) -> tuple[DataFrame, DataFrame]:
        """Judged hits (after reranking) and actions."""
        if not 0 < limit <= candidates:
            raise ValueError("the evaluation limit is from 1 to the candidate limit")
        hits = self.retrieve(queries, candidates).join(self.index.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
        judged = retrieval.rerank(hits, limit, self.rerank_score).withColumn("relevance", self.judge(F.col("query_text"), F.col("text")))
        return judged, retrieval.route(queries, judged)

    def strips(self, judged: DataFrame, actions: DataFrame, config: Refinement = Refinement()) -> DataFrame:
        """Relevant strips of the chunks that the action allows."""
        chosen = retrieval.parents(judged, actions)
        parts = strips(chosen.select("chunk_id", "text").dropDuplicates(["chunk_id"]), "chunk_id", "text", config)
        if "source_spans" in self.index.columns:
            own = self.index.select("chunk_id", "source_spans").join(parts.select("chunk_id").distinct(), "chunk_id", "left_semi")
            parts = provenance.strip_provenance(parts, own).drop("source_spans")
        both = chosen.select("query_id", "query_text", "chunk_id", "retrieval_score", "rerank_score", "rank").join(parts, "chunk_id")
        both = both.where(self.judge(F.col("query_text"), F.col("strip")) == "relevant")
        strip_id = F.concat(F.col("chunk_id").cast("string"), F.lit(":strip:"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
        return both.select("query_id", strip_id.alias("strip_id"), F.col("strip").alias("text"), F.lit("internal").alias("source_type"), F.col("chunk_id").cast("string").alias("source_ref"), "rank", "start", *(c for c in PROVENANCE if c in both.columns))

    def web(self, queries: DataFrame, actions: DataFrame, config: WebSearch = WebSearch()) -> DataFrame:
        """Relevant passages of pages for questions whose action is not Correct."""
        wanted = actions.where("action <> 'Correct'").select("query_id")
        hits = web.eligible(self.web_hits.join(wanted, "query_id", "left_semi"), config).join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
        found = web.passages(hits, self.pages, config).withColumn("relevance", self.judge(F.col("query_text"), F.col("passage")))
        best = web.web_strips(found, config)
        return best.select("query_id", "strip_id", F.col("passage").alias("text"), F.lit("web").alias("source_type"), F.col("url").alias("source_ref"), F.col("position").alias("rank"), "start")

    def assemble(self, queries: DataFrame, candidates: int = 30, limit: int = 10, config: Context = Context()) -> tuple[DataFrame, DataFrame]:
        """Contexts (query_id, status, text, markers) and their citations (query_id, number, strip_id, source_type, source_ref, text, line)."""
        judged = cut(self.evaluate(queries, candidates, limit)[0])
        actions = retrieval.route(queries, judged)
        every = self.strips(judged, actions)
        if self.web_hits is not None:
            every = every.unionByName(self.web(queries, actions), allowMissingColumns=True)
        order = Window.partitionBy("query_id").orderBy("source_type", "rank", "start")
        # Read three times below; without a table of their own, documents and pages would be searched and cut for each.
        every = cut(every.withColumn("position", F.row_number().over(order)))
        own = every.withColumn("vector", embedder(self.dimensions)(F.col("text"))["dense"])
        asked = dense(postings(queries, "query_id"), "query_id", self.dimensions).withColumnRenamed("dense", "query_vector")
        ready = own.join(asked, "query_id").join(actions.select("query_id", "action"), "query_id")
        chosen = evidence.select_diverse(ready, config).join(every.select("query_id", "strip_id", "source_type", "source_ref", "text"), ["query_id", "strip_id"])
        kept = evidence.within_budget(chosen, config)
        if carried := [c for c in PROVENANCE if c in every.columns]:
            kept = kept.join(every.select("query_id", "strip_id", *carried), ["query_id", "strip_id"])
        return evidence.contexts(actions, kept), kept
