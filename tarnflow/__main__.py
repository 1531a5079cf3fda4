"""Command line: ingest, query, evaluate, refine, search-web, run, show-run, list, validate. Results are JSON lines; exit 0, 1 (part failed or invalid), 2 (error)."""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Ingestion
from .operators import artifacts, evidence, index, web
from .plans.corrective import Corrective
from .ship import ship
from .sources import files
from .streaming.ingest import ingest


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnflow")
    p.add_argument("--data", default="data", help="folder of the index, artifacts and runs")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest").add_argument("path")
    for name in ("query", "evaluate", "refine", "search-web", "run"):
        c = sub.add_parser(name)
        c.add_argument("question")
        c.add_argument("--document")
        c.add_argument("--candidates", type=int, default=30)
        c.add_argument("--limit", type=int, default=10 if name != "query" else 5)
        c.add_argument("--pages", help="Parquet table of url, html: what a web search can find")
    sub.add_parser("show-run").add_argument("run")
    sub.add_parser("list")
    sub.add_parser("validate")
    return p


class App:
    def __init__(self, spark: SparkSession, data: str):
        ship(spark)
        self.spark, self.data, self.config = spark, data.rstrip("/"), Ingestion()
        self.store = index.IndexStore(spark, f"{self.data}/index")
        self.artifacts = artifacts.ArtifactStore(spark, f"{self.data}/artifacts")
        self.signature = self.config.signature(files.default_registry().signatures())

    def ingest(self, path: str) -> DataFrame:
        return ingest(self.spark, path, self.store, self.config, self.artifacts)

    def states(self) -> DataFrame:
        """Listing with status, after a look at every source file by the tasks."""
        listing = index.documents(self.read(), self.store.pending())
        return index.status(listing, files.hashes(listing.select("source_path").where("source_path is not null")), self.signature)

    def read(self) -> DataFrame:
        rows = self.store.read()
        if rows is None:
            raise RuntimeError("nothing is indexed yet")
        return rows

    def plan(self, pages: str | None, question: str, document: str | None = None) -> tuple[Corrective, DataFrame]:
        if not question.strip():
            raise ValueError("a question is not blank")
        index.require_current(self.states(), document)
        rows = self.read() if document is None else self.read().where(F.col("document_id") == document)
        rows = rows.select("chunk_id", "text", F.col("dense").alias("vector"), "lexical")
        asked = self.spark.createDataFrame([(0, question.strip())], "query_id int, text string")
        plan = Corrective(rows, rows, dimensions=self.config.dimensions)
        if pages:
            from .functions.embedding import postings
            from .operators.retrieval import sparse_top

            plan.pages = web.fetched(self.spark.read.parquet(pages))
            plan.web_hits = sparse_top(postings(asked, "query_id"), plan.pages, 5, key="url", value="text").select("query_id", "url", F.lit(1).alias("search_no"), F.col("rank").alias("search_rank"))
        return plan, asked

    def run(self, a: argparse.Namespace) -> DataFrame:
        plan, asked = self.plan(a.pages, a.question, a.document)
        _, actions = plan.evaluate(asked, a.candidates, a.limit)
        context, kept = plan.assemble(asked, a.candidates, a.limit)
        # Without a generator every strip is a claim of its own: an extract, not an answer in words of a model.
        marker = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]"))
        claims = kept.select("query_id", F.col("number").alias("claim_no"), F.regexp_replace("text", r"\s+", " ").alias("text"), F.array(marker).alias("refs"))
        answer = evidence.answers(context, claims, kept.select("query_id", marker.alias("marker"), "text"))
        rows = artifacts.run_rows(asked, actions, context, answer, uuid.uuid4().hex)
        rows.write.mode("append").parquet(f"{self.data}/runs")
        return rows


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(args)
    spark = spark or SparkSession.builder.appName("tarnflow").getOrCreate()
    try:
        app = App(spark, a.data)
        failed = False
        if a.command == "ingest":
            out = app.ingest(a.path).collect()
            failed = any(r["status"] not in ("indexed", "skipped") for r in out)
        elif a.command == "list":
            out = index.documents(app.read()).join(app.states(), "document_id").orderBy("document_id").collect()
        elif a.command == "validate":
            out = index.issues(app.read(), app.config.dimensions).collect()
            failed = any(r["severity"] == "error" for r in out)
        elif a.command == "show-run":
            out = artifacts.finished_runs(spark.read.parquet(f"{app.data}/runs")).where(F.col("run_id").startswith(a.run)).collect()
            if not out:
                raise ValueError("the run is incomplete or was not found")
        elif a.command == "run":
            out = app.run(a).collect()
        else:
            plan, asked = app.plan(a.pages, a.question, a.document)
            if a.command == "query":
                out = plan.retrieve(asked, a.limit).join(app.read().select("chunk_id", "text", "source_path"), "chunk_id").orderBy("rank").collect()
            else:
                judged, actions = plan.evaluate(asked, a.candidates, a.limit)
                if a.command == "evaluate":
                    out = judged.join(actions.select("query_id", "action"), "query_id").select("action", "chunk_id", "relevance", "retrieval_score", "rerank_score", "rank").orderBy("rank").collect()
                elif a.command == "refine":
                    out = plan.strips(judged, actions).orderBy("rank", "start").collect()
                else:
                    if plan.web_hits is None:
                        raise ValueError("search-web needs --pages")
                    out = plan.web(asked, actions).orderBy("rank").collect()
        for row in out:
            print(json.dumps(row.asDict(True), ensure_ascii=False, default=str))
        return int(failed)
    except Exception as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
