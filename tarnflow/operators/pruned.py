"""Sparse search over postings in blocks: blocks that cannot hold a query's k best are not read.

Documents fall into blocks of about `span`; of each token and block the largest weight is kept. A query's score in a block is at most the sum of its weights times
these, its bound there. The blocks of the highest bounds are read first; the k-th best score in them is a threshold, and of the other blocks only those whose
bound reaches it are read. All steps are joins on token and block and sums, so nothing is as large as documents times queries. What postings are joined with is a table
of known size first, so Spark broadcasts it where it is small, and no posting moves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import remove, written

SPAN = 32


@dataclass
class PostingBlocks:
    """postings: block, token_id, key, weight, a table in the shared folder, sorted by token in each file."""

    postings: DataFrame
    key: str
    place: str
    scratch: list[str] = field(default_factory=list)

    def table(self, rows: DataFrame, name: str) -> DataFrame:
        """rows as a table that goes with the index."""
        held, place = written(rows, name)
        self.scratch.append(place)
        return held

    def remove(self) -> None:
        """Remove the table and those of its searches. Nothing may be reading them."""
        for place in (self.place, *self.scratch):
            remove(self.postings.sparkSession, place)
        self.scratch.clear()


def posting_blocks(postings: DataFrame, key: str = "chunk_id", span: int = SPAN, documents: int | None = None) -> PostingBlocks:
    """postings: key, token_id, weight (above 0), one row a key and token; rows with a null are left out. Documents are dealt to blocks by a hash of their key, so
    copies and neighbours in number do not fill a block. documents: about how many there are; else they are counted first."""
    rows = postings.where(F.col(key).isNotNull() & F.col("token_id").isNotNull() & (F.col("weight") > 0)).select(key, "token_id", "weight")
    n = documents if documents is not None else rows.agg(F.approx_count_distinct(key)).first()[0]
    blocks = max(1, -(-n // span))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks))).select("block", "token_id", key, "weight")
    held, place = written(dealt.sortWithinPartitions("token_id", "block"), "postings")
    return PostingBlocks(held, key, place)


def pruned_top(queries: DataFrame, index: PostingBlocks, k: int, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """queries: query_id, token_id, weight (above 0). (query_id, key, score, rank: the k best by shared tokens, ties to the smaller key) and a report: query_id,
    blocks (that share a token with the query), read. Documents that share no token are not found; a query without tokens has no rows.

    first: blocks of each query that are read for the threshold; k by default, as the k best lie in k blocks at most. A bound equal to the threshold is read, as a tie may win by its key.
    """
    if k < 1:
        raise ValueError("k is 1 or more")
    first = first or k
    key = index.key
    asked = queries.where("query_id IS NOT NULL AND token_id IS NOT NULL AND weight > 0").select("query_id", "token_id", F.col("weight").alias("_w"))
    asked = index.table(asked, "asked")
    largest = index.postings.join(asked.select("token_id").distinct(), "token_id", "left_semi").groupBy("token_id", "block").agg(F.max("weight").alias("most"))
    bounds = index.table(asked.join(largest, "token_id").groupBy("query_id", "block").agg(F.sum(F.col("_w") * F.col("most")).alias("bound")), "bounds")
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    seeds = index.table(bounds.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= first).select("query_id", "block"), "seeds")

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = index.table(pairs.join(asked, "query_id"), "wanted")
        return index.postings.join(wanted, ["block", "token_id"]).groupBy("query_id", key).agg(F.sum(F.col("_w") * F.col("weight")).alias("score"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    top = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = index.table(top(scored(seeds)), "found")
    reached = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
    # A bound may be off by the order of its sum.
    slack = F.col("_least") * (1 - 1e-9)
    late = bounds.join(seeds, ["query_id", "block"], "left_anti").join(reached, "query_id", "left")
    late = index.table(late.where(F.col("_least").isNull() | (F.col("bound") >= slack)).select("query_id", "block"), "late")
    out = top(found.drop("rank").unionByName(scored(late)))
    read = seeds.unionByName(late).groupBy("query_id").agg(F.count("*").alias("read"))
    report = bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(read, "query_id")
    return out.select("query_id", key, "score", "rank"), report
