"""Connected components by alternating large-star and small-star, as joins of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: u, v long (any order, loops and repeats allowed). Returns node, label for each node with an edge: label is its component's
    smallest node. Rounds end when edges no longer change, after O(log n) of them as a rule.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        new = written(_small(_large(now)), "edges")
        got = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop(now)
        now = new
        if (got["n"], got["h"]) == mark:
            break
        mark = (got["n"], got["h"])
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return out.union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
