"""The driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = {"documents", "pages"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt out to all of them, as a file may be one task's only."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if table in TEXTS and len(rows.inputFiles()) < cores else rows


def dealt(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """rows dealt out by a key, to as many tasks as there are texts of `size` bytes in all: a task's memory does not grow with the table."""
    held = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-held // size)), key)
