"""What the operators share: row keys, the cluster's shared folder, tables written there, blocks of documents."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 6_000_000
#: A key with more than one row in so many is hot.
HOT_SHARE = 128
_left: dict[int, list[str]] = {}
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; where it is unset, a temporary one if driver and tasks are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tarnflow-"))
    return _own[0]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; remove_left() and release() remove it."""
    path = f"{shared_dir(spark)}/tarnflow/{name}-{uuid.uuid4().hex}"
    _left.setdefault(id(spark.sparkContext), []).append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of a table from written() that nothing reads any more."""
    spark = df.sparkSession
    for path in _left.get(id(spark.sparkContext), [])[:]:
        if any(f"/{path.rpartition('/')[2]}/" in f for f in df.inputFiles()[:1]):
            remove(spark, path)
            _left[id(spark.sparkContext)].remove(path)


def left(spark: SparkSession) -> list[str]:
    """Places of intermediate tables that are still there."""
    return list(_left.get(id(spark.sparkContext), []))


def remove_left(spark: SparkSession, paths: list[str]) -> None:
    """Remove these intermediate tables. Call it once the results that read them are written."""
    for path in paths:
        if path in _left.get(id(spark.sparkContext), []):
            remove(spark, path)
            _left[id(spark.sparkContext)].remove(path)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application."""
    remove_left(spark, left(spark))


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver's cleaner delete shuffle files of queries that are over."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python, so batches have few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_keys() -> tuple:
    """Two hashes of doc_id and text, which are never null: the keys of a row."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(F.lit(1), doc_id, text), F.xxhash64(F.lit(2), text, doc_id)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), k1, k2. Rows alike share their keys and, being alike, all results by key."""
    a, b = row_keys()
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), a.alias("k1"), b.alias("k2"))


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about block_bytes of text, at least as many as shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))


def joined_by_hot_key(rows: DataFrame, table: DataFrame, key: str, hot_share: int = HOT_SHARE) -> DataFrame:
    """rows left joined with table (one row a key). Keys that hold more than 1 / hot_share of all rows are joined by a broadcast of their table
    rows, of which there are fewer than hot_share; only the others are shuffled, so no task gets a hot key.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    hot = [r[key] for r in counts.where(F.col("n") * hot_share > max(total, hot_share)).select(key).collect()]
    if not hot:
        return rows.join(table, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    own = F.broadcast(table.where(F.col(key).isin(hot)))
    return rows.where(~is_hot).join(table.where(~F.col(key).isin(hot)), key, "left").unionByName(rows.where(is_hot).join(own, key, "left"))


def held_out(modulus: int, remainder: int = 2):
    """crc32(doc_id as text) mod modulus is remainder; a null doc_id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % modulus == remainder
