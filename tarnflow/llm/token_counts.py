"""Documents of flat, unindexed token files, counted by their end-of-document identifiers.

A file is a run of unsigned little-endian ids, nothing else. Blocks of a file are scanned apart: a vectorised search finds the end identifiers in
each. A prefix scan over the blocks then gives each block the ordinal of its first document and the tokens that earlier
blocks hold of it. The scan has two levels (blocks within a run of SPAN blocks, runs within a file), so no task gets more than a run's rows.

Tokens after the last end identifier are a document if there are any. An empty file has no documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed, new_path, remove, short_batches, written
from .files import fresh, make_dir, opened
from .tokens import encoder

BLOCK_TOKENS = 2_000_000
SPAN = 1024
FILE_BYTES = 128_000_000


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int, kind: str = "<u2") -> DataFrame:
    """Write flat token files below folder. Returns file, n_bytes, ordinals and doc_ids of the documents in each, as a table already made."""
    schema = pa.schema([("file", pa.string()), ("n_bytes", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        out, name, size, ids = None, "", 0, []

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"file": name, "n_bytes": size, "doc_ids": ids}], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    make_dir(folder)
                    name, size, ids = fresh(folder, ".tok"), 0, []
                    fs, path = opened(name)
                    out = fs.open_output_stream(path, compression=None, buffer_size=1 << 20)
                own = encode(text.as_py() or "", special=False)
                if max(end, int(own.max(initial=0))) > np.iinfo(kind).max or (own == end).any():
                    raise ValueError("an id does not fit the file's type, or a text holds the end identifier")
                got = np.append(own, np.uint32(end)).astype(kind)
                out.write(got.tobytes())
                size += got.nbytes
                ids.append(doc_id)
                if size >= FILE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, n_bytes long, doc_ids array<long>"), "token-files")


def _scan(end: int, kind: str, block: int):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ends", pa.int64()), ("tail", pa.int64()), ("lengths", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(kind).itemsize
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = opened(row["file"])
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(block * width, row["block"] * block * width), kind)
                at = np.flatnonzero(ids == end)
                # Tokens before the first end, then between ends; what follows the last one is the tail.
                lengths = np.diff(at, prepend=-1) - 1
                tail = len(ids) - (int(at[-1]) + 1 if len(at) else 0)
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "block": row["block"], "ends": len(at), "tail": tail, "lengths": lengths.tolist()}], schema=schema)

    return run


def count_tokens(files: DataFrame, end: int, kind: str = "<u2", block: int = BLOCK_TOKENS) -> DataFrame:
    """files: file string, n_bytes long. A row per document: file, ordinal long (from 0 in its file), n_tokens long (without the end identifier)."""
    width = np.dtype(kind).itemsize
    blocks = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_bytes") / (width * block)) - 1)).alias("block"), "n_bytes").where("n_bytes > 0")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.select("file", "block").repartition(parts, "file", "block").mapInArrow(_scan(end, kind, block), "file string, block long, ends long, tail long, lengths array<long>")
    found = written(found, "scanned")
    # A block passes on the ends so far and the tokens since the last end: (e1, t1) then (e2, t2) is (e1 + e2, t2 if e2 else t1 + t2).
    brief = found.select("file", "block", "ends", "tail", F.floor(F.col("block") / SPAN).alias("run"))
    in_run = _carried(brief, ["file", "run"], "block")
    runs = brief.groupBy("file", "run").agg(F.sum("ends").alias("ends"), F.max(F.when(F.col("ends") > 0, F.col("block"))).alias("last"), F.collect_list(F.struct("block", "tail")).alias("tails"))
    runs = runs.withColumn("tail", F.aggregate(F.filter("tails", lambda x: x["block"] >= F.coalesce(F.col("last"), F.lit(-1))), F.lit(0).cast("long"), lambda s, x: s + x["tail"]))
    runs = _carried(runs.select("file", "run", "ends", "tail"), ["file"], "run")
    runs = runs.select("file", "run", F.col("base").alias("run_base"), F.col("carry").alias("run_carry"))
    placed = in_run.join(runs, ["file", "run"]).select(
        "file",
        "block",
        (F.col("base") + F.col("run_base")).alias("base"),
        (F.col("carry") + F.when(F.col("base") > 0, 0).otherwise(F.col("run_carry"))).alias("carry"),
        "ends",
        "tail",
    )
    # Tables of arrays are small as files and large as rows: never a broadcast by the size of the file.
    whole = found.select("file", "block", "lengths").join(placed.select("file", "block", "base", "carry").hint("merge"), ["file", "block"])
    inner = whole.select("file", "base", "carry", F.posexplode("lengths").alias("i", "length"))
    inner = inner.select("file", (F.col("base") + F.col("i")).alias("ordinal"), (F.col("length") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
    last = placed.groupBy("file").agg(F.max(F.struct("block", (F.col("base") + F.col("ends")).alias("ordinal"), (F.col("tail") + F.when(F.col("ends") > 0, 0).otherwise(F.col("carry"))).alias("n_tokens"))).alias("m"))
    last = last.select("file", "m.ordinal", "m.n_tokens").where("n_tokens > 0")
    return inner.unionByName(last)


def _carried(rows: DataFrame, by: list, order: str) -> DataFrame:
    """base: ends in earlier rows of the partition; carry: tokens in them after the last end."""
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.withColumn("base", F.coalesce(F.sum("ends").over(earlier), F.lit(0))).withColumn("upto", F.coalesce(F.sum("tail").over(earlier), F.lit(0)))
    # Tails before the last row with an end are of finished documents.
    sums = sums.withColumn("done", F.max(F.when(F.col("ends") > 0, F.col("upto"))).over(earlier))
    return sums.withColumn("carry", F.col("upto") - F.coalesce("done", F.lit(0))).drop("upto", "done")


def document_tokens(docs: DataFrame, tokenizer: str, end: int = 50256, kind: str = "<u2", waves: int = 2) -> DataFrame:
    """doc_id, n_tokens of each document: written to flat token files, which are then scanned. A null text is empty and has no tokens.

    A row per row: rows that repeat a doc_id, or have none, are documents of their own. Ids that do not fit `kind`, and an end identifier that
    a text itself has, are errors. Files are written, scanned and removed wave by wave, which bounds the disk they take to a share of the corpus.
    """
    spark: SparkSession = docs.sparkSession
    short_batches(spark)
    out = None
    for wave in range(waves):
        folder = new_path(spark, "tokens")
        own = keyed(docs).where(F.pmod("k1", F.lit(waves)) == wave).select("doc_id", "text")
        files = write_token_files(own, folder, tokenizer, end, kind)
        names = files.select("file", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
        counted = count_tokens(files.select("file", "n_bytes"), end, kind)
        got = written(counted.join(names.withColumn("ordinal", F.col("ordinal").cast("long")).hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens"), "token-counts")
        remove(spark, folder)
        out = got if out is None else out.unionByName(got)
    return out
