"""Ingestion as a stream: new files of a folder are parsed, cleaned, chunked, embedded and put into the index, batch by batch.

Each batch goes through the same functions as a whole folder does, and replaces documents by id, so a batch that runs twice after a failure leaves
the same index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Ingestion
from ..functions.embedding import embedder
from ..lineage import cut
from ..operators import artifacts, blocks, chunking, index
from ..sources import files


def _rows(parsed: DataFrame, chunks: DataFrame, config: Ingestion, signature: str) -> DataFrame:
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    rows = chunks.withColumn("_e", embedder(config.dimensions)(F.col("text"))).select(*chunks.columns, "_e.dense", "_e.lexical").join(counts, "document_id")
    return rows.join(parsed.select("document_id", "source_path", "content_hash"), "document_id").withColumn("pipeline_signature", F.lit(signature))


def _parsed(found: DataFrame, config: Ingestion, registry: files.Registry | None) -> tuple[DataFrame, DataFrame, str]:
    """Files that could be read, their chunks, and the signature of what made them."""
    kept, _ = files.guarded(found, config)
    parsed = files.parse(kept, registry, config).where("error is null")
    chunks = chunking.chunks(blocks.cleaned(files.blocks_of(parsed), config.cleaning), config.chunking)
    return parsed, chunks, config.signature((registry or files.default_registry(config)).signatures())


def index_rows(found: DataFrame, config: Ingestion = Ingestion(), registry: files.Registry | None = None) -> DataFrame:
    """Index rows of files (path, length, content). A file without chunks has none."""
    parsed, chunks, signature = _parsed(found, config, registry)
    return _rows(parsed, chunks, config, signature)


def put(found: DataFrame, store: index.IndexStore, config: Ingestion, keep: artifacts.ArtifactStore | None = None) -> DataFrame:
    """Files into the index; before that their raw copies and processed artifacts into the artifact store, so what is indexed can always be opened. Files are
    read and parsed once. A document of which any chunk has no token to search for is refused whole. Returns source_path, why of those that could not be."""
    kept, rejects = files.guarded(found, config)
    registry = files.default_registry(config)
    every = files.parse(kept, registry, config).persist()
    parsed = every.where("error is null")
    chunks = chunking.chunks(blocks.cleaned(files.blocks_of(parsed), config.cleaning), config.chunking).persist()
    signature = config.signature(registry.signatures())
    embedded = _rows(parsed, chunks, config, signature).persist()
    bare = index.without_tokens(embedded)
    rows = embedded.join(bare, "document_id", "left_anti")
    try:
        if not rows.isEmpty():
            if keep is not None:
                own = found.withColumn("document_id", index.document_id(F.col("path"))).join(rows.select("document_id"), "document_id", "left_semi")
                keep.store_raw(own)
                keep.store_processed(artifacts.artifact(parsed, chunks.join(bare, "document_id", "left_anti"), signature))
                keep.store_images(parsed.join(rows.select("document_id"), "document_id", "left_semi"))
            store.replace(rows, config.dimensions)
        without = parsed.join(chunks.select("document_id"), "document_id", "left_anti").select("source_path", F.lit("no text").alias("why"))
        wordless = parsed.join(bare, "document_id", "left_semi").select("source_path", F.lit("no tokens").alias("why"))
        errors = every.where("error is not null").select("source_path", F.col("error").alias("why")).unionByName(without).unionByName(wordless)
        return cut(errors.unionByName(rejects.select(F.col("path").alias("source_path"), F.col("reason").alias("why"))))
    finally:
        for table in (embedded, chunks, every):
            table.unpersist()


def ingest(spark: SparkSession, folder: str, store: index.IndexStore, config: Ingestion = Ingestion(), keep: artifacts.ArtifactStore | None = None) -> DataFrame:
    """Put a folder's files that are new or changed into the index. Returns document_id, source_path, status: indexed, skipped, or why it is neither."""
    found = files.discover(spark, folder)
    signature = config.signature(files.default_registry(config).signatures())
    known = store.read()
    named = found.withColumns({"document_id": index.document_id(F.col("path")), "content_hash": F.sha2("content", 256)})
    todo = index.to_ingest(named, index.documents(known, store.pending()), signature) if known is not None else named
    # What is to be done is decided once, and kept in the shared folder: the index changes below.
    wanted = cut(todo.select("document_id"))
    errors = put(named.join(wanted, "document_id", "left_semi"), store, config, keep)
    names = found.select(index.document_id(F.col("path")).alias("document_id"), F.col("path").alias("source_path"))
    done = names.join(wanted.withColumn("_todo", F.lit(True)), "document_id", "left").join(errors, "source_path", "left")
    return done.select("document_id", "source_path", F.coalesce("why", F.when(F.col("_todo"), "indexed").otherwise("skipped")).alias("status"))


def start(spark: SparkSession, folder: str, store: index.IndexStore, checkpoint: str, config: Ingestion = Ingestion(), keep: artifacts.ArtifactStore | None = None) -> StreamingQuery:
    """A stream over a folder; ends once all files there are in (run it again for later ones). A batch writes its own documents."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return source.writeStream.foreachBatch(lambda batch, number: put(batch, store, config, keep) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
