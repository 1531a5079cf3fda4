"""Raw copies, processed artifacts, uploads and runs as tables of an artifact store.

Raw bytes are kept by document and content hash, and stay when the document is replaced, so that what an older answer cites can still be opened;
processed artifacts by document and a digest of all they hold. Both are Parquet, appended, and read without what has been deleted.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Ingestion
from ..sources.files import default_registry
from .payloads import artifact_faults

DOCUMENT_ID, UPLOAD_FOLDER = "^[0-9a-f]{24}$", "^[0-9a-f]{32}$"


def valid_upload(name: Column, size: Column, config: Ingestion = Ingestion(), extensions: list[str] | None = None) -> Column:
    """A plain file name of 1 to 180 characters that any system can store, of a known extension, with content of an allowed size."""
    known = F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1))).isin(extensions or default_registry().extensions())
    plain = F.length(name).between(1, 180) & ~name.rlike(r'[/\\:*?"<>|\x00-\x1f]') & ~name.rlike(r"[ .]$") & name.contains(".") & ~name.rlike(r"^\.[^.]*$")
    return F.coalesce(plain & known & (size > 0) & (size <= config.max_file_bytes), F.lit(False))


def managed_upload(path: Column, document_id: Column, root: str) -> Column:
    """The file lies in a folder of its own, named by 32 hex digits, right below the upload root, and is the document's source."""
    rest = F.substring(path, len(root.rstrip("/")) + 2, 10_000)
    parts = F.split(rest, "/")
    return F.coalesce(path.startswith(root.rstrip("/") + "/") & (F.size(parts) == 2) & parts[0].rlike(UPLOAD_FOLDER) & (F.substring(F.sha2(path, 256), 1, 24) == document_id), F.lit(False))


def presented(listing: DataFrame, states: DataFrame, upload_root: str) -> DataFrame:
    """A document list with managed_upload and index_status."""
    return listing.join(states.withColumnRenamed("status", "index_status"), "document_id", "left").withColumn("managed_upload", managed_upload(F.col("source_path"), F.col("document_id"), upload_root))


def artifact(parsed: DataFrame, chunks: DataFrame, signature: str) -> DataFrame:
    """document_id, revision, content_hash, pipeline_signature, n_chunks, payload (JSON, schema version 1) of parsed files and their chunks."""
    item = F.struct("ordinal", "chunk_id", "text", "char_count", "pages", "heading_path", "kinds", "has_overlap", "source_metadata", "source_spans")
    own = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    both = parsed.join(own, "document_id")
    payload = F.to_json(F.struct(F.lit(1).alias("schema_version"), "document_id", "source_path", "media_type", "content_hash", F.lit(signature).alias("pipeline_signature"), "metadata", "warnings", "blocks", "chunks"))
    return both.select("document_id", "content_hash", F.lit(signature).alias("pipeline_signature"), F.size("chunks").alias("n_chunks"), payload.alias("payload")).withColumn("revision", F.sha2("payload", 256))


class ArtifactStore:
    """Raw and processed artifacts below a folder; each write is an append of whole Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/{name}") if self._fs.exists(self._path(f"{self.folder}/{name}")) else None

    def _append(self, rows: DataFrame, name: str, key: list[str]) -> None:
        held = self._live(name)
        new = rows.dropDuplicates(key).withColumn("stored_at", F.lit(time.time_ns()))
        (new.join(held.select(*key).distinct(), key, "left_anti") if held is not None else new).write.mode("append").parquet(f"{self.folder}/{name}")

    def store_raw(self, files: DataFrame) -> None:
        """files: document_id, path, content. What is there under the same hash is not written again."""
        rows = files.select("document_id", F.sha2("content", 256).alias("content_hash"), F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1))).alias("extension"), "content")
        self._append(rows, "raw", ["document_id", "content_hash"])

    def store_processed(self, artifacts: DataFrame) -> None:
        self._append(artifacts, "processed", ["document_id", "revision"])

    def store_images(self, parsed: DataFrame) -> None:
        """parsed: document_id, assets (sha256, content) as sources.files gives them. An image that several pages of a document show is written once."""
        rows = parsed.select("document_id", F.explode("assets").alias("a")).select("document_id", "a.sha256", "a.content")
        self._append(rows, "images", ["document_id", "sha256"])

    def delete(self, document_ids: list[str]) -> None:
        """Forget what is stored of documents until now: their ids go to a table of deletions; what is stored later is seen again. Source files are never touched."""
        if any(len(x) != 24 or set(x) - set("0123456789abcdef") for x in document_ids):
            raise ValueError("not a document id")
        rows = [(x, time.time_ns()) for x in document_ids]
        self.spark.createDataFrame(rows, "document_id string, deleted_at long").write.mode("append").parquet(f"{self.folder}/deleted")

    def _live(self, name: str) -> DataFrame | None:
        rows, gone = self._table(name), self._table("deleted")
        if rows is None or gone is None:
            return rows
        last = gone.groupBy("document_id").agg(F.max("deleted_at").alias("deleted_at"))
        return rows.join(last, "document_id", "left").where(F.col("deleted_at").isNull() | (F.col("stored_at") > F.col("deleted_at"))).drop("deleted_at")

    def raw(self) -> DataFrame | None:
        """document_id, content_hash, extension, content, sha256 (of the content as it now is)."""
        rows = self._live("raw")
        return rows.withColumn("sha256", F.sha2("content", 256)) if rows is not None else None

    def processed(self) -> DataFrame | None:
        return self._live("processed")

    def images(self) -> DataFrame | None:
        """document_id, sha256 (as stored), content."""
        return self._live("images")

    def faults(self, listing: DataFrame) -> DataFrame:
        """What is wrong with the processed artifacts of a listing (document_id, source_path, media_type, content_hash, pipeline_signature, chunk_count) that are now
        in force, by payloads.artifact_faults(). Artifacts of other contents or signatures are older ones, and stay.
        """
        images = self.images()
        none = self.spark.createDataFrame([], "document_id string, sha256 string, content binary")
        processed = self.processed()
        if processed is None:
            processed = self.spark.createDataFrame([], "document_id string, content_hash string, pipeline_signature string, payload string")
        now = processed.join(listing.select("document_id", "content_hash", "pipeline_signature"), ["document_id", "content_hash", "pipeline_signature"], "left_semi")
        return artifact_faults(listing, now, images if images is not None else none)

    def source_file(self, document_id: str, content_hash: str) -> bytes:
        """The bytes that a citation points to, checked against their hash."""
        rows = self.raw()
        found = rows.where((F.col("document_id") == document_id) & (F.col("content_hash") == content_hash)).limit(1).collect() if rows is not None else []
        if not found:
            raise FileNotFoundError("the stored copy is missing")
        if found[0]["sha256"] != content_hash:
            raise ValueError("the stored copy is not what was stored")
        return bytes(found[0]["content"])


class UploadStore:
    """Uploaded files, each in a folder of its own right below the root, so that managed_upload() knows them. write() is for one file as it arrives."""

    def __init__(self, spark: SparkSession, root: str, config: Ingestion = Ingestion()):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _checked(self, name: str, content: bytes) -> None:
        row = self.spark.range(1).select(valid_upload(F.lit(name), F.lit(len(content)), self.config).alias("ok")).first()
        if not row["ok"]:
            raise ValueError("the upload's name, type or size is not allowed")

    def _put(self, path: str, content: bytes) -> None:
        """Whole or not at all: written beside its place, then renamed."""
        part = f"{path}.{uuid.uuid4().hex}.part"
        out = self._fs.create(self._path(part), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        self._fs.delete(self._path(path), False)
        if not self._fs.rename(self._path(part), self._path(path)):
            self._fs.delete(self._path(part), False)
            raise OSError("the upload could not be put in its place")

    def write(self, name: str, content: bytes) -> str:
        """The path of a new upload."""
        self._checked(name, content)
        path = f"{self.root}/{uuid.uuid4().hex}/{name}"
        self._fs.mkdirs(self._path(path).getParent())
        self._put(path, content)
        return path

    def _managed(self, path: str) -> None:
        rest = path.removeprefix(self.root + "/").split("/")
        if not path.startswith(self.root + "/") or len(rest) != 2 or not re.fullmatch(UPLOAD_FOLDER, rest[0]) or not self._fs.exists(self._path(path)):
            raise ValueError("not an upload of this store")

    def replace(self, path: str, content: bytes) -> None:
        """New content for an upload; its name and document id stay. The old content stays if the new one is not allowed."""
        self._managed(path)
        self._checked(path.rpartition("/")[2], content)
        self._put(path, content)

    def delete(self, path: str) -> None:
        """Remove an upload with its folder. Files outside the store are never touched."""
        self._managed(path)
        self._fs.delete(self._path(path).getParent(), True)


def run_rows(questions: DataFrame, actions: DataFrame, contexts: DataFrame, answers: DataFrame, run: str, query: str = "query_id") -> DataFrame:
    """One row per question of a run, complete or not: run_id, question, action, context status, answer status and text, answer_pending."""
    rows = questions.select(query, F.col("text").alias("question")).join(actions.select(query, "action"), query, "left")
    rows = rows.join(contexts.select(query, F.col("status").alias("context_status"), F.col("text").alias("context")), query, "left")
    rows = rows.join(answers.select(query, F.col("status").alias("answer_status"), F.col("text").alias("answer"), "used"), query, "left")
    return rows.withColumn("answer_pending", F.col("answer_status").isNull()).withColumn("run_id", F.concat_ws("-", F.lit(run), F.col(query).cast("string")))


def finished_runs(runs: DataFrame) -> DataFrame:
    """Runs that may be read back: the last row of each run_id, without those that have no answer yet."""
    order = Window.partitionBy("run_id").orderBy(F.col("answer_pending"))
    return runs.withColumn("_r", F.row_number().over(order)).where((F.col("_r") == 1) & ~F.col("answer_pending")).drop("_r")


def run_summary(runs: DataFrame, citations: DataFrame, query: str = "query_id") -> DataFrame:
    """run_id, branch, status, answer and the citations used (all of the context where the model abstained), each with its text and a link to its source."""
    number = F.col("number").cast("string")
    link = F.when(F.col("source_type") == "web", F.when(F.col("source_ref").rlike("^https?://"), F.col("source_ref"))).otherwise(F.concat(F.lit("/api/runs/"), "run_id", F.lit("/citations/"), number, F.lit("/source")))
    both = runs.join(citations, query).where((F.col("answer_status") == "model_abstained") | F.array_contains("used", F.concat(F.lit("["), number, F.lit("]"))))
    own = both.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("number", "strip_id", "source_type", "source_ref", "text", link.alias("viewer_url")))).alias("citations"))
    return runs.select("run_id", F.col("action").alias("branch"), F.col("context_status").alias("status"), "answer").join(own, "run_id", "left")
