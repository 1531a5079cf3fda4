"""The index as tables: chunk rows with document columns and vectors, their life cycle, and checks.

An index row has document_id, source_path, content_hash, pipeline_signature, chunk_count, chunk_id, ordinal, text, char_count, dense, lexical.
A replaced document is written as a new version beside the old one; readers see it when a manifest names it.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..lineage import cut

#: Fixed value: columns that all chunk rows of a document must agree on.
DOCUMENT = ["source_path", "content_hash", "pipeline_signature", "chunk_count"]


def document_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 24)


def chunk_id(document: Column, ordinal: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(document, F.lit("\0"), ordinal.cast("string"), F.lit("\0"), text), 256), 1, 32)


def replace(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index after the documents in new take the place of rows with their document_id or source_path."""
    ids, paths = new.select("document_id").distinct(), new.select("source_path").distinct()
    return index.join(ids, "document_id", "left_anti").join(paths, "source_path", "left_anti").select(*index.columns).unionByName(new.select(*index.columns))


def stale(index: DataFrame, new: DataFrame) -> DataFrame:
    """chunk_id of rows that replace() takes away for good."""
    touched = index.join(new.select("document_id").distinct(), "document_id", "left_semi")
    return touched.join(new.select("chunk_id").distinct(), "chunk_id", "left_anti").select("document_id", "chunk_id")


def refused(new: DataFrame, dimensions: int) -> DataFrame:
    """Why documents may not replace what stands: ordinals with gaps or repeats, repeated ids, bad vectors. Empty if they may."""
    dense = F.coalesce((F.size("dense") == dimensions) & F.forall("dense", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("dense", lambda x: x != 0), F.lit(False))
    sparse = F.coalesce(~bad_sparse(F.col("lexical")), F.lit(False)) if "lexical" in new.columns else F.lit(True)
    per = new.groupBy("document_id").agg(
        F.count("*").alias("n"), F.countDistinct("ordinal").alias("ordinals"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.countDistinct("chunk_id").alias("ids"), F.every(dense).alias("dense"), F.every(sparse).alias("sparse")
    )
    problem = F.when((F.col("ordinals") != F.col("n")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1), "ordinals").when(F.col("ids") != F.col("n"), "chunk ids").when(~F.col("dense"), "vectors").when(~F.col("sparse"), "sparse vectors")
    return per.select("document_id", problem.alias("problem")).where("problem is not null")


def without_tokens(rows: DataFrame) -> DataFrame:
    """document_id of documents that have a chunk with nothing to search for: a dense vector that is null or all zero, or no lexical weights."""
    found = F.coalesce(F.exists("dense", lambda x: x != 0), F.lit(False)) & F.coalesce(F.size("lexical") > 0, F.lit(False))
    return rows.where(~found).select("document_id").distinct()


def documents(index: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """A row per document: its columns, n_chunks, ordinal_gap, and index_incomplete: rows missing, ordinals not 0 to n - 1, columns that differ,
    or an update under way (pending: document_id).
    """
    per = index.groupBy("document_id").agg(
        *(F.min(c).alias(c) for c in DOCUMENT),
        F.count("*").alias("n_chunks"),
        F.countDistinct("ordinal").alias("_ordinals"),
        F.min("ordinal").alias("_low"),
        F.max("ordinal").alias("_high"),
        F.countDistinct(F.struct(*DOCUMENT)).alias("_kinds"),
    )
    n = F.col("n_chunks")
    broken = (n != F.col("chunk_count")) | (F.col("_ordinals") != n) | (F.col("_low") != 0) | (F.col("_high") != n - 1) | (F.col("_kinds") != 1)
    gap = (F.col("_ordinals") != n) | (F.col("_low") != 0) | (F.col("_high") != n - 1)
    out = per.withColumn("index_incomplete", F.coalesce(broken, F.lit(True))).withColumn("ordinal_gap", F.coalesce(gap, F.lit(True)))
    if pending is not None:
        marks = pending.select("document_id").distinct().withColumn("_pending", F.lit(True))
        out = out.join(marks, "document_id", "full").withColumn("index_incomplete", F.coalesce("_pending", F.lit(False)) | F.coalesce("index_incomplete", F.lit(True)))
    return out.select("document_id", *DOCUMENT, "n_chunks", "index_incomplete", "ordinal_gap")


def status(listing: DataFrame, sources: DataFrame, signature: str) -> DataFrame:
    """document_id, status: the first that holds of incomplete_update, outdated_pipeline, source_missing, source_changed, current. sources: source_path, content_hash."""
    now = sources.select("source_path", F.col("content_hash").alias("_now"))
    state = (
        F.when(F.col("index_incomplete"), "incomplete_update")
        .when(~F.col("pipeline_signature").eqNullSafe(F.lit(signature)), "outdated_pipeline")
        .when(F.col("_now").isNull(), "source_missing")
        .when(F.col("_now") != F.col("content_hash"), "source_changed")
        .otherwise("current")
    )
    return listing.join(now, "source_path", "left").select("document_id", state.alias("status"))


def require_current(states: DataFrame, document: str | None = None) -> None:
    """Refuse to search an index of which any document (or the one named) is not current; names five of them."""
    wrong = states.where("status <> 'current'")
    if document is not None:
        wrong = wrong.where(F.col("document_id") == document)
    rows = wrong.orderBy("document_id").limit(5).collect()
    if rows:
        raise RuntimeError("index out of date: " + ", ".join(f"{r['document_id']} ({r['status']})" for r in rows))


def to_ingest(files: DataFrame, listing: DataFrame, signature: str) -> DataFrame:
    """files (document_id, content_hash, ...) that are not in the index as they are now, complete, under this signature."""
    held = listing.where(~F.col("index_incomplete") & (F.col("pipeline_signature") == signature)).select("document_id", "content_hash")
    return files.join(held, ["document_id", "content_hash"], "left_anti").select(*files.columns)


def issues(index: DataFrame, dimensions: int, pending: DataFrame | None = None, declared_points: int | None = None, distance: str = "Cosine") -> DataFrame:
    """severity, code, document_id, chunk_id of all that is wrong with an index. Rows are read once for their own codes and once for those of documents."""
    columns = set(index.columns)
    no_chunk = F.lit(None).cast("string").alias("chunk_id")

    def coded(rows: DataFrame, codes: list[tuple], chunk) -> DataFrame:
        each = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for wrong, code, severity in codes))))
        return rows.select(each.alias("_c"), F.col("document_id").cast("string").alias("document_id"), chunk).select("_c.severity", "_c.code", "document_id", "chunk_id")

    own = [(F.col("char_count") != F.length("text"), "char_count", "error")]
    if "dense" in columns:
        size = F.coalesce(F.size("dense"), F.lit(-1))
        own += [(size != dimensions, "vector_dimensions", "error"), ((size == dimensions) & ~norm(F.col("dense")).between(0.98, 1.02), "vector_norm", "error")]
    if "lexical" in columns:
        own += [(F.col("lexical").isNull(), "sparse_vector_missing", "error"), (bad_sparse(F.col("lexical")), "sparse_vector_invalid", "error")]
    if "pages" in columns:
        own += [(F.col("pages").isNull() | F.exists("pages", lambda p: p.isNull() | (p < 1)), "invalid_payload", "error"), (F.lower("source_path").endswith(".pdf") & (F.size("pages") == 0), "pdf_page_missing", "warning")]
    listing = documents(index, pending)
    per = [(F.col("index_incomplete"), "incomplete_update", "error"), (F.col("chunk_count") != F.col("n_chunks"), "chunk_count_mismatch", "error"), (F.col("ordinal_gap"), "ordinal_gap", "error")]
    out = coded(index, own, F.col("chunk_id").cast("string").alias("chunk_id")).unionByName(coded(listing, per, no_chunk))
    whole = []
    if distance != "Cosine":
        whole.append("distance")
    if not {"dense", "lexical"} <= columns:
        whole.append("hybrid_schema")
    one = index.sparkSession.range(1).select(F.lit(None).cast("string").alias("document_id"))
    if whole:
        out = out.unionByName(coded(one, [(F.lit(True), code, "error") for code in whole], no_chunk))
    if declared_points is not None:
        wrong = index.agg(F.count("*").alias("n")).where(F.col("n") != declared_points).select(F.lit(None).cast("string").alias("document_id"))
        out = out.unionByName(coded(wrong, [(F.lit(True), "point_count", "error")], no_chunk))
    return out


def schema_report(index: DataFrame, dimensions: int, distance: str = "Cosine") -> dict:
    """What a collection is: its columns, the lengths of its dense vectors with their rows, and whether it can be searched by both vectors.

    status is ready, empty, or why not: hybrid_schema (a vector column is missing) or collection_dimensions (a length other than declared).
    """
    columns = set(index.columns)
    if not {"dense", "lexical"} <= columns:
        return {"status": "hybrid_schema", "hybrid": False, "distance": distance, "dimensions": {}, "points": index.count()}
    sizes = {r["n"]: r["rows"] for r in index.groupBy(F.coalesce(F.size("dense"), F.lit(-1)).alias("n")).agg(F.count("*").alias("rows")).collect()}
    state = "empty" if not sizes else "ready" if set(sizes) == {dimensions} and distance == "Cosine" else "distance" if distance != "Cosine" else "collection_dimensions"
    return {"status": state, "hybrid": True, "distance": distance, "dimensions": sizes, "points": sum(sizes.values())}


def artifact_issues(listing: DataFrame, raw: DataFrame, processed: DataFrame) -> DataFrame:
    """severity, code, document_id: raw copies (content_hash, sha256) and processed artifacts (document_id, content_hash, pipeline_signature, n_chunks) that are missing or differ."""
    by_hash = raw.select("content_hash", F.col("sha256").alias("_sha"))
    r = listing.join(by_hash, "content_hash", "left")
    p = listing.alias("l").join(processed.alias("p"), "document_id", "left")
    same = (F.col("l.content_hash") == F.col("p.content_hash")) & (F.col("l.pipeline_signature") == F.col("p.pipeline_signature")) & (F.col("l.n_chunks") == F.col("p.n_chunks"))
    code = lambda rows, name: rows.select(F.lit("error").alias("severity"), F.lit(name).alias("code"), "document_id")
    return (
        code(r.where("_sha is null"), "missing_artifact")
        .unionByName(code(p.where(F.col("p.content_hash").isNull()), "missing_artifact"))
        .unionByName(code(r.where("_sha <> content_hash"), "raw_checksum"))
        .unionByName(code(p.where(F.col("p.content_hash").isNotNull() & ~F.coalesce(same, F.lit(False))), "processed_artifact"))
    )


def bad_sparse(lexical: Column) -> Column:
    """A map from token id to weight that is empty, or has a negative id or a weight that is not finite and positive."""
    entries = F.map_entries(lexical)
    return (F.size(lexical) == 0) | F.exists(entries, lambda e: (e["key"] < 0) | e["value"].isNull() | F.isnan(e["value"]) | (e["value"] <= 0) | (e["value"] == float("inf")))


def sorted_sparse(lexical: Column) -> Column:
    """indices and values of a lexical map, by token id."""
    entries = F.array_sort(F.map_entries(lexical))
    return F.struct(F.transform(entries, lambda e: e["key"]).alias("indices"), F.transform(entries, lambda e: e["value"]).alias("values"))


FAN = 8
#: Rows of a segment of the lowest level at most; each level above holds FAN times as many.
LEVEL_ROWS = 10_000
#: Two writers' numbers of a change; only one of them can have it.
CONFLICT = "another change was committed first"


class Conflict(RuntimeError):
    """The change was not made, as another writer's came before it. Read the index again and retry."""


class IndexStore:
    """An index as a log in a folder of any store Spark writes to. A change adds a segment and names it in a new manifest; nothing is written again for it.

    A segment has rows, the documents they are of, and deletes: documents whose rows in earlier segments hold no more. Rows and deletes carry the number of
    their change, so a reader takes the rows that no later delete meets. Once `fan` segments of one level have none above them that is newer, they and
    those between become one of the level above, without the rows that deletes among them meet; deletes go with the oldest segment. So a row is written again once a level, and there are about fan segments a level, whatever the number of changes.

    A manifest is one small file that names the segments; the one of the highest number holds. It is made whole under another name and then renamed to the
    number after the one that the writer has read, which fails if that is taken: of two writers at once one gets Conflict, and its
    segment goes. Readers see the index before or after a change, never a part. (The store's rename must not replace a file, as HDFS's does not;
    on local disks a hard link is made instead.) A marker names the documents of a change under way; one that a lost job leaves behind is what
    documents(pending=...) reports.
    """

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        if fan < 2:
            raise ValueError("fan is 2 or more")
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifests --

    def _children(self, name: str) -> list:
        place = self._path(f"{self.folder}/{name}")
        return [x.getPath() for x in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def version(self) -> int | None:
        """The number of the last change."""
        return max((int(n) for n in (x.getName() for x in self._children("manifest")) if n.isdigit()), default=None)

    def manifest(self, version: int | None = None) -> list[dict] | None:
        """The segments, oldest first: name, level, rows (as written), deletes (whether there are any). None where nothing was ever written."""
        number = self.version() if version is None else version
        if number is None:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/manifest/{number}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, segments: list[dict]) -> None:
        """Name the segments in the manifest of this number, if no other writer has."""
        self._fs.mkdirs(self._path(f"{self.folder}/manifest"))
        draft, place = (self._path(f"{self.folder}/manifest/{x}") for x in (f"draft-{uuid.uuid4().hex}", number))
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(segments).encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":
                try:
                    os.link(draft.toUri().getPath(), place.toUri().getPath())
                except FileExistsError:
                    raise Conflict(CONFLICT) from None
            elif self._fs.exists(place) or not self._fs.rename(draft, place):
                raise Conflict(CONFLICT)
        finally:
            self._fs.delete(draft, False)

    # -- reading --

    def _parts(self, segments: list[dict], part: str) -> DataFrame | None:
        places = [f"{self.folder}/segments/{s['name']}/{part}" for s in segments if part != "deletes" or s["deletes"]]
        return self.spark.read.parquet(*places) if places else None

    def _live(self, segments: list[dict], part: str = "rows") -> DataFrame | None:
        """Rows, or documents, that no delete of these segments meets, with _seq."""
        rows, deletes = self._parts([s for s in segments if s["rows"]], part), self._parts(segments, "deletes")
        if rows is None or deletes is None:
            return rows
        last = deletes.groupBy("document_id").agg(F.max("_seq").alias("_gone"))
        return rows.join(last, (rows["document_id"] == last["document_id"]) & (rows["_seq"] < last["_gone"]), "left_anti")

    def read(self) -> DataFrame | None:
        """All rows; none where nothing was written or all was deleted."""
        segments = self.manifest()
        rows = self._live(segments) if segments else None
        return rows.drop("_seq") if rows is not None and not rows.isEmpty() else None

    def chunks(self, document: str) -> DataFrame | None:
        """A document's rows in order. Segments are sorted by document and have Bloom filters, so of each few row groups are read."""
        segments = self.manifest()
        if segments is None:
            return None
        rows = self._live(segments)
        if rows is None:
            return self.spark.createDataFrame([], "document_id string, ordinal int")
        return rows.where(F.col("document_id") == document).drop("_seq").orderBy("ordinal")

    def pending(self) -> DataFrame | None:
        """document_id of changes that have begun and not ended."""
        marks = [x.toString() for x in self._children("pending") if self._fs.exists(self._path(f"{x.toString()}/_SUCCESS"))]
        return self.spark.read.parquet(*marks) if marks else None

    # -- writing --

    def _level(self, rows: int) -> int:
        level = 0
        while rows > LEVEL_ROWS * self.fan**level:
            level += 1
        return level

    def _segment(self, rows: DataFrame | None, deletes: DataFrame | None, least: int = 0) -> dict:
        """Write a segment. rows and deletes have _seq."""
        name, n = uuid.uuid4().hex, 0
        place = f"{self.folder}/segments/{name}"
        if rows is not None:
            sorted_rows = rows.repartition("document_id").sortWithinPartitions("document_id", "ordinal")
            # Without a number of ids each filter, one a file, takes a megabyte.
            filters = {"parquet.bloom.filter.enabled#document_id": "true", "parquet.bloom.filter.expected.ndv#document_id": str(LEVEL_ROWS)}
            sorted_rows.write.options(**filters).parquet(f"{place}/rows")
            held = self.spark.read.parquet(f"{place}/rows")
            n = held.count()
            held.select("document_id", "source_path", "_seq").distinct().write.parquet(f"{place}/documents")
        some = deletes is not None
        if some:
            deletes.groupBy("document_id").agg(F.max("_seq").alias("_seq")).write.parquet(f"{place}/deletes")
        return {"name": name, "level": max(least, self._level(n)), "rows": n, "deletes": some}

    def _drop(self, segment: dict) -> None:
        self._fs.delete(self._path(f"{self.folder}/segments/{segment['name']}"), True)

    def _commit(self, number: int, held: list[dict], rows: DataFrame | None, deletes: DataFrame | None) -> int:
        seq = F.lit(number).cast("long").alias("_seq")
        segment = self._segment(rows.select("*", seq) if rows is not None else None, deletes.select("document_id", seq) if deletes is not None else None)
        try:
            self._publish(number, [*held, segment])
        except Exception:
            self._drop(segment)
            raise
        return number

    def compact(self) -> bool:
        """Merge the last segments of a level if there are `fan` of them; whether anything was done. Nothing is lost if another writer comes first."""
        number, segments = self.version(), self.manifest()
        for level in sorted({s["level"] for s in segments or []}):
            start = len(segments)
            while start and segments[start - 1]["level"] <= level:
                start -= 1
            own = segments[start:]
            if sum(s["level"] == level for s in own) < self.fan:
                continue
            deletes = self._parts(own, "deletes") if start else None
            rows = self._live(own)
            merged = self._segment(rows, deletes, max(s["level"] for s in own) + 1)
            try:
                self._publish(number + 1, [*segments[:start], merged])
            except Conflict:
                self._drop(merged)
                return False
            return True
        return False

    def write(self, index: DataFrame) -> int:
        """Make this the index."""
        return self._commit((-1 if (v := self.version()) is None else v) + 1, [], index, None)

    def replace(self, new: DataFrame, dimensions: int) -> int:
        """Put documents in the place of those with their ids or paths; refused as a whole if any is bad. If writing fails, the index stays what it was and
        the marker goes; a job that is lost leaves its marker, which the next change of these documents takes away. Of what is there it reads two
        columns of a row a document.
        """
        wrong = refused(new, dimensions).orderBy("document_id").limit(5).collect()
        if wrong:
            raise ValueError("documents refused: " + ", ".join(f"{r['document_id']} ({r['problem']})" for r in wrong))
        number = self.version()
        held = self.manifest(number) or [] if number is not None else []
        ids = new.select("document_id").distinct()
        gone = None
        if any(s["rows"] for s in held):  # a document of another id may have the same path
            there = self._live(held, "documents")
            same_path = there.join(new.select("source_path").distinct(), "source_path", "left_semi").select("document_id")
            gone = there.join(ids, "document_id", "left_semi").select("document_id").unionByName(same_path).distinct()
        mark = f"{self.folder}/pending/{uuid.uuid4().hex}"
        (ids if gone is None else ids.unionByName(gone).distinct()).write.parquet(mark)
        marked = self.spark.read.schema(ids.schema).parquet(mark)
        try:
            if gone is not None:
                gone = cut(gone)
                gone = None if gone.isEmpty() else gone
            columns = self._parts([s for s in held if s["rows"]][-1:], "rows")
            columns = [c for c in columns.columns if c != "_seq"] if columns is not None else new.columns
            number = self._commit((-1 if number is None else number) + 1, held, new.select(*columns), gone)
        except Exception:
            self._fs.delete(self._path(mark), True)
            raise
        self._clear(marked)
        while self.compact():
            pass
        return number

    def _clear(self, done: DataFrame) -> None:
        """Remove markers whose documents are all among done."""
        read = lambda x: self.spark.read.schema("document_id string").parquet(x.toString())
        over = [x for x in self._children("pending") if read(x).join(done, "document_id", "left_anti").isEmpty()]
        for x in over:  # done may be one of them
            self._fs.delete(x, True)

    def delete(self, document_ids: list[str]) -> int | None:
        """Only the names of the documents are written."""
        number = self.version()
        held = self.manifest(number) if number is not None else None
        if not held:
            return None
        gone = self.spark.createDataFrame([(x,) for x in document_ids], "document_id string")
        number = self._commit(number + 1, held, None, gone)
        while self.compact():
            pass
        return number

    def remove(self) -> None:
        """Remove the store. Nothing may be using it."""
        self._fs.delete(self._path(self.folder), True)

    def vacuum(self) -> None:
        """Remove segments that the last manifest does not name, and earlier manifests. Nothing may be writing, or reading an older index."""
        number = self.version()
        held = {s["name"] for s in self.manifest(number) or []} if number is not None else set()
        for x in self._children("segments"):
            if x.getName() not in held:
                self._fs.delete(x, True)
        for x in self._children("manifest"):
            if x.getName() != str(number):
                self._fs.delete(x, True)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
