"""What is stored, read back as it is: payloads of points and processed artifacts as JSON, checked key by key.

`index.issues` is told the types of its columns; here nothing is known but the text. It becomes a variant once, and every check is a column over it.
Numbers may be given as digits in a string, as the writer's language reads them; true and false are no numbers. A text that is no JSON object, or too
large for a variant, has the fault "json" alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import norm
from .index import DOCUMENT, bad_sparse, documents

WHOLE, NUMBERS = ["BIGINT"], r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _none() -> Column:
    return F.lit(None).cast("string")


def _parsed(text: str) -> Column:
    """The JSON object in a column, null where it is none."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _get(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _kind(v: Column, key: str) -> Column:
    """The type of a key's value, null where it is missing."""
    return F.schema_of_variant(_get(v, key, "variant"))


def _number(v: Column, key: str) -> Column:
    return F.when(_kind(v, key) != "BOOLEAN", _get(v, key, "bigint"))


def _each(v: Column, key: str, good) -> Column:
    """The key holds a list, and good() is true of each of its values."""
    items = _get(v, key, "array<variant>")
    return F.coalesce(_kind(v, key).startswith("ARRAY") & F.forall(items, lambda x: F.coalesce(good(x), F.lit(False))), F.lit(False))


def _first(*faults: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for good, name in faults))


def decoded(points: DataFrame) -> DataFrame:
    """points: payload (JSON), dense, lexical. A row per point: its document's columns, chunk_id, ordinal, dimensions, text, char_count, media_type, pages,
    dense, lexical, and fault: the first key in the order of a reader (ordinal, embedding_dimensions, text, char_count, pages, heading_path, metadata)
    that is missing or of a wrong type. Other columns of points are not looked at.
    """
    v = F.col("v")
    text = F.when(_kind(v, "text") == "STRING", _get(v, "text", "string"))
    page = lambda x: F.schema_of_variant(x).isin(WHOLE) & (F.try_variant_get(x, "$", "bigint") > 0)
    fault = _first(
        (v.isNotNull(), "json"),
        (_number(v, "ordinal").isNotNull(), "ordinal"),
        (_number(v, "embedding_dimensions").isNotNull(), "embedding_dimensions"),
        (_kind(v, "text").isNotNull(), "text"),
        (text.isNull() | _number(v, "char_count").isNotNull(), "char_count"),
        (_each(v, "pages", page), "pages"),
        (_each(v, "heading_path", lambda x: F.schema_of_variant(x) == "STRING"), "heading_path"),
        (_kind(v, "metadata").startswith("OBJECT"), "metadata"),
    )
    names = {c: _get(v, c, "bigint" if c == "chunk_count" else "string") for c in ("document_id", "chunk_id", "media_type", *DOCUMENT)}
    return points.select(_parsed("payload").alias("v"), "dense", "lexical").select(
        *(x.alias(c) for c, x in names.items()),
        _number(v, "ordinal").alias("ordinal"),
        _number(v, "embedding_dimensions").alias("dimensions"),
        text.alias("text"),
        _number(v, "char_count").alias("char_count"),
        F.coalesce(F.size(_get(v, "pages", "array<variant>")), F.lit(0)).alias("n_pages"),
        "dense",
        "lexical",
        fault.alias("fault"),
    )


def payload_issues(points: DataFrame, dimensions: int, declared_points: int | None = None, status: str = "green", pending: DataFrame | None = None) -> DataFrame:
    """severity, code, reason, document_id, chunk_id of all that is wrong with points (payload, dense, lexical) of a collection of that many dimensions.

    A point whose payload has a fault is an invalid_payload with the faulty key as reason; checks of later keys are left out for it, those of earlier
    ones are not. Codes of a document come once each; a point without a document's id belongs to none. An empty table has no issues but those of the
    collection: its status (green and yellow are good), and the number of points that it declares.
    """
    rows = decoded(points)
    known = ["json", "ordinal", "embedding_dimensions"]
    vectors = F.coalesce(~F.col("fault").isin(known), F.lit(True))
    worded = F.coalesce(~F.col("fault").isin(*known, "text", "char_count"), F.lit(True))
    size = F.coalesce(F.size("dense"), F.lit(-1))
    length = norm(F.col("dense"))
    tests = [
        (F.col("fault").isNotNull(), "error", "invalid_payload", F.col("fault")),
        (vectors & (size != F.col("dimensions")), "error", "vector_dimensions", _none()),
        (vectors & (size == F.col("dimensions")) & ~F.coalesce(length.between(0.98, 1.02), F.lit(False)), "error", "vector_norm", _none()),
        (vectors & F.col("lexical").isNull(), "error", "sparse_vector_missing", _none()),
        (vectors & bad_sparse(F.col("lexical")), "error", "sparse_vector_invalid", _none()),
        (worded & ~F.coalesce(F.length("text") == F.col("char_count"), F.lit(False)), "error", "char_count", _none()),
        (F.col("fault").isNull() & (F.col("media_type") == "application/pdf") & (F.col("n_pages") == 0), "warning", "pdf_page_missing", _none()),
    ]
    own = _coded(rows, tests, F.col("chunk_id"))
    listed = rows.where("document_id IS NOT NULL")
    sizes = listed.groupBy("document_id").agg(F.min("dimensions").alias("_least"), F.max("dimensions").alias("_most"))
    per = documents(listed, pending).join(sizes, "document_id", "left")
    of_documents = [
        (F.col("index_incomplete"), "error", "incomplete_update", _none()),
        (F.col("chunk_count") != F.col("n_chunks"), "error", "chunk_count_mismatch", _none()),
        (F.col("ordinal_gap"), "error", "ordinal_gap", _none()),
        ((F.col("_least") != dimensions) | (F.col("_most") != dimensions), "error", "collection_dimensions", _none()),
    ]
    out = own.unionByName(_coded(per, of_documents, _none()))
    counts = points.agg(F.count("*").alias("n")).withColumn("document_id", _none())
    whole = [(F.lit(status not in ("green", "yellow")), "error", "collection_status", F.lit(status)), (F.col("n") != declared_points, "error", "point_count", _none())]
    return out.unionByName(_coded(counts, whole if declared_points is not None else whole[:1], _none()))


def _coded(rows: DataFrame, tests: list[tuple], chunk: Column) -> DataFrame:
    """An issue for each test that is true of a row."""
    found = (F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), reason.alias("reason"))) for bad, severity, code, reason in tests)
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("i"), "document_id", chunk.alias("chunk_id")).select("i.*", "document_id", "chunk_id")


PROVEN = {"text/markdown": "lines", "application/pdf": "box"}


def artifact_faults(listing: DataFrame, processed: DataFrame, images: DataFrame) -> DataFrame:
    """document_id, block (null: the artifact as a whole), fault: the first that is wrong with each document's processed artifact.

    listing: document_id, source_path, media_type, content_hash, pipeline_signature, chunk_count. processed: document_id, payload (JSON). images:
    document_id, sha256, content. Faults: missing, json, document_id, content_hash, pipeline_signature, chunks; of blocks, first to last: no_source,
    source_keys, source_path, source_range (Markdown: path, lines and characters), source_box (PDF: path, page, a box of four numbers), image_missing,
    image_checksum. Other media types have no rule for blocks. Repeated artifacts of a document are each judged and the first fault counts.
    """
    v = F.col("v")
    held = processed.select("document_id", _parsed("payload").alias("v"), F.lit(True).alias("_held"))
    both = listing.select("document_id", "source_path", "media_type", "content_hash", "pipeline_signature", "chunk_count").join(held, "document_id", "left")
    same = lambda key: _get(v, key, "string").eqNullSafe(F.col(key))
    n_chunks = F.coalesce(F.size(_get(v, "chunks", "array<variant>")), F.lit(0))
    whole = _first((F.col("_held"), "missing"), (v.isNotNull(), "json"), *((same(k), k) for k in ("document_id", "content_hash", "pipeline_signature")), (n_chunks == F.col("chunk_count"), "chunks"))
    both = both.withColumn("whole", whole)
    own = both.where("whole IS NOT NULL").select("document_id", F.lit(-1).alias("at"), F.lit(0).alias("step"), F.col("whole").alias("fault"))
    b = both.where(F.col("whole").isNull() & F.col("media_type").isin(list(PROVEN))).select("document_id", "source_path", "media_type", F.posexplode(_get(v, "blocks", "array<variant>")).alias("at", "b"))
    # A block's metadata may be an object, or that object's text.
    b = b.select("document_id", "source_path", "media_type", "at", _parsed(_get(F.col("b"), "metadata", "string")).alias("m"))
    b = b.select("*", F.when(_kind(F.col("m"), "source").startswith("OBJECT"), _get(F.col("m"), "source", "variant")).alias("s"))
    s = F.col("s")
    at = lambda key: F.when(_kind(s, key).isin(WHOLE), _get(s, key, "bigint"))
    placed = _get(s, "path", "string") == F.col("source_path")
    keys = F.lit(True)
    for key in ("path", "start_line", "end_line", "start_char", "end_char"):
        keys = keys & _kind(s, key).isNotNull()
    ranged = (at("start_line") >= 1) & (at("start_line") <= at("end_line")) & (at("start_char") >= 0) & (at("start_char") <= at("end_char"))
    box = _each(s, "bbox", lambda x: F.schema_of_variant(x).rlike(NUMBERS)) & (F.size(_get(s, "bbox", "array<variant>")) == 4) & (at("page") >= 1)
    markdown, pdf = F.col("media_type") == "text/markdown", F.col("media_type") == "application/pdf"
    source = _first((s.isNotNull(), "no_source"), (~markdown | keys, "source_keys"), (placed, "source_path"), (~markdown | ranged, "source_range"), (~pdf | box, "source_box"))
    of_sources = b.select("document_id", "at", F.lit(1).alias("step"), source.alias("fault")).where("fault IS NOT NULL")
    kept = F.coalesce(_get(F.col("m"), "image.extracted_path", "string"), F.lit("")) != ""
    shown = b.where(pdf & kept).select("document_id", "at", _get(F.col("m"), "image.sha256", "string").alias("sha256"))
    stored = images.groupBy("document_id", "sha256").agg(F.max(F.sha2("content", 256) != F.col("sha256")).alias("wrong"))
    of_images = shown.join(stored, ["document_id", "sha256"], "left").select(
        "document_id", "at", F.lit(2).alias("step"), F.when(F.col("wrong").isNull(), "image_missing").when(F.col("wrong"), "image_checksum").alias("fault")
    ).where("fault IS NOT NULL")
    first = own.unionByName(of_sources).unionByName(of_images).groupBy("document_id").agg(F.min(F.struct("at", "step", "fault")).alias("f"))
    return first.select("document_id", F.when(F.col("f.at") >= 0, F.col("f.at")).alias("block"), "f.fault")
