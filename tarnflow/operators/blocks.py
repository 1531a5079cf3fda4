"""Blocks of documents: paragraphs, cleaning, running heads, spans.

A blocks table has document_id, ordinal, text, kind, page, heading_path, metadata.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Cleaning
from ..functions.text import clean_text, content_lines, margin_key, paragraph_spans

BLOCK = "struct<text:string,kind:string,page:int,heading_path:array<string>,metadata:string>"


def _paragraph_batches(kind: pa.Schema):
    """A document is read once from its start to its end, so the work is in proportion to its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                rows += [(i, n, *p) for n, p in enumerate(paragraph_spans(text or ""))]
            at, *columns = zip(*rows, strict=True) if rows else [()] * 7
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, f.type) for c, f in zip(columns, list(kind), strict=True))], ["key", *kind.names])

    return run


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ordinal (from 0), text, start_char, end_char, start_line, end_line (from 1) of the parts between blank lines. Rows alike are documents of their own."""
    whole = pa.int32()
    kind = pa.schema([("ordinal", whole), ("text", pa.string()), ("start_char", whole), ("end_char", whole), ("start_line", whole), ("end_line", whole)])
    schema = f"key {docs.schema[key].dataType.simpleString()}, ordinal int, text string, start_char int, end_char int, start_line int, end_line int"
    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(_paragraph_batches(kind), schema).withColumnRenamed("key", key)


def repeated_margins(blocks: DataFrame, config: Cleaning = Cleaning(), by: str = "document_id") -> DataFrame:
    """by, key, pages: first and last lines, numbers made equal, that stand on enough pages of a document. Blocks without a page do not count."""
    lines = blocks.where("page is not null").select(by, "page", "ordinal", content_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    ends = lines.groupBy(by, "page").agg(F.min_by(F.col("lines")[0], "ordinal").alias("first"), F.max_by(F.element_at("lines", -1), "ordinal").alias("last"))
    pages = blocks.where("page is not null").groupBy(by).agg(F.countDistinct("page").alias("n"))
    keys = ends.select(by, "page", F.explode(F.array_distinct(F.array(margin_key(F.col("first")), margin_key(F.col("last"))))).alias("key")).where("key <> ''")
    counted = keys.groupBy(by, "key").agg(F.count("*").alias("pages")).join(pages, by)
    need = F.greatest(F.lit(config.margin_min_pages), F.floor(F.col("n") * config.margin_ratio + 0.999))
    return counted.where((F.col("n") >= config.margin_min_pages) & (F.col("pages") >= need)).select(by, "key", "pages")


def _strip_margins(lines: Column, keys: Column) -> Column:
    """Lines without those at either end whose key repeats."""
    kept = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: ~F.array_contains(keys, margin_key(F.element_at(lines, i))))
    return F.when(F.size(lines) == 0, lines).when(F.size(kept) == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.array_min(kept), F.array_max(kept) - F.array_min(kept) + 1))


def cleaned(blocks: DataFrame, config: Cleaning = Cleaning()) -> DataFrame:
    """The same columns with clean text and headings, no empty blocks, running heads taken off, ordinals from 0 again."""
    b = blocks.withColumn("_clean", clean_text(F.col("text")))
    if config.remove_repeated_margins:
        keys = repeated_margins(blocks, config).groupBy("document_id").agg(F.collect_set("key").alias("_keys"))
        b = b.join(keys, "document_id", "left")
        lines = F.filter(F.split("_clean", "\n"), lambda x: F.trim(x) != "")
        stripped = F.btrim(F.array_join(_strip_margins(lines, F.col("_keys")), "\n"), F.lit(" \n"))
        b = b.withColumn("_clean", F.when(F.col("_keys").isNotNull() & F.col("page").isNotNull(), stripped).otherwise(F.col("_clean")))
    b = b.where("_clean <> ''")
    order = Window.partitionBy("document_id").orderBy("ordinal")
    out = b.withColumn("_n", (F.row_number().over(order) - 1).cast("int"))
    heads = F.transform(F.filter("heading_path", lambda h: F.trim(h) != ""), lambda h: F.btrim(F.regexp_replace(h, r"(?U)\s+", " "), F.lit(" ")))
    names = {"text": F.col("_clean"), "ordinal": F.col("_n"), "heading_path": heads}
    return out.select(*(names[c].alias(c) if c in names else F.col(c) for c in blocks.columns))


def clip_spans(spans: Column, start: Column, end: Column, offset: Column | None = None) -> Column:
    """Spans (structs with chunk_char_start/end and block_char_start/end among their fields) cut to [start, end), moved to offset."""
    offset = F.lit(0) if offset is None else offset

    def clip(s: Column) -> Column:
        left, right = F.greatest(start, s["chunk_char_start"]), F.least(end, s["chunk_char_end"])
        at = s["block_char_start"] + left - s["chunk_char_start"]
        return (
            s.withField("chunk_char_start", (offset + left - start).cast("int"))
            .withField("chunk_char_end", (offset + right - start).cast("int"))
            .withField("block_char_start", at.cast("int"))
            .withField("block_char_end", (at + right - left).cast("int"))
        )

    return F.transform(F.filter(spans, lambda s: F.greatest(start, s["chunk_char_start"]) < F.least(end, s["chunk_char_end"])), clip)
