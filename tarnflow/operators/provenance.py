"""Where strips come from, and whether chunks are what their spans say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Refinement
from ..functions.text import bound
from .blocks import clip_spans
from .chunking import strip_places


def strip_spans(spans: Column, start: Column, end: Column) -> Column:
    """A chunk's spans cut to a strip, in the chunk's characters, with strip_char_start and strip_char_end."""
    cut = clip_spans(spans, start, end, start)
    place = lambda s, c: (s[f"chunk_char_{c}"] - start).cast("int")
    return F.transform(cut, lambda s: s.withField("strip_char_start", place(s, "start")).withField("strip_char_end", place(s, "end")))


def strip_provenance(strips: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """strips (key, start, end, ...) with source_spans, pages, heading_path, heading_paths, has_overlap: of the spans that meet the strip only, so a citation names
    the pages that its text is of. chunks: key (unique), source_spans.

    A strip whose chunk is not there, or has no spans, or meets none, has empty lists. pages ascend; heading_paths are told apart and in the order of
    the text, without empty ones; heading_path is the first.
    """
    spans = chunks.select(key, F.col("source_spans").alias("_spans"))
    rows = strips.join(spans, key, "left").withColumn("source_spans", strip_spans(F.col("_spans"), F.col("start"), F.col("end"))).drop("_spans")
    return with_rollup(rows)


def strips_of(chunks: DataFrame, key: str = "chunk_id", config: Refinement = Refinement()) -> DataFrame:
    """strip_provenance() of the chunks' own strips: key, start, end, and what it adds. A strip is cut in its chunk's row, where the spans are, so nothing is joined.
    chunks: key, text, source_spans.
    """
    rows = chunks.select(key, F.col("source_spans").alias("_spans"), F.explode(strip_places(F.col("text"), config)).alias("_s")).select(key, "_spans", "_s.start", "_s.end")
    return with_rollup(rows.withColumn("source_spans", strip_spans(F.col("_spans"), F.col("start"), F.col("end"))).drop("_spans"))


def with_rollup(rows: DataFrame) -> DataFrame:
    """rows with what their source_spans add up to."""
    spans = F.coalesce("source_spans", F.array().cast(rows.schema["source_spans"].dataType))
    pages = F.array_sort(F.array_distinct(F.filter(F.transform(spans, lambda s: s["page"]), lambda p: p.isNotNull())))
    paths = F.array_distinct(F.filter(F.transform(spans, lambda s: s["heading_path"]), lambda p: F.size(p) > 0))
    first = F.when(F.size("heading_paths") > 0, F.col("heading_paths")[0]).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("source_spans", spans).withColumn("pages", pages).withColumn("heading_paths", paths)
    return rows.withColumn("heading_path", first).withColumn("has_overlap", F.exists("source_spans", lambda s: F.coalesce(s["is_overlap"], F.lit(False))))


def unproven(chunks: DataFrame, blocks: DataFrame, document: str = "document_id") -> DataFrame:
    """An issue row for each chunk that its blocks do not prove: document, chunk_id, severity, code, spans (how many are wrong).

    span_text: a span's characters are not those of its block there (or there is no such block). span_gap: characters other
    than white space lie before, between or after the spans, or spans overlap. chunks: document, chunk_id, text, source_spans; blocks: document, ordinal (unique), text.
    """
    part = lambda text, start, end: F.substring(text, start + 1, end - start)
    said = lambda start, n: ~F.substring("text", start + 1, n).rlike(r"(?U)^\s*$")

    def apart(spans: Column) -> Column:
        """How many spans have a gap before them or overlap, or are the last and leave something."""

        def wrong(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(spans, i - 1)["z"], F.lit(0))
            last = F.get(spans, i + 1)["a"].isNull()
            return (s["a"] < before) | said(before, s["a"] - before) | (last & said(s["z"], F.length("text")))

        return F.size(F.filter(spans, wrong)).cast("long")

    item = lambda code, ordinal, start, end, piece, n: F.struct(code.alias("code"), ordinal.alias("_ordinal"), start.alias("a"), end.alias("z"), piece.alias("piece"), n.alias("n"))
    places = F.array_sort(F.transform("source_spans", lambda s: F.struct(s["chunk_char_start"].alias("a"), s["chunk_char_end"].alias("z"))))
    pieces = F.transform("source_spans", lambda s: item(F.lit("span_text"), s["block_ordinal"], s["block_char_start"], s["block_char_end"], part(F.col("text"), s["chunk_char_start"], s["chunk_char_end"]), F.lit(1).cast("long")))
    null = F.lit(None).cast("int")
    gaps = F.when(F.coalesce(F.size("source_spans"), F.lit(0)) > 0, bound(places, apart)).when(F.length("text") > 0, F.lit(0).cast("long"))
    is_gap = (gaps > 0) | (F.coalesce(F.size("source_spans"), F.lit(0)) <= 0) & gaps.isNotNull()
    # A chunk becomes its pieces, about as long as it is, and a row for its gaps: a chunk's text goes nowhere once a span.
    rows = chunks.select(document, "chunk_id", F.explode(F.concat(F.coalesce(pieces, F.array()), F.when(is_gap, F.array(item(F.lit("span_gap"), null, null, null, F.lit(None).cast("string"), gaps))).otherwise(F.array()))).alias("s")).select(document, "chunk_id", "s.*")
    of = blocks.select(document, F.col("ordinal").alias("_ordinal"), F.col("text").alias("_block"))
    met = rows.join(of, [document, "_ordinal"], "left")
    wrong = met.where((F.col("code") == "span_gap") | ~F.col("piece").eqNullSafe(part(F.col("_block"), F.col("a"), F.col("z"))))
    return wrong.groupBy(document, "chunk_id", "code").agg(F.sum("n").alias("spans")).select(document, "chunk_id", F.lit("error").alias("severity"), "code", "spans")
