"""Structural chunks and knowledge strips of documents.

Packing is a fold over a document's pieces, so a document goes through one Python pass; an array fold in the JVM would copy its state for
every piece. A document's blocks arrive as one row, and nothing is shuffled after that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..config import Chunking, Refinement
from ..functions.batches import by_slices, slices

#: Where a sentence ends for chunks, and for strips (a capital must follow).
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
STRIP_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+(?=[A-ZÀ-ỴĐ])")
GAP = "\n\n"

SPAN = "struct<chunk_char_start:int,chunk_char_end:int,block_ordinal:int,block_char_start:int,block_char_end:int,page:int,heading_path:array<string>,kind:string,source_metadata:string,is_overlap:boolean>"
CHUNK = f"document_id string, chunk_id string, ordinal int, text string, char_count int, pages array<int>, heading_path array<string>, kinds array<string>, has_overlap boolean, source_metadata array<string>, source_spans array<{SPAN}>"


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The range without white space at its ends."""
    part = text[start:end]
    return start + len(part) - len(part.lstrip()), end - len(part) + len(part.rstrip())


def piece_ranges(text: str, limit: int) -> list[tuple[int, int]]:
    """Ranges of a block: the whole if it fits, else its sentences, and of a sentence too long parts that end at a space where there is one in their
    second half.
    """
    if len(text) <= limit:
        whole = trimmed(text, 0, len(text))
        return [whole] if whole[0] < whole[1] else []
    out, begin = [], 0
    edges = [(m.start(), m.end()) for m in SENTENCE.finditer(text)] + [(len(text), len(text))]
    for stop, after in edges:
        at = trimmed(text, begin, stop)[0]
        while at < stop:
            cut = stop
            if stop - at > limit:
                space = text.rfind(" ", at, at + limit + 1)
                cut = space if space - at >= limit // 2 else at + limit
            a, b = trimmed(text, at, cut)
            if a < b:
                out.append((a, b))
            at = max(cut, trimmed(text, cut, stop)[0])
        begin = after
    return out


def packed(lengths: list[int], config: Chunking) -> list[list[int]]:
    """Pieces by number, put together in order as long as they fit; a last group too short joins the one before if it fits there."""
    groups: list[list[int]] = []
    sizes: list[int] = []
    for i, n in enumerate(lengths):
        if groups and sizes[-1] + len(GAP) + n <= config.max_chars:
            groups[-1].append(i)
            sizes[-1] += len(GAP) + n
        else:
            groups.append([i])
            sizes.append(n)
    if len(groups) > 1 and sizes[-1] < config.min_chars and sizes[-2] + len(GAP) + sizes[-1] <= config.max_chars:
        groups[-2] += groups.pop()
    return groups


def overlap_tail(text: str, limit: int) -> str:
    """At most the last limit characters, from after the first space in them if there is one."""
    if limit <= 0 or len(text) <= limit:
        return text if limit > 0 else ""
    last = text[-limit:]
    return last.partition(" ")[2] if " " in last else last


def chunk_document(document_id: str, blocks: list[dict], config: Chunking = Chunking()) -> list[dict]:
    """Rows of CHUNK for one document's blocks (text, kind, page, heading_path, metadata, ordinal)."""
    pieces = [(b, *r) for b in blocks for r in piece_ranges(b["text"], config.max_chars)]
    rows: list[dict] = []
    before = ""
    before_spans: list[dict] = []
    for ordinal, group in enumerate(packed([z - a for _, a, z in pieces], config)):
        base = GAP.join(pieces[i][0]["text"][pieces[i][1] : pieces[i][2]] for i in group)
        spans, at = [], 0
        for i in group:
            block, a, z = pieces[i]
            spans.append({"chunk_char_start": at, "chunk_char_end": at + z - a, "block_ordinal": block["ordinal"], "block_char_start": a, "block_char_end": z, "page": block["page"], "heading_path": list(block["heading_path"] or []), "kind": block["kind"], "source_metadata": block["metadata"], "is_overlap": False})
            at += z - a + len(GAP)
        shared = overlap_tail(before, config.overlap_chars)
        if shared and (room := config.max_chars - len(base) - len(GAP)) < len(shared):
            shared = overlap_tail(shared, room)
        shift = len(shared) + len(GAP) if shared else 0
        own = clipped(before_spans, len(before) - len(shared), len(before), 0, True) if shared else []
        own += clipped(spans, 0, len(base), shift, False)
        text = shared + GAP + base if shared else base
        rows.append(
            {
                "document_id": document_id,
                "chunk_id": hashlib.sha256(f"{document_id}\0{ordinal}\0{text}".encode()).hexdigest()[:32],
                "ordinal": ordinal,
                "text": text,
                "char_count": len(text),
                "pages": sorted({s["page"] for s in own if s["page"] is not None}),
                "heading_path": next((s["heading_path"] for s in own if s["heading_path"]), []),
                "kinds": sorted({s["kind"] for s in own}),
                "has_overlap": bool(shared),
                "source_metadata": list(dict.fromkeys(s["source_metadata"] for s in own if s["source_metadata"] not in (None, "", "{}"))),
                "source_spans": own,
            }
        )
        before, before_spans = base, spans
    return rows


def clipped(spans: list[dict], start: int, end: int, offset: int, overlap: bool) -> list[dict]:
    """Spans cut to [start, end) of the text they are of, counted from offset."""
    out = []
    for s in spans:
        a, z = max(start, s["chunk_char_start"]), min(end, s["chunk_char_end"])
        if a < z:
            skip = a - s["chunk_char_start"]
            out.append(s | {"chunk_char_start": a - start + offset, "chunk_char_end": z - start + offset, "block_char_start": s["block_char_start"] + skip, "block_char_end": s["block_char_start"] + skip + z - a, "is_overlap": overlap})
    return out


def strip_ranges(text: str, config: Refinement = Refinement()) -> list[tuple[int, int]]:
    """Ranges of knowledge strips: up to so many sentences and characters (gaps included), never across a blank line between sentences."""
    sentences, begin = [], 0
    edges = [(m.start(), m.end()) for m in STRIP_SENTENCE.finditer(text)] + [(len(text), len(text))]
    limit = config.strip_max_chars
    for stop, after in edges:
        at, stop = trimmed(text, begin, stop)
        while stop - at > limit:
            space = text.rfind(" ", at + limit // 2, at + limit + 1)
            cut = space if space > at else at + limit
            a, z = trimmed(text, at, cut)
            if a < z:
                sentences.append((a, z))
            at = trimmed(text, cut, stop)[0]
        if at < stop:
            sentences.append((at, stop))
        begin = after
    out: list[tuple[int, int]] = []
    held = 0
    for a, z in sentences:
        if out and held < config.strip_max_sentences and z - out[-1][0] <= limit and GAP not in text[out[-1][1] : a]:
            out[-1] = (out[-1][0], z)
            held += 1
        else:
            out.append((a, z))
            held = 1
    return out


def chunks(blocks: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """CHUNK rows of a blocks table; a document's blocks are gathered, which are bounded by its file's size."""
    item = F.struct("ordinal", "text", "kind", "page", "heading_path", F.col("metadata"))
    docs = blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("blocks"))
    return docs.mapInArrow(_chunker(config), CHUNK)


def _chunker(config: Chunking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for document_id, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += chunk_document(document_id, blocks, config)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow())

    return run


def _arrow() -> pa.Schema:
    text_list, ints = pa.list_(pa.string()), pa.list_(pa.int32())
    i, s, b = pa.int32(), pa.string(), pa.bool_()
    span = pa.struct([("chunk_char_start", i), ("chunk_char_end", i), ("block_ordinal", i), ("block_char_start", i), ("block_char_end", i), ("page", i), ("heading_path", text_list), ("kind", s), ("source_metadata", s), ("is_overlap", b)])
    return pa.schema([("document_id", s), ("chunk_id", s), ("ordinal", i), ("text", s), ("char_count", i), ("pages", ints), ("heading_path", text_list), ("kinds", text_list), ("has_overlap", b), ("source_metadata", text_list), ("source_spans", pa.list_(span))])


def strip_places(text: Column, config: Refinement = Refinement()) -> Column:
    """start and end of each strip of a text, as an array."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @arrow_udf("array<struct<start:int,end:int>>")
    def run(texts: pa.Array) -> pa.Array:
        return by_slices(texts, lambda part: pa.array([[{"start": a, "end": z} for a, z in strip_ranges(t or "", config)] for t in part], kind))

    return run(text)


def strips(rows: DataFrame, key: str, text: str = "text", config: Refinement = Refinement()) -> DataFrame:
    """key, start, end, strip of each strip of each row's text."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(k, a, z, t[a:z]) for a, z in strip_ranges(t or "", config)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], [key, "start", "end", "strip"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, start int, end int, strip string")
