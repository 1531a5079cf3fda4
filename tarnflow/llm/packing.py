"""Vector best-fit packing of documents into training sequences.

An item has three sizes: tokens, documents (1) and attention cost (tokens squared); a sequence has a capacity of each. Items go in decreasing
size to the open sequence, among those with room in every dimension, that the rule prefers: "norm" the smallest norm of what stays free,
"dot" the largest weighted dot product of sizes and free capacity. A new sequence opens if none has room.

Documents longer than the token capacity are cut: pieces of full length fill a sequence each, and the first piece is the shorter rest, which
is packed with the others. Pieces are written once, then dealt by hash into groups of bounded size, each packed by one task; a group costs at
most one sequence that a single packing would have saved. A piece's row number in its file is hashed too, so rows alike do not meet in one group.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, written
from .tokens import encoder

#: Pieces of a group, about.
GROUP = 8192


def pack(lengths: np.ndarray, tokens: int, documents: int, attention: float, rule: str = "norm", weights: tuple = (1.0, 1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each item, in the items' order. No item may be longer than tokens."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    n = len(lengths)
    capacity = np.array([tokens, documents, attention], float)
    if n and (lengths.max() > tokens or float(lengths.max()) ** 2 > attention or documents < 1):
        raise ValueError("an item is larger than a sequence")
    scale = np.asarray(weights, float) / capacity
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    free = np.empty((64, 3))
    number = np.empty(64, np.int64)
    open_, made = 0, 0
    least = int(lengths.min()) if n else 0
    for i in np.argsort(-lengths, kind="stable"):
        size = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        at = -1
        if open_:
            fits = np.flatnonzero((free[:open_] >= size).all(1))
            if len(fits):
                if rule == "norm":
                    at = fits[np.argmin((((free[fits] - size) * scale) ** 2).sum(1))]
                else:
                    at = fits[np.argmax((free[fits] * size * scale**2).sum(1))]
        if at < 0:
            if open_ == len(free):
                free, number = np.concatenate([free, np.empty_like(free)]), np.concatenate([number, np.empty_like(number)])
            at, open_ = open_, open_ + 1
            free[at], number[at] = capacity, made
            made += 1
        bins[i], offsets[i] = number[at], tokens - int(free[at, 0])
        free[at] -= size
        if free[at, 0] < least or free[at, 1] < 1:  # closed: the last open one takes its place
            open_ -= 1
            free[at], number[at] = free[open_], number[open_]
    return bins, offsets


def _pieces(path: str, end: int, tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % tokens or min(tokens, len(ids))
                cuts = [0, *range(first, len(ids) + 1, tokens)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _packer(tokens: int, documents: int, attention: float, rule: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = pack(table.column("length").to_numpy(), tokens, documents, attention, rule)
        return table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(offsets))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, tokens: int = 1024, documents: int = 1024, attention: float | None = None, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """docs: doc_id long, text string (null: empty). tokenizer: a file of the tokenizers library, at the same path on all executors.

    A row per piece: doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32 (of little-endian 32-bit ids), sequence_id,
    offset. The end id follows each document's ids, so an empty text is one token. attention: tokens squared unless given. Rows that
    share a doc_id, or have none, are documents of their own. Of sequences that the rule prefers alike any may take the
    item; items of a length go by doc_id, piece and ids_crc32. An empty table has no pieces. group: pieces that are packed together, about.
    """
    spark = docs.sparkSession
    short_batches(spark)
    attention = float(tokens) ** 2 if attention is None else attention
    d = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = written(d.mapInArrow(_pieces(tokenizer, end, tokens), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.col("_metadata.row_index")), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(_packer(tokens, documents, attention, rule), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
