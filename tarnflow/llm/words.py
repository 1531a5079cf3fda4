"""Vectorised words, word hashes and shingles of a column of texts.

A word is a maximal run of bytes other than space and \\x09-\\x0D, so words are found in UTF-8 without decoding.
Hashes are 64 bit; all functions work on slices of bounded size, whole texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SLICE_BYTES = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes: eight bytes at a time; spans over _LONG bytes one by one."""
    lens = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    h = mixed((lanes[starts] & _MASKS[np.minimum(lens, 8)]) + lens.astype(U) * U(0x9E3779B97F4A7C15))
    rest = np.flatnonzero(lens > 8)
    at = 8
    while len(rest) and at < _LONG:
        left = lens[rest] - at
        h[rest] = mixed((h[rest] * U(0xD1342543DE82EF95)) ^ (lanes[starts[rest] + at] & _MASKS[np.minimum(left, 8)]))
        rest = rest[left > 8]
        at += 8
    for i in rest:
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


@dataclass
class Words:
    """Words of consecutive texts: byte spans within data, the text each is of, a hash each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray  # words of each text
    bounds: np.ndarray  # byte offsets of the texts within data


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about limit bytes at most (a longer text is a run of its own)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True) -> Words:
    bounds = offsets - offsets[0]
    data = data[offsets[0] : offsets[-1]]
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[1:-1][cuts]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    marks = np.searchsorted(starts, bounds)
    counts = np.diff(marks)
    text = np.repeat(np.arange(len(counts)), counts)
    h = _hashes(data, starts, ends) if hashes and len(starts) else np.zeros(0, U)
    return Words(data, starts, ends, text, h, counts, bounds)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of size words within a text, and the first word's index of each."""
    n = len(w.hashes)
    if n < size:
        return np.zeros(0, U), np.zeros(0, np.int64)
    m = n - size + 1
    whole = np.flatnonzero(w.text[:m] == w.text[size - 1 :])
    factor = U(0xD1342543DE82EF95)
    g = w.hashes[:m].copy()
    for j in range(1, size):  # a polynomial of mixed hashes
        g *= factor
        g += w.hashes[j : j + m]
    return mixed(g[whole]), whole


def arrow_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of bounded size."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    for lo, hi in slices(offsets):
        yield lo, hi, data, offsets[lo : hi + 1]
