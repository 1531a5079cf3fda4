"""Passages of `window` words or more that repeat anywhere in the corpus, by compressed FM-indexes of shards.

Words are unchanged runs of non-space bytes; a window is `window` consecutive words of one document. A window repeats if its word sequence
starts somewhere else too, in the same document or another.

1. Anchors. Each window is known by one of the runs of `gram` words in it: that of the smallest hash, the leftmost of equal ones. Equal windows
   have equal anchors, so a window whose anchor stands once in the corpus does not repeat. Anchors are counted over all documents (8 bytes
   each; equal ones first within each task).
2. Segments. Consecutive windows with one anchor form a segment of window to 2 window - gram words. Documents are dealt into blocks; each
   block gets back those of its anchors that repeat, and sends its distinct segments around them, with the number of times each stands there, to
   shards by anchor. Copies of a text are thus one segment each block.
3. Index. A shard builds an FM-index of its distinct segments: suffixes sorted as deep as a window needs, the Burrows-Wheeler transform
   as runs of equal symbols, one symbol a run in a wavelet matrix of packed bits. Segments are then streamed against it by backward search, all at once: the interval of rows that match the
   last window - 1 words is stretched by one word to the left, whose weight (how often its rows' segments stand in the corpus) tells
   whether the window repeats, and cut back on the right to window - 1 words, and so on. That is the matching statistics of the segment, cut
   off at the threshold.
4. Blocks get the result for each of their segments and mark the covered words.

Word sequences are compared by 64-bit hashes of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, free_shuffles, keyed, short_batches, written
from .words import U, arrow_slices, find_words, mixed, shingles

WINDOW, GRAM = 35, 8


class WaveletMatrix:
    """Rank of symbols (0 <= symbol < sigma) in a sequence; a bit a level, 64 to a word, with a running count a word."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.n = len(sequence)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.sums, self.zeros = [], [], []
        now = sequence.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(64 + -self.n % 64, bool)), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.uint32)
            self.bits.append(packed)
            self.sums.append(np.cumsum(ones, dtype=np.uint32) - ones)
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where position i stands after all levels, following the symbol: rank(symbol, i) plus a constant of the symbol; and whether the
        symbol stands at i."""
        there = np.ones(len(i), bool)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word, bit = i >> 6, (i & 63).astype(U)
            bits = self.bits[k][word]
            one = self.sums[k][word].astype(np.int64) + np.bitwise_count(bits & ((U(1) << bit) - U(1)))
            right = ((symbol >> level) & 1).astype(bool)
            there &= right == ((bits >> bit) & U(1)).astype(bool)
            i = np.where(right, self.zeros[k] + one, i - one)
        return i, there

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.bits + self.sums)


class RunLengths:
    """A sequence as its runs of equal symbols: their symbols in a wavelet matrix, their starts, and the sums of their lengths by symbol."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        n = len(sequence)
        new = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), sequence[1:] != sequence[:-1]]))
        heads = sequence[new]
        self.starts = np.append(new, n).astype(np.uint32)
        self.heads = WaveletMatrix(heads, sigma)
        lengths = np.diff(np.append(new, n))[np.argsort(heads, kind="stable")]
        self.before = np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint32)
        counts = np.bincount(heads, minlength=sigma)
        every = np.arange(sigma)
        self.base = np.cumsum(counts) - counts - self.heads.place(every, np.zeros(sigma, np.int64))[0]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many symbols are smaller, anywhere, or equal and before position i."""
        run = np.searchsorted(self.starts, i.astype(np.uint32), "right") - 1
        place, there = self.heads.place(symbol, run)
        return self.before[place + self.base[symbol]].astype(np.int64) + np.where(there, i - self.starts[run], 0)

    @property
    def nbytes(self) -> int:
        return self.starts.nbytes + self.heads.nbytes + self.before.nbytes + self.base.nbytes


class FMIndex:
    """Of texts of symbols above 0, each ended by a 0, with a weight a position. Patterns may have up to `depth` symbols. Kept in proportion to
    runs, not to positions: the transform as runs, weights where they are not 1, and the bounds of groups of rows."""

    def __init__(self, text: np.ndarray, weights: np.ndarray, depth: int):
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.depth, span, ranks = depth, 1, {1: rank}
        while span < depth:  # sort suffixes by twice as many symbols each round; equal ones stay in text order
            ahead = np.zeros(n, np.int64)
            ahead[:-span] = rank[span:] + 1
            key = rank * (n + 1) + ahead
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
            span *= 2
            ranks[span] = rank.astype(np.int32 if n < 1 << 31 else np.int64)
        order = np.argsort(rank, kind="stable")
        self.symbols = int(text.max()) + 1 if n else 1
        self.transform = RunLengths(text[order - 1], self.symbols)
        heavy = np.flatnonzero(weights[order] != 1)
        self.heavy = heavy.astype(np.uint32)
        self.extra = np.concatenate([[0], np.cumsum(weights[order[heavy]].astype(np.int64) - 1)])
        self.n = n
        # Rows whose suffixes agree in their first depth - 1 symbols are a group; a match is cut back to its group's bounds.
        same = np.ones(n, bool)
        same[0:1] = False
        at, left = order.copy(), depth - 1
        for span in sorted(ranks, reverse=True):
            while left >= span:
                r = np.where(at < n, ranks[span][np.minimum(at, n - 1)], -1)
                same[1:] &= r[1:] == r[:-1]
                at, left = at + span, left - span
        self.first = np.append(np.flatnonzero(~same), n).astype(np.uint32)

    @property
    def nbytes(self) -> int:
        return self.transform.nbytes + self.heavy.nbytes + self.extra.nbytes + self.first.nbytes

    def weight(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How often the rows from lo to hi stand in the corpus."""
        a, b = (self.extra[np.searchsorted(self.heavy, x.astype(np.uint32))] + x for x in (lo, hi))
        return b - a

    def stretch(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows that match a symbol and then what [lo, hi) match."""
        both = self.transform.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return both[: len(lo)], both[len(lo) :]

    def cut(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that match all but the last of depth symbols that [lo, hi) match."""
        after = np.minimum(np.searchsorted(self.first, lo.astype(np.uint32), "right"), len(self.first) - 1)
        some = hi > lo
        return np.where(some, self.first[after - 1], lo).astype(np.int64), np.where(some, self.first[after], hi).astype(np.int64)

    def repeats(self, texts: np.ndarray, starts: np.ndarray, lens: np.ndarray, least: int = 2) -> list[np.ndarray]:
        """Of each text: the places where a run of depth symbols starts that has a weight of least in the index (0: unknown symbol)."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lens)
        order = np.argsort(-lens, kind="stable")
        ends, sizes = (starts + lens)[order], lens[order]
        lo, hi = np.zeros(len(lens), np.int64), np.full(len(lens), self.n)
        hit_text, hit_place = [], []
        for k in range(int(lens.max()) if len(lens) else 0):
            live = int(np.searchsorted(-sizes, -k, "left"))
            symbol = texts[ends[:live] - 1 - k]
            lo, hi = self.stretch(lo[:live], hi[:live], symbol)
            hi = np.where(symbol == 0, lo, hi)
            if k >= self.depth - 1:
                good = np.flatnonzero(self.weight(lo, hi) >= least)
                hit_text.append(order[good])
                hit_place.append(sizes[good] - 1 - k)
                lo, hi = self.cut(lo, hi)
        if hit_text:
            t, p = np.concatenate(hit_text), np.concatenate(hit_place)
            by = np.lexsort((p, t))
            t, p = t[by], p[by]
            marks = np.searchsorted(t, np.arange(len(lens) + 1))
            out = [p[a:b] for a, b in zip(marks, marks[1:], strict=False)]
        return out


# -- anchors and segments --


def _anchors(w, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, the first word of its anchor, and the hash of the run of gram words at each word (0 where none)."""
    n = len(w.hashes)
    h, first = shingles(w, gram)
    m = n - window + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, U)
    every = np.full(n, np.iinfo(np.uint64).max, U)
    every[first] = h
    wide = window - gram + 1
    best, arg, span = every, np.arange(n), 1
    while span * 2 <= wide:
        better = best[span:] < best[:-span]
        arg = np.where(better, arg[span:], arg[:-span])
        best = np.where(better, best[span:], best[:-span])
        span *= 2
    if rest := wide - span:
        better = best[rest:] < best[:-rest]
        arg = np.where(better, arg[rest:], arg[:-rest])
    starts = np.flatnonzero(w.text[:m] == w.text[window - 1 : window - 1 + m])
    return starts, arg[starts], every


def _segments(w, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and anchor hash of each segment."""
    starts, anchor, every = _anchors(w, window, gram)
    if not len(starts):
        return starts, starts, np.zeros(0, U)
    new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(anchor) != 0)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    return starts[first], count + window - 1, every[anchor[first]]


def _hash_runs(w, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A hash of each run of words."""
    if not len(starts):
        return np.zeros(0, U)
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    factor = mixed(np.arange(1, int(lens.max()) + 1).astype(U)) | U(1)
    return mixed(np.add.reduceat(w.hashes[np.repeat(starts, lens) + place] * factor[place], at) + lens.astype(U))


def _count_anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(batch.schema.get_field_index("block")).to_numpy()
            for lo, _, data, offsets in arrow_slices(batch):
                w = find_words(data, offsets)
                first, _, h = _segments(w, window, gram)
                if not len(first):
                    continue
                order = np.lexsort((block[lo + w.text[first]], h))
                h, b = h[order], block[lo + w.text[first]][order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(b[new].astype(np.int32)), pa.array(np.diff(np.append(new, len(h))).astype(np.int32))], ["anchor", "block", "n"])

    return run


def _concat(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _send(window: int, gram: int, shards: int):
    """Of a block: its distinct segments around anchors that repeat."""
    names = ["shard", "block", "segment", "n", "words"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def run(key: tuple, docs: pa.Table, anchors: pa.Table) -> pa.Table:
        again = np.sort(anchors.column("anchor").to_numpy().view(U))
        rows: dict[int, list] = {}
        for batch in docs.combine_chunks().to_batches():
            for _, _, data, offsets in arrow_slices(batch):
                w = find_words(data, offsets)
                first, count, h = _segments(w, window, gram)
                if not len(first) or not len(again):
                    continue
                at = np.minimum(np.searchsorted(again, h), len(again) - 1)
                keep = again[at] == h
                first, count, h = first[keep], count[keep], h[keep]
                names_ = _hash_runs(w, first, count).view(np.int64).tolist()
                to = (mixed(h) % U(shards)).tolist()
                raw = w.data.tobytes()
                for a, c, s, t in zip(first.tolist(), count.tolist(), names_, to, strict=True):
                    if (row := rows.get(s)) is not None:
                        row[3] += 1
                    else:
                        rows[s] = [t, key[0].as_py(), s, 1, raw[w.starts[a] : w.ends[a + c - 1]]]
        columns = list(zip(*rows.values(), strict=True)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _search(window: int):
    """Of a shard: for each segment the starts of windows that repeat, as an offset each within it."""

    def run(table: pa.Table) -> pa.Table:
        segment, block, n = (table.column(c).to_numpy() for c in ("segment", "block", "n"))
        order = np.argsort(segment, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], segment[order][1:] != segment[order][:-1]]))
        weight = np.add.reduceat(n[order].astype(np.int64), first)
        of = np.empty(len(segment), np.int64)
        of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(segment))))
        data, offsets = _binary(table.column("words").take(pa.array(order[first])))
        w = find_words(data, offsets)
        symbol = np.unique(w.hashes, return_inverse=True)[1].astype(np.int64) + 1
        ends = np.cumsum(w.counts + 1)
        starts = ends - w.counts - 1
        text = np.zeros(int(ends[-1]), np.int64)
        text[np.arange(len(symbol)) + w.text] = symbol  # a 0 after each segment
        index = FMIndex(text, np.repeat(weight, w.counts + 1), window)
        found = index.repeats(text, starts, w.counts.astype(np.int64))
        bits = [x.astype(np.uint8).tobytes() for x in found]
        back = of.tolist()
        keep = np.array([len(bits[i]) > 0 for i in back], bool)
        return pa.table({"block": pa.array(block), "segment": pa.array(segment), "places": pa.array([bits[i] for i in back], pa.binary())}).filter(pa.array(keep))

    return run


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)


def _mark(window: int, gram: int, finish: Callable):
    """Of a block: which words of each text are covered by windows that repeat; finish makes the rows of them."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        segment = found.column("segment").to_numpy()
        order = np.argsort(segment)
        segment = segment[order]
        places = found.column("places").take(pa.array(order)).to_pylist()
        out = []
        for batch in docs.combine_chunks().to_batches():
            for lo, hi, data, offsets in arrow_slices(batch):
                w = find_words(data, offsets)
                change = np.zeros(len(w.hashes) + 1, np.int64)
                if len(segment):
                    first, count, _ = _segments(w, window, gram)
                    own = _hash_runs(w, first, count).view(np.int64)
                    at = np.minimum(np.searchsorted(segment, own), len(segment) - 1)
                    for i in np.flatnonzero(segment[at] == own).tolist():
                        begin = first[i] + np.frombuffer(places[at[i]], np.uint8).astype(np.int64)
                        change[begin] += 1
                        change[begin + window] -= 1
                covered = np.cumsum(change[:-1]) > 0
                out.append(finish(batch.slice(lo, hi - lo), w, covered))
        return pa.concat_tables(out) if out else finish(None, None, None)

    return run


def _digest(batch: pa.RecordBatch | None, w, covered) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    if batch is None:
        return schema.empty_table()
    removed = np.bincount(w.text, weights=covered, minlength=len(w.counts)).astype(np.int64)
    ends = np.cumsum(w.counts)
    raw, shas = w.data.tobytes(), []
    for t, (a, b) in enumerate(zip(w.bounds, w.bounds[1:], strict=False)):
        own = raw[a:b].split()
        if removed[t]:
            own = compress(own, (~covered[ends[t] - w.counts[t] : ends[t]]).tolist())
        shas.append(hashlib.sha256(b" ".join(own)).hexdigest())
    return pa.table([batch.column(batch.schema.get_field_index("doc_id")), pa.array(w.counts.astype(np.int64)), pa.array(removed), pa.array(shas)], schema=schema)


def _kept_text(batch: pa.RecordBatch | None, w, covered) -> pa.Table:
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("kept", pa.string())])
    if batch is None:
        return schema.empty_table()
    removed = np.bincount(w.text, weights=covered, minlength=len(w.counts)).astype(np.int64)
    ends = np.cumsum(w.counts)
    raw, texts = w.data.tobytes(), []
    touched = np.flatnonzero(removed)
    for t in touched:
        own = raw[w.bounds[t] : w.bounds[t + 1]].split()
        texts.append(b" ".join(compress(own, (~covered[ends[t] - w.counts[t] : ends[t]]).tolist())).decode("utf-8", "replace"))
    keys = [batch.column(batch.schema.get_field_index(c)).take(pa.array(touched)) for c in ("k1", "k2")]
    return pa.table([*keys, pa.array(texts, pa.string())], schema=schema)


def _covered(docs: DataFrame, window: int, gram: int, finish: Callable, schema: str) -> DataFrame:
    if not 1 <= gram <= window:
        raise ValueError("gram is 1 to window words")
    if 2 * (window - gram) + 1 > 256:
        raise ValueError("window - gram is at most 127")
    spark = docs.sparkSession
    short_batches(spark)
    d = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    blocks = block_count(d)
    dealt = d.withColumn("block", F.pmod("k1", F.lit(blocks)).cast("int"))
    seen = dealt.select("text", "block").mapInArrow(_count_anchors(window, gram), "anchor long, block int, n int")
    seen = seen.groupBy("anchor", "block").agg(F.sum("n").alias("n"))
    often = seen.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor")
    again = written(seen.join(often, "anchor").select("block", "anchor"), "anchors")
    free_shuffles(spark)
    rows = dealt.groupBy("block")
    sent = rows.cogroup(again.groupBy("block")).applyInArrow(_send(window, gram, blocks), "shard int, block int, segment long, n int, words binary")
    found = sent.groupBy("shard").applyInArrow(_search(window), "block int, segment long, places binary")
    return rows.cogroup(found.groupBy("block")).applyInArrow(_mark(window, gram, finish), schema)


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs: doc_id long, text string (null: no words). A row per row of docs: doc_id, n_words, n_removed (words covered by a window that
    repeats), kept_sha256 (of the other words, joined by one space). Rows alike are documents that repeat each other.
    """
    return _covered(docs, window, gram, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """k1, k2 (of common.keyed) and kept, the other words joined by one space, for each text that holds a window that repeats."""
    return _covered(docs, window, gram, _kept_text, "k1 long, k2 long, kept string").dropDuplicates(["k1", "k2"])
