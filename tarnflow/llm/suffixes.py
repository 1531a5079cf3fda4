"""Strings of `width` bytes that repeat anywhere in the corpus, by suffixes sorted in buckets.

Texts are UTF-8 bytes; a window is `width` consecutive bytes of one text. A window repeats if its bytes start somewhere else too, in the same text
or another.

1. Anchors. Of the runs of `gram` bytes in a window that of the smallest hash, the leftmost of equal ones, is its anchor. Equal windows have equal
   anchors in equal places, so a window whose anchor stands once in the corpus does not repeat. Anchors are counted over all texts.
2. Suffixes. Only suffixes that start at an anchor that repeats are sorted, one for about half of width - gram bytes of text: each carries the bytes from its anchor to the
   end of the last window that has this anchor, and those before it, read backwards, to the start of the first. Equal ones of a
   block of texts are one, with their number.
3. Buckets. Spark samples splitters of the suffixes' leading bytes (then those before the anchor, then the block) and range-partitions by them, so
   suffixes with any common beginning may be cut between buckets wherever that balances them. A bucket sorts its suffixes, forward and backward, by
   multikey quicksort. A window with d bytes before its anchor repeats if another suffix shares its width - d bytes after the anchor and its d before: both
   are classes of neighbours in a sorted order, found from common prefix lengths.
4. Boundaries. A class that reaches beyond a bucket is its first or its last one at that depth. Windows of these classes are told by a 64-bit hash
   and their number, and those of all buckets are compared.
5. Blocks get the windows that repeat for each of their suffixes and mark the covered bytes.

Anchors and suffixes of a block are told apart by 64-bit hashes, windows within buckets by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, block_count, drop, free_shuffles, keyed, short_batches, written
from .words import U, arrow_slices, mixed

WIDTH, GRAM = 200, 48
#: A longer text is read in pieces of so many window starts.
PIECE = 4_000_000
BUCKET_BYTES = 6_000_000
_BASE = 0x9E3779B97F4A7C15
_BYTES = mixed(np.arange(1, 257).astype(U))
_HIGH = U(0xFFFFFFFF00000000)


class Sums:
    """Hashes of any span of some bytes, from running sums of a polynomial modulo 2 ** 64 with an odd base."""

    _powers = _inverses = np.zeros(0, U)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Sums._powers) <= n:
            size = max(n + 1, 1 << 20)
            Sums._powers = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size, _BASE, U)]))
            Sums._inverses = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size, pow(_BASE, -1, 1 << 64), U)]))
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTES[data] * Sums._powers[:n], dtype=U)])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * Sums._inverses[starts] + (ends - starts).astype(U))

    def runs(self, length: int) -> np.ndarray:
        """Of each run of length bytes."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * Sums._inverses[:n] + U(length))


def _suffixes(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Sums | None]:
    """Of texts: first window of each suffix, its number of windows, its anchor, the anchor's hash."""
    n, none = len(data), np.zeros(0, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= width)
    if not len(long):
        return none, none, none, np.zeros(0, U), None
    change = np.zeros(n + 1, np.int8)
    change[offsets[long]] += 1
    change[offsets[long + 1] - width + 1] -= 1
    starts = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))
    sums = Sums(data)
    grams = sums.runs(gram)
    # Hash above, place below: one minimum finds the smallest hash and the leftmost of equal ones. Windows lie within a text, so their grams do.
    best, span, wide = (grams & _HIGH) | np.arange(len(grams)).astype(U), 1, width - gram + 1
    while span * 2 <= wide:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if rest := wide - span:
        best = np.minimum(best[:-rest], best[rest:])
    anchor = (best[starts] & ~_HIGH).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(anchor) != 0)]))
    return starts[new], np.diff(np.append(new, len(starts))), anchor[new], grams[anchor[new]], sums


def _pieces(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in data, bytes, offsets) of texts; a very long one comes in pieces that share width - 1 bytes."""
    n = len(data)
    if len(offsets) > 2 or n <= PIECE + width:
        yield 0, data, offsets
        return
    for a in range(0, n - width + 1, PIECE):
        piece = data[a : a + PIECE + width - 1]
        yield a, piece, np.array([0, len(piece)])


def _count_anchors(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(batch.schema.get_field_index("block")).to_numpy()
            for lo, _, data, offsets in arrow_slices(batch):
                own = data[offsets[0] : offsets[-1]]
                for _, piece, bounds in _pieces(own, offsets - offsets[0], width):
                    first, _, _, h, _ = _suffixes(piece, bounds, width, gram)
                    if not len(first):
                        continue
                    b = block[lo + np.searchsorted(bounds, first, "right") - 1] if len(bounds) > 2 else np.full(len(h), block[lo])
                    order = np.lexsort((b, h))
                    h, b = h[order], b[order]
                    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])]))
                    yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(b[new].astype(np.int32)), pa.array(np.diff(np.append(new, len(h))).astype(np.int32))], ["anchor", "block", "n"])

    return run


def _send(width: int, gram: int):
    """Of a block: its distinct suffixes at anchors that repeat."""
    names = ["block", "suffix", "n", "ahead", "behind"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(key: tuple, docs: pa.Table, anchors: pa.Table) -> pa.Table:
        again, rows = np.sort(anchors.column("anchor").to_numpy().view(U)), {}
        for batch in docs.combine_chunks().to_batches() if len(again) else []:
            for _, _, data, offsets in arrow_slices(batch):
                own = data[offsets[0] : offsets[-1]]
                for _, piece, bounds in _pieces(own, offsets - offsets[0], width):
                    first, count, anchor, h, sums = _suffixes(piece, bounds, width, gram)
                    if not len(first):
                        continue
                    keep = again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h
                    first, count, anchor = first[keep], count[keep], anchor[keep]
                    ends = first + count - 1 + width
                    names_, at, n = np.unique(sums.spans(first, ends).view(np.int64), return_index=True, return_counts=True)
                    raw = piece.tobytes()
                    for s, a, p, e, k in zip(names_.tolist(), first[at].tolist(), anchor[at].tolist(), ends[at].tolist(), n.tolist(), strict=True):
                        if (row := rows.get(s)) is not None:
                            row[2] += k
                        else:
                            rows[s] = [key[0].as_py(), s, k, raw[p:e], raw[a:p][::-1]]
        columns = list(zip(*rows.values(), strict=True)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


# -- a bucket --


def packed(strings: list[bytes], width: int) -> np.ndarray:
    """A row a string: its bytes, padded with zeros, as big-endian 64-bit words."""
    words = -(-width // 8)
    return np.frombuffer(b"".join(s.ljust(8 * words, b"\0") for s in strings), ">u8").astype(U).reshape(len(strings), words)


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of rows of words. Each group of rows that agree so far is split at a pivot's word into smaller, equal and larger; equal ones go on to the next
    word. All groups are split at once, round after round."""
    n, words = keys.shape
    order, group, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.arange(n) if n > 1 and words else np.zeros(0, np.int64)
    while len(live):
        # live: places still in groups of two or more, group by group; group: the first place of its group; depth: the word that is looked at.
        own = group[live]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(np.append(head, len(live)))
        word = keys[order[live], depth[live]]
        # The pivot: the middle one of the words at the group's first, middle and last places.
        three = np.sort(np.stack([word[head], word[head + size // 2], word[head + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        side = (word > pivot).astype(np.int8) - (word < pivot)
        by = np.lexsort((side, np.repeat(np.arange(len(head)), size)))
        order[live], side = order[live][by], side[by]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (side[1:] != side[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(live)))
        group[live] = np.repeat(live[first], size)
        depth[live] += side == 0
        live = live[(np.repeat(size, size) > 1) & (depth[live] < words)]
    return order


def common_prefixes(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order shares with the one before it (the first: -1)."""
    out = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        differ = keys[order[1:]] ^ keys[order[:-1]]
        word = np.argmax(differ != 0, axis=1)
        bits = differ[np.arange(len(differ)), word]
        out[1:] = np.where(bits == 0, 8 * keys.shape[1], 8 * word + _zero_bytes(bits))
    return out


def _zero_bytes(words: np.ndarray) -> np.ndarray:
    """Leading zero bytes of words."""
    left = np.zeros(len(words), np.int64)
    for k in range(1, 8):
        left += words < (U(1) << U(64 - 8 * k))
    return left


class Classes:
    """Sorted rows; at a depth, rows are of one class if they share so many leading bytes."""

    def __init__(self, strings: list[bytes], width: int):
        keys = packed(strings, width)
        self.order = multikey_quicksort(keys)
        self.shared = common_prefixes(keys, self.order)

    def at(self, depth: int) -> np.ndarray:
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.shared < depth) - 1
        return out


def repeating(ahead: list[bytes], behind: list[bytes], n: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct suffixes with their numbers: for each window (by its place in the suffix) whether it repeats among them, and whether its bytes after the
    anchor are of the first or last class at their depth."""
    m, wide = len(n), width - gram + 1
    found, edge = np.zeros((m, wide), bool), np.zeros((m, wide), bool)
    if not m:
        return found, edge
    forward = Classes(ahead, width)
    after, before = np.array([len(x) for x in ahead]), np.array([len(x) for x in behind])
    windows = after + before - width + 1
    found[n > 1] = np.arange(wide) < windows[n > 1, None]
    # Suffixes that share their anchor with another.
    anchors = forward.at(gram)
    many = np.bincount(anchors)[anchors] > 1
    own = np.flatnonzero(many)
    backward = Classes([behind[i] for i in own], width) if len(own) else None
    rank = np.empty(m, np.int64)
    rank[own] = np.arange(len(own))
    for d in range(wide):
        fits = (before >= d) & (after >= width - d)
        i = np.flatnonzero(fits)
        if not len(i):
            continue
        right = forward.at(width - d)
        edge[i, before[i] - d] = (right[i] == 0) | (right[i] == right.max())
        i = i[many[i]]
        if len(i) < 2:
            continue
        pair = right[i] * m + backward.at(d)[rank[i]]
        order = np.argsort(pair, kind="stable")
        twin = pair[order][1:] == pair[order][:-1]
        hit = np.concatenate([twin, [False]]) | np.concatenate([[False], twin])
        found[i[order[hit]], before[i[order[hit]]] - d] = True
    return found, edge & (np.arange(wide) < windows[:, None])


_SORTED = pa.schema([("block", pa.int32()), ("suffix", pa.int64()), ("places", pa.binary()), ("window", pa.int64()), ("n", pa.int64()), ("place", pa.int32())])
_SORTED_SQL = "block int, suffix long, places binary, window long, n long, place int"


def _sort(width: int, gram: int):
    """A bucket. Rows with places: windows that repeat in it, a bit each. Rows with window: a window of an outer class, with its number; if not yet known
    to repeat, with its block, suffix and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (own := [b for b in batches if b.num_rows]):
            return
        table = pa.Table.from_batches(own)
        block, suffix, n = (table.column(c).to_numpy() for c in ("block", "suffix", "n"))
        ahead, behind = table.column("ahead").to_pylist(), table.column("behind").to_pylist()
        order = np.argsort(suffix, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], suffix[order][1:] != suffix[order][:-1]]))
        rows = np.diff(np.append(head, len(order)))
        number = np.add.reduceat(n[order].astype(np.int64), head)
        ahead, behind = [ahead[i] for i in order[head]], [behind[i] for i in order[head]]
        found, edge = repeating(ahead, behind, number, width, gram)
        bits = np.packbits(found, axis=1)
        some = np.flatnonzero(found.any(axis=1))
        out_rows = np.concatenate([order[head[i] : head[i] + rows[i]] for i in some]) if len(some) else np.zeros(0, np.int64)
        of = np.repeat(some, rows[some])
        none = lambda k, t: pa.nulls(k, t)
        for a in range(0, len(of), 10_000):
            o, r = of[a : a + 10_000], out_rows[a : a + 10_000]
            places = pa.array([bits[i].tobytes() for i in o.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(block[r]), pa.array(suffix[r]), places, none(len(r), pa.int64()), none(len(r), pa.int64()), none(len(r), pa.int32())], schema=_SORTED)
        outer = np.flatnonzero(edge.any(axis=1))
        for a in range(0, len(outer), 2_000):
            own = outer[a : a + 2_000]
            joined = [behind[i][::-1] + ahead[i] for i in own.tolist()]
            starts = np.cumsum([0] + [len(x) for x in joined])[:-1]
            i, place = np.nonzero(edge[own])
            at = starts[i] + place
            hashes = Sums(np.frombuffer(b"".join(joined), np.uint8)).spans(at, at + width).view(np.int64)
            i = own[i]
            known = found[i, place]
            row = order[head[i]]
            yield pa.RecordBatch.from_arrays([pa.array(block[row], mask=known), pa.array(suffix[row], mask=known), none(len(i), pa.binary()), pa.array(hashes), pa.array(number[i]), pa.array(place.astype(np.int32), mask=known)], schema=_SORTED)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def _mark(width: int, gram: int):
    """Of a block: the bytes of each text that windows that repeat cover."""
    wide = width - gram + 1

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        names, of = np.unique(found.column("suffix").to_numpy(), return_inverse=True)
        bits = np.zeros((len(names), wide), bool)
        known = found.column("places").to_pylist()
        whole = [k for k, x in enumerate(known) if x is not None]
        if whole:
            own = np.frombuffer(b"".join(known[k] for k in whole), np.uint8).reshape(len(whole), -1)
            np.logical_or.at(bits, of[whole], np.unpackbits(own, axis=1, count=wide).astype(bool))
        single = np.array([k for k, x in enumerate(known) if x is None], np.int64)
        if len(single):
            bits[of[single], found.column("place").fill_null(0).to_numpy()[single]] = True
        out = []
        for batch in docs.combine_chunks().to_batches():
            doc_id = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, data, offsets in arrow_slices(batch):
                own, bounds = data[offsets[0] : offsets[-1]], offsets - offsets[0]
                covered = np.zeros(len(own), bool)
                for place, piece, inner in _pieces(own, bounds, width) if len(names) else []:
                    first, count, _, _, sums = _suffixes(piece, inner, width, gram)
                    if not len(first):
                        continue
                    h = sums.spans(first, first + count - 1 + width).view(np.int64)
                    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                    hit = np.flatnonzero(names[at] == h)
                    i, k = np.nonzero(bits[at[hit]])
                    begins = np.zeros(len(piece) + 1, np.int32)
                    begins[first[hit[i]] + k + 1] = 1
                    begins = np.cumsum(begins, dtype=np.int32)
                    now = begins[1:] > 0
                    now[width:] = begins[width + 1 :] > begins[1:-width]
                    covered[place : place + len(piece)] |= now
                out.append(_rows(doc_id.slice(lo, hi - lo), own, bounds, covered))
        return pa.concat_tables(out) if out else _RESULT.empty_table()

    return run


def _rows(doc_id: pa.Array, data: np.ndarray, bounds: np.ndarray, covered: np.ndarray) -> pa.Table:
    """Spans do not cross texts: a text's first byte begins one of its own."""
    n, raw, removed, shas, spans = np.diff(bounds), data.tobytes(), [], [], []
    total = np.concatenate([[0], np.cumsum(covered)])
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        k = int(total[b] - total[a])
        removed.append(k)
        if not k:
            shas.append(hashlib.sha256(raw[a:b]).hexdigest())
            spans.append([])
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered[a:b], [False]]).astype(np.int8)))
        spans.append(edges)
        shas.append(hashlib.sha256(data[a:b][~covered[a:b]].tobytes()).hexdigest())
    counts = [len(x) // 2 for x in spans]
    return pa.table([doc_id, pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas), pa.array(spans, _RESULT.field("spans").type)], schema=_RESULT)


def repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs: doc_id long, text string (null: no bytes); other columns are left alone. A row per row of docs: doc_id, n_bytes, n_removed (bytes covered by
    a window that repeats), n_spans, kept_sha256 (of the other bytes, in order), spans (start and end of each maximal removed run).

    Rows alike are texts that repeat each other; those of which there are very many (one in HOT_SHARE) enter the search once and get their result
    without it. Ties of hashes of equal bytes fall to the leftmost. A text shorter than width keeps all its bytes. No rows: no rows.
    """
    if not 8 <= gram <= width or width - gram > 255:
        raise ValueError("gram is 8 to width bytes, and width - gram at most 255")
    spark = docs.sparkSession
    short_batches(spark)
    d = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    blocks = block_count(d)
    # Rows alike share their block; where they are many, one of them stands for all.
    counts = d.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1")
    total = docs.count()
    hot = [r["k1"] for r in counts.where(F.col("n") * HOT_SHARE > max(total, HOT_SHARE)).select("k1").collect()]
    alike = None
    if hot:
        is_hot = F.col("k1").isin(hot)
        size = F.octet_length("text").cast("long")
        gone = F.when(size >= width, size).otherwise(F.lit(0).cast("long"))
        alike = d.where(is_hot).select("doc_id", size.alias("n_bytes"), gone.alias("n_removed"), F.when(gone > 0, 1).otherwise(0).cast("long").alias("n_spans"), F.sha2(F.when(gone > 0, "").otherwise(F.col("text")), 256).alias("kept_sha256"), F.when(gone > 0, F.array(F.lit(0).cast("long"), size)).otherwise(F.array().cast("array<long>")).alias("spans"))
        one = d.where(is_hot).groupBy("k1", "k2").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", "k1", "k2", F.lit(True).alias("stand_in"))
        d = d.where(~is_hot).withColumn("stand_in", F.lit(False)).unionByName(one)
    else:
        d = d.withColumn("stand_in", F.lit(False))
    dealt = d.select("doc_id", "text", "stand_in", F.pmod("k1", F.lit(blocks)).cast("int").alias("block"))
    seen = dealt.select("text", "block").mapInArrow(_count_anchors(width, gram), "anchor long, block int, n int")
    seen = written(seen.groupBy("anchor", "block").agg(F.sum("n").alias("n")), "seen")
    often = seen.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor")
    again = written(seen.join(often, "anchor").select("block", "anchor"), "anchors")
    drop(seen)
    del seen, often
    free_shuffles(spark)
    sent = dealt.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(_send(width, gram), "block int, suffix long, n int, ahead binary, behind binary")
    sent = written(sent, "suffixes")
    drop(again)
    del again
    free_shuffles(spark)
    size = sent.agg(F.sum(F.octet_length("ahead") + F.octet_length("behind")).alias("b")).first()["b"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    ordered = sent.repartitionByRange(buckets, "ahead", "behind", "block").select("block", "suffix", "n", "ahead", "behind")
    found = written(ordered.mapInArrow(_sort(width, gram), _SORTED_SQL), "windows")
    drop(sent)
    del sent, ordered
    free_shuffles(spark)
    # Windows that more than one bucket may hold.
    outer = found.where("window IS NOT NULL")
    twice = outer.groupBy("window").agg(F.sum("n").alias("total")).where("total > 1").select("window")
    late = outer.where("suffix IS NOT NULL").join(twice, "window").select("block", "suffix", F.lit(None).cast("binary").alias("places"), "place")
    found = found.where("places IS NOT NULL").select("block", "suffix", "places", F.lit(None).cast("int").alias("place")).unionByName(late)
    marked = dealt.where(~F.col("stand_in")).drop("stand_in").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_mark(width, gram), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    return marked.unionByName(alike) if alike is not None else marked
