"""Language-model scores by a probabilistic suffix tree over bytes, and by add-one word counts.

A text is its words, lower-cased (A-Z), with one space between and an end symbol after the last: a sequence of bytes. The tree's contexts are up to
`depth` bytes. Contexts are kept if they occur `least` times or more in training texts and their next-symbol distribution differs from
that of the context without its first byte: count times Kullback-Leibler divergence reaches `divergence` (in nats). Suffixes and
prefixes of kept contexts are kept too.
Distributions are smoothed by Witten-Bell: (count + kinds * parent's probability) / (total + kinds), down to a uniform one over 257 symbols.

A text's score is the sum of log10 probabilities of its symbols, each given the longest kept context that ends before it. Neither the contexts nor their
counts are bounded: they grow with the corpus. Runs (a context and the symbol after it) are dealt into buckets by the two bytes before the
symbol, so that a bucket has all of a context's suffixes of two bytes or more; the counts of shorter ones go to all. Buckets test contexts.
A model that measures MODEL_BYTES at most is broadcast and each block of texts looks its runs up; beyond, each block sends its distinct runs to
the buckets and gets their log probabilities back, in doubles. Both ways give the same scores to the last bit. Tree is the same model in one place, as an automaton.

Word counts are not broadcast either: each block's words meet their counts by a shuffle of hashes (64 bit), and each block gets the counts of
its own words back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, drop, free_shuffles, held_out, keyed, short_batches, written
from .words import U, arrow_slices, find_words

DEPTH, LEAST, DIVERGENCE = 5, 5, 5.0
END, START = 0, 32
PIECE = 256
_KEEP = 3_000_000
#: A model of kept contexts is broadcast up to this size (16 bytes a context and symbol).
MODEL_BYTES = 64_000_000


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts as the tree sees them, each after a space and with END as last; and the bounds of the texts in them."""
    w = find_words(data, offsets, lower=True, hashes=False)
    lens = w.ends - w.starts
    n_words = w.counts
    # Each word takes its bytes and one byte before it (a space); each text one more byte, the end.
    ends = np.cumsum(np.bincount(w.text, weights=lens + 1, minlength=len(n_words)).astype(np.int64) + (n_words == 0) + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, START, np.uint8)
    if len(lens):
        first = ends[w.text] - 1  # END's place; words are laid out before it
        total = np.cumsum(lens + 1)
        behind = np.repeat(total[np.cumsum(n_words)[n_words > 0] - 1], n_words[n_words > 0]) - total
        at = first - behind - lens
        inside = np.repeat(at - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        source = np.repeat(w.starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        out[inside] = np.maximum(w.data[source], 1)  # a zero byte would pass for END
    out[ends - 1] = END
    return out, np.concatenate([[0], ends])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _grams(depth: int):
    """Counts of runs of depth + 1 symbols, padded at a text's start: one row a distinct run and flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate([k for k, _ in kept]), np.concatenate([c for _, c in kept]))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "n"])

        for batch in batches:
            for _, _, data, offsets in arrow_slices(batch, "text"):
                stream, bounds = symbols(data, offsets)
                keys, counts = np.unique(_runs(stream, bounds, depth), return_counts=True)
                kept.append((keys, counts))
                size += len(keys)
                if size > _KEEP:
                    kept = [_summed(np.concatenate([k for k, _ in kept]), np.concatenate([c for _, c in kept]))]
                    size = len(kept[0][0])
                    if size > _KEEP // 2:
                        yield flush()
                        kept, size = [], 0
        if kept:
            yield flush()

    return run


def _runs(stream: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """The run of depth + 1 symbols that ends at each symbol of symbols() but the texts' first."""
    # A text begins after its first space; END of the text before stands for nothing earlier.
    g = np.zeros(len(stream), U)
    for j in range(depth, -1, -1):
        g <<= U(8)
        g[j:] |= stream[: len(stream) - j].astype(U) if j else stream.astype(U)
    return np.delete(_cut_at_start(g, bounds, depth), bounds[:-1])


def _cut_at_start(g: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """Leave out of each run what lies before its text's first symbol (zeros stand there, as END is never within a context)."""
    for back in range(depth):
        at = bounds[:-1] + back
        at = at[at < bounds[1:]]
        g[at] &= U((1 << 8 * (back + 1)) - 1)
    return g


def _levels(grams: np.ndarray, counts: np.ndarray, lengths: range, column: np.ndarray) -> list[tuple]:
    """By length of context: contexts, first row, totals, kinds, columns of next symbols, counts."""
    levels = []
    for length in lengths:
        keys = grams & U((1 << 8 * (length + 1)) - 1)
        if length:
            full = (keys >> U(8 * length)) > 0  # a shorter history has no context of this length
            k, c = _summed(keys[full], counts[full])
        else:
            k, c = _summed(keys, counts)
        context = k >> U(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(k) else np.zeros(0, np.int64)
        totals = np.add.reduceat(c, first) if len(k) else c
        kinds = np.diff(np.append(first, len(k)))
        levels.append((context[first], first, totals, kinds, column[(k & U(255)).astype(np.int64)], c))
    return levels


def _passing(level: tuple, parents: tuple, length: int, least: int, divergence: float) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of a level that pass both tests, and their gains."""
    context, first, totals, kinds, column, c = level
    up, up_first, up_totals, up_kinds, up_column, up_c = parents
    if not len(context):
        return np.zeros(0, U), np.zeros(0)
    parent = np.searchsorted(up, context & U((1 << 8 * (length - 1)) - 1)) if length > 1 else np.zeros(len(context), np.int64)
    row = np.repeat(np.arange(len(context)), kinds)
    up_key = np.repeat(np.arange(len(up)), up_kinds) * 512 + up_column
    at = np.searchsorted(up_key, parent[row] * 512 + column)
    p = c / totals[row]
    q = up_c[np.minimum(at, len(up_c) - 1)] / up_totals[parent[row]]
    gain = np.bincount(row, weights=c * np.log(p / q), minlength=len(context))
    good = (totals >= least) & (gain >= divergence)
    return context[good], gain[good]


class Tree:
    """The kept contexts as an automaton: next state and log10 probability by state and symbol."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, most: int | None = None):
        """grams: runs of depth + 1 symbols, the last in the lowest byte, zeros before a text's start."""
        alphabet = np.unique(grams & U(255)).astype(np.int64)
        self.column = np.full(256, len(alphabet), np.int64)  # symbols never seen share one column
        self.column[alphabet] = np.arange(len(alphabet))
        width = len(alphabet) + 2  # ... and one stands for no symbol at all
        self.width, self.none = width, width - 1
        levels = _levels(grams, counts, range(depth + 1), self.column)
        kept = self._kept(levels, depth, least, divergence, most)
        self._automaton(levels, kept, depth)

    @staticmethod
    def _kept(levels: list, depth: int, least: int, divergence: float, most: int | None) -> list[np.ndarray]:
        found = [_passing(levels[length], levels[length - 1], length, least, divergence) for length in range(1, depth + 1)]
        gains = np.concatenate([g for _, g in found])
        bar = np.partition(gains, -most)[-most] if most is not None and len(gains) > most else -np.inf
        sets = [np.zeros(0, U)] + [k[g >= bar] for k, g in found]
        for length in range(depth, 1, -1):  # every suffix and prefix too: the automaton needs both
            x = sets[length]
            sets[length - 1] = np.unique(np.concatenate([sets[length - 1], x & U((1 << 8 * (length - 1)) - 1), x >> U(8)]))
        kept = [np.zeros(1, U)]
        for length in range(1, depth + 1):
            x = np.unique(sets[length])
            near = kept[-1] if length > 1 else None
            good = np.isin(x, levels[length][0])
            if near is not None:
                good &= np.isin(x & U((1 << 8 * (length - 1)) - 1), near) & np.isin(x >> U(8), near)
            kept.append(x[good])
        return kept

    def _automaton(self, levels: list, kept: list[np.ndarray], depth: int) -> None:
        starts = np.cumsum([0] + [len(s) for s in kept])
        size, width = int(starts[-1]), self.width
        self.states = size
        step = np.zeros((size, width), np.int32)
        prob = np.empty((size, width))
        for length in range(depth + 1):
            context, first, totals, kinds, column, c = levels[length]
            own = kept[length]
            if not len(own):
                continue
            rows = slice(int(starts[length]), int(starts[length + 1]))
            if length:
                suffix = own & U((1 << 8 * (length - 1)) - 1)
                parent = int(starts[length - 1]) + (np.searchsorted(kept[length - 1], suffix) if length > 1 else np.zeros(len(own), np.int64))
                step[rows] = step[parent]
                below = prob[parent]
            else:
                below = np.full((1, width), 1 / 257)
            at = np.searchsorted(context, own) if length else np.zeros(1, np.int64)
            n, k = totals[at], kinds[at]
            here = np.zeros((len(own), width))
            inner = np.repeat(np.arange(len(own)), k)
            source = np.repeat(first[at] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            here[inner, column[source]] = c[source]
            prob[rows] = (here + k[:, None] * below) / (n + k)[:, None]
            if length < depth:
                longer = kept[length + 1]
                # own + symbol is a state of its own where it is kept
                if len(longer):
                    before = np.searchsorted(own, longer >> U(8)) if length else np.zeros(len(longer), np.int64)
                    step[rows.start + before, self.column[(longer & U(255)).astype(np.int64)]] = int(starts[length + 1]) + np.arange(len(longer))
        step[:, self.none] = 0
        step[:, self.column[END]] = 0
        logp = np.log10(prob)
        logp[:, self.none] = 0
        self.step, self.logp = step.ravel() * np.int32(width), logp.ravel().astype(np.float32)
        self.depth = depth

    def scores(self, stream: np.ndarray, bounds: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """log10 probability of each text of symbols(): all but its first symbol, the space it begins after."""
        code = np.append(self.column[stream], self.none)
        lens = np.diff(bounds) - 1
        parts = -(-lens // piece)
        text = np.repeat(np.arange(len(lens)), parts)
        k = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = bounds[:-1][text] + 1 + k * piece
        stop = np.minimum(start + piece, bounds[1:][text])
        state = np.zeros(len(text), np.int64)
        low = bounds[:-1][text]
        for j in range(self.depth, 0, -1):  # the symbols before give the state; before the text there is none
            at = start - j
            state = self.step[state + np.where(at >= low, code[np.maximum(at, 0)], self.none)]
        total, sums = np.zeros(len(text)), np.zeros(len(text))
        longest = int((stop - start).max()) if len(text) else 0
        order = np.argsort(start - stop, kind="stable")
        start, stop, state = start[order], stop[order], state[order]
        lens_left = stop - start
        for j in range(longest):
            n = int(np.searchsorted(-lens_left, -j, "left"))  # pieces longer than j
            at = state[:n] + code[start[:n] + j]
            sums[:n] += self.logp[at]
            state[:n] = self.step[at]
        total[order] = sums
        return np.bincount(text, weights=total, minlength=len(lens))


_SAME = np.arange(256)


def _gram_bucket(last, buckets: int):
    """The bucket of a context by its last two bytes, in numpy or in a column."""
    return last * 40503 % 65521 % buckets


def _with_bucket(rows: DataFrame, context, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", _gram_bucket(context.bitwiseAND(F.lit(0xFFFF)), buckets).cast("int"))


def _bucket_levels(short: tuple, grams: np.ndarray, counts: np.ndarray, depth: int) -> list[tuple]:
    """Levels of a bucket: the two shortest are of all runs."""
    return _levels(*short, range(min(depth, 1) + 1), _SAME) + _levels(grams, counts, range(2, depth + 1), _SAME)


def _bucket_contexts(shared: Broadcast, depth: int, least: int, divergence: float):
    """Contexts of a bucket that pass, and all that is within them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        levels = _bucket_levels(shared.value, table.column("gram").to_numpy().view(U), table.column("n").to_numpy(), depth)
        parts: list[list[np.ndarray]] = [[] for _ in range(depth + 1)]
        for length in range(1, depth + 1):
            good, _ = _passing(levels[length], levels[length - 1], length, least, divergence)
            for size in range(1, length + 1):
                parts[size] += [(good >> U(8 * back)) & U((1 << 8 * size) - 1) for back in range(length - size + 1)]
        sets = [np.unique(np.concatenate(x)) for x in parts[1:]]
        return pa.table({"context": pa.array(np.concatenate(sets).view(np.int64)), "length": pa.array(np.repeat(np.arange(1, depth + 1), [len(x) for x in sets]), pa.int32())})

    return run


def _log_probabilities(levels: list[tuple], kept: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    """log10 probability of each run's last symbol given the longest kept context before it."""
    p = np.full(len(grams), 1 / 257)
    for length, (context, _, totals, kinds, column, c) in enumerate(levels):
        if not len(context):
            continue
        before = (grams >> U(8)) & U((1 << 8 * length) - 1)
        own = np.flatnonzero(np.isin(before, kept[length])) if length else np.arange(len(grams))
        at = np.searchsorted(context, before[own])
        rows = np.repeat(np.arange(len(context)), kinds) * 256 + column
        wanted = at * 256 + (grams[own] & U(255)).astype(np.int64)
        place = np.minimum(np.searchsorted(rows, wanted), len(rows) - 1)
        count = np.where(rows[place] == wanted, c[place], 0)
        p[own] = (count + kinds[at] * p[own]) / (totals[at] + kinds[at])
    return np.log10(p)


def _bucket_scores(shared: Broadcast, depth: int):
    """Log probabilities of each block's runs of a bucket. model: counts of runs, and kept contexts with their length below zero for n."""

    def run(key: tuple, runs: pa.Table, model: pa.Table) -> pa.Table:
        short, ones = shared.value
        x, n = model.column("gram").to_numpy().view(U), model.column("n").to_numpy()
        levels = _bucket_levels(short, x[n > 0], n[n > 0], depth)
        kept = [np.zeros(1, U), ones] + [x[n == -length] for length in range(2, depth + 1)]
        grams = [np.frombuffer(b, U) for b in runs.column("grams").to_pylist()]
        every, inverse = np.unique(np.concatenate([np.zeros(0, U), *grams]), return_inverse=True)
        logs = _log_probabilities(levels, kept, every).astype("<f8")[inverse]
        marks = np.cumsum([0] + [len(g) for g in grams])
        return pa.table({"block": runs.column("block"), "bucket": runs.column("bucket"), "logs": pa.array([logs[a:z].tobytes() for a, z in zip(marks, marks[1:], strict=False)], pa.binary())})

    return run


def _table_runs(table: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of a block's texts, and the row of each."""
    grams, rows, base = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    for batch in table.combine_chunks().to_batches():
        for lo, hi, data, offsets in arrow_slices(batch):
            stream, bounds = symbols(data, offsets)
            grams.append(_runs(stream, bounds, depth))
            rows.append(base + lo + np.repeat(np.arange(hi - lo), np.diff(bounds) - 1))
        base += len(batch)
    return np.concatenate(grams), np.concatenate(rows)


def _dealt_runs(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct runs by bucket, and where each bucket begins."""
    to = _gram_bucket(((grams >> U(8)) & U(0xFFFF)).astype(np.int64), buckets)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(buckets + 1))


def _block_runs(depth: int, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        grams = np.unique(_table_runs(table, depth)[0])
        order, first = _dealt_runs(grams, buckets)
        grams = grams[order]
        used = np.flatnonzero(np.diff(first))
        return pa.table({"bucket": pa.array(used, pa.int32()), "block": pa.array([key[0].as_py()] * len(used), pa.int32()), "grams": pa.array([grams[first[b] : first[b + 1]].tobytes() for b in used], pa.binary())})

    return run


def _bucket_model(shared: Broadcast, depth: int):
    """length, row (context and symbol), n of the kept contexts of a bucket. Kept contexts stand in the table with their length below zero for n."""

    def run(table: pa.Table) -> pa.Table:
        x, n = table.column("gram").to_numpy().view(U), table.column("n").to_numpy()
        levels = _levels(x[n > 0], n[n > 0], range(2, depth + 1), _SAME)
        out = []
        for length, (context, _, _, kinds, column, c) in enumerate(levels, 2):
            good = np.repeat(np.isin(context, x[n == -length]), kinds)
            rows = (np.repeat(context, kinds) << U(8)) | column.astype(U)
            out.append(pa.table({"length": pa.array(np.full(int(good.sum()), length), pa.int32()), "row": pa.array(rows[good].view(np.int64)), "n": pa.array(c[good], pa.int64())}))
        return pa.concat_tables(out)

    return run


class Lookup:
    """Kept contexts by length: the probability of each context and symbol seen, and the count and kinds of symbols after each context."""

    def __init__(self, short: tuple[np.ndarray, np.ndarray], ones: np.ndarray, length: np.ndarray, row: np.ndarray, n: np.ndarray, depth: int):
        self.levels: list[tuple] = []
        below_rows, below = np.zeros(0, U), np.zeros(0)
        for size in range(depth + 1):
            if size < 2:
                rows, c = _summed(short[0] & U((1 << 8 * (size + 1)) - 1), short[1])
                if size:
                    good = np.isin(rows >> U(8), ones) & ((rows >> U(8)) > 0)
                    rows, c = rows[good], c[good]
            else:
                rows, c = _summed(row[length == size], n[length == size])
            context = rows >> U(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(rows) else np.zeros(0, np.int64)
            totals = np.add.reduceat(c, first) if len(rows) else c
            kinds = np.diff(np.append(first, len(rows)))
            up = below[np.searchsorted(below_rows, rows & U((1 << 8 * size) - 1))] if size else np.full(len(rows), 1 / 257)
            p = (c + np.repeat(kinds, kinds) * up) / np.repeat(totals + kinds, kinds)
            self.levels.append((rows, p, context[first], totals, kinds))
            below_rows, below = rows, p

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each run's last symbol given the longest kept context before it. Smoothed from the shortest context up by the same steps as
        _log_probabilities, so both give the same doubles.
        """
        p = np.full(len(grams), 1 / 257)
        left = np.arange(len(grams))
        above: list[tuple] = []
        for size in range(len(self.levels) - 1, -1, -1):
            rows, known, contexts, totals, kinds = self.levels[size]
            if not len(rows) or not len(left):
                continue
            x = grams[left] & U((1 << 8 * (size + 1)) - 1)
            at = np.minimum(np.searchsorted(rows, x), len(rows) - 1)
            hit = rows[at] == x
            p[left[hit]] = known[at[hit]]
            left, x = left[~hit], x[~hit] >> U(8)
            at = np.minimum(np.searchsorted(contexts, x), len(contexts) - 1)
            kept = contexts[at] == x
            above.append((left[kept], kinds[at[kept]], totals[at[kept]]))
        for own, kinds, totals in reversed(above):
            p[own] = kinds * p[own] / (totals + kinds)
        return np.log10(p)


def run_scores(train: DataFrame, dealt: DataFrame, buckets: int, depth: int, least: int, divergence: float, model_bytes: int = MODEL_BYTES) -> tuple[DataFrame | None, Lookup | None]:
    """The model to be broadcast if it is small enough. Else block, bucket, logs: log probabilities of the distinct runs of each block of
    dealt, in the order of _dealt_runs.
    """
    spark = train.sparkSession
    partial = train.select("text").mapInArrow(_grams(depth), "gram long, n long")
    counts = written(_with_bucket(partial.groupBy("gram").agg(F.sum("n").alias("n")), F.shiftright("gram", 8), buckets), "grams")
    got = counts.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    short = (got.column("gram").to_numpy().view(U), got.column("n").to_numpy())
    found = counts.groupBy("bucket").applyInArrow(_bucket_contexts(spark.sparkContext.broadcast(short), depth, least, divergence), "context long, length int")
    kept = written(found.distinct(), "contexts")
    ones = np.array([r["context"] for r in kept.where("length = 1").collect()], U)  # 256 at most
    longer = _with_bucket(kept.where("length > 1").select(F.col("context").alias("gram"), (-F.col("length")).cast("long").alias("n")), F.col("gram"), buckets)
    marked = counts.unionByName(longer)
    out, lookup = None, None
    rows = written(marked.groupBy("bucket").applyInArrow(_bucket_model(spark.sparkContext.broadcast(short), depth), "length int, row long, n long"), "model")
    if 16 * rows.count() <= model_bytes:
        got = rows.toArrow()
        lookup = Lookup(short, ones, got.column("length").to_numpy(), got.column("row").to_numpy().view(U), got.column("n").to_numpy(), depth)
    else:
        runs = dealt.groupBy("block").applyInArrow(_block_runs(depth, buckets), "bucket int, block int, grams binary")
        shared = spark.sparkContext.broadcast((short, ones))
        out = written(runs.groupBy("bucket").cogroup(marked.groupBy("bucket")).applyInArrow(_bucket_scores(shared, depth), "block int, bucket int, logs binary"), "logs")
    for table in (counts, kept, rows):
        drop(table)
    free_shuffles(spark)
    return out, lookup


# -- words and blocks --


def _vocabularies(buckets: int):
    """Of a block of texts: distinct word hashes and their counts in training texts, a row for each bucket of hashes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        h, c = _block_words(table)
        to = (h % U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        h, c, to = h[order], c[order], to[order]
        first = np.searchsorted(to, np.arange(buckets + 1))
        rows = [(b, block, h[a:z].tobytes(), c[a:z].astype("<u4").tobytes()) for b, (a, z) in enumerate(zip(first, first[1:], strict=False)) if z > a]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table({"bucket": pa.array(columns[0], pa.int32()), "block": pa.array(columns[1], pa.int32()), "hashes": pa.array(columns[2], pa.binary()), "counts": pa.array(columns[3], pa.binary())})

    return run


def _block_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    kept = []
    for batch in table.combine_chunks().to_batches():
        train = batch.column(batch.schema.get_field_index("train")).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, _, data, offsets in arrow_slices(batch):
            w = find_words(data, offsets, lower=True)
            kept.append(_summed(w.hashes, train[lo + w.text]))
    return _summed(np.concatenate([k for k, _ in kept]) if kept else np.zeros(0, U), np.concatenate([c for _, c in kept]) if kept else np.zeros(0, np.int64))


def _totals(key: tuple, table: pa.Table) -> pa.Table:
    """Of a bucket of hashes: each block's words with their counts over all blocks."""
    blocks = table.column("block").to_numpy()
    hashes = [np.frombuffer(x, U) for x in table.column("hashes").to_pylist()]
    counts = [np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]
    every, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
    marks = np.cumsum([0] + [len(h) for h in hashes])
    out = [total[inverse[a:z]].astype("<u4" if total.max() < 2**32 else "<u8").tobytes() for a, z in zip(marks, marks[1:], strict=False)]
    n = len(out)
    return pa.table(
        {
            "block": pa.array(blocks, pa.int32()),
            "hashes": pa.array([h.tobytes() for h in hashes], pa.binary()),
            "totals": pa.array(out, pa.binary()),
            "words": pa.array([int((total > 0).sum())] + [0] * (n - 1), pa.int64()),
            "tokens": pa.array([int(total.sum())] + [0] * (n - 1), pa.int64()),
        }
    )


def _scorer(depth: int, buckets: int, model: Broadcast | None):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        runs, text = _table_runs(docs, depth)
        every, inverse = np.unique(runs, return_inverse=True)
        if model is not None:
            values = model.value.logs(every)
        else:
            order, _ = _dealt_runs(every, buckets)
            parts = sorted((b, x) for b, x in zip(words.column("bucket").to_pylist(), words.column("logs").to_pylist(), strict=True) if x is not None)
            values = np.zeros(len(every))
            values[order] = np.frombuffer(b"".join(x for _, x in parts), "<f8")
        scores, base = np.bincount(text, weights=values[inverse], minlength=len(docs)), 0
        words = words.filter(words.column("hashes").is_valid())
        hashes = np.concatenate([np.zeros(0, U), *(np.frombuffer(x, U) for x in words.column("hashes").to_pylist())])
        totals = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, "<u4" if len(x) * 2 == len(h) else "<u8").astype(np.int64) for x, h in zip(words.column("totals").to_pylist(), words.column("hashes").to_pylist(), strict=True))])
        order = np.argsort(hashes)
        hashes, totals = hashes[order], totals[order]
        logs = np.log10(totals + 1.0)
        out = []
        for batch in docs.combine_chunks().to_batches():
            doc_id, train = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "train"))
            for lo, hi, data, offsets in arrow_slices(batch):
                w = find_words(data, offsets, lower=True)
                at = np.searchsorted(hashes, w.hashes)
                n = len(w.counts)
                known = np.bincount(w.text, weights=totals[at] > 0, minlength=n).astype(np.int64)
                out.append(
                    pa.table(
                        [
                            doc_id.slice(lo, hi - lo),
                            pa.array(~train.slice(lo, hi - lo).to_numpy(zero_copy_only=False)),
                            pa.array(w.counts.astype(np.int64) + 1),
                            pa.array(known),
                            pa.array(np.bincount(w.text, weights=logs[at], minlength=n)),
                            pa.array(scores[base + lo : base + hi]),
                        ],
                        schema=schema,
                    )
                )
            base += len(batch)
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def corpus_scores(docs: DataFrame, modulus: int = 7, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """docs: doc_id long, text string (null: empty). Learns from the rows whose crc32(doc_id as text) mod modulus is not 2; scores all.

    Returns a row per row of docs: doc_id, held_out, n_tokens (words and one end), n_known (tokens that training texts hold), train_tokens,
    base_score (sum of log10((count + 1) / (tokens + kinds + 1)) over training counts), score (the tree's log10 probability of the text). A
    null doc_id counts as the empty text for held_out. Without training rows every symbol is equally likely.
    """
    spark = docs.sparkSession
    short_batches(spark)
    d = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))).withColumn("train", ~held_out(modulus))
    ends = d.where("train").count()
    blocks = block_count(d)
    buckets = blocks  # as many as blocks, so what a bucket loads does not grow with the corpus
    dealt = d.select("doc_id", "text", "train", F.pmod("k1", F.lit(blocks)).cast("int").alias("block"))
    logs, lookup = run_scores(d.where("train"), dealt, buckets, depth, least, divergence, model_bytes)
    own = dealt.groupBy("block").applyInArrow(_vocabularies(buckets), "bucket int, block int, hashes binary, counts binary")
    totals = written(own.groupBy("bucket").applyInArrow(_totals, "block int, hashes binary, totals binary, words long, tokens long"), "totals")
    free_shuffles(spark)
    got = totals.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    tokens, kinds = (got["tokens"] or 0) + ends, (got["words"] or 0) + (ends > 0)
    known = totals.select("block", "hashes", "totals")
    known = known.unionByName(logs, allowMissingColumns=True) if logs is not None else known
    model = spark.sparkContext.broadcast(lookup) if lookup is not None else None
    scored = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _scorer(depth, buckets, model), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"
    )
    end_log = float(np.log10(ends + 1))
    each = float(np.log10(tokens + kinds + 1))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(end_log) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        "score",
    )
