"""Near-duplicate documents by MinHash: universal hash minima, banding, signature checks, exact Jaccard, components.

Words are lower-cased (A-Z) runs of non-space bytes. A document's set holds the hashes (64 bit) of its runs of five words; with fewer words,
of the whole run; without words it is empty and linked with nothing. Documents of equal sets are one node. Nodes are linked if the
Jaccard similarity of their whole sets is at least `similarity`.

Candidates: `bands` bands of `rows` minima. Each bucket links its members to one of them; the links shared by most buckets are verified by their
signatures, then confirmed on full sets, which gives first components. Only buckets that then hold several
components are searched further: there the shingles that members of different components share are counted exactly. So no group's
pairs are made, yet no link between components is passed over that banding brings together: a pair at similarity 0.75 shares no bucket with
probability 5e-6 (32 bands of 4).

Nulls: a null text is an empty one; a null doc_id is never a component's smallest. Repeated rows are documents like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, free_shuffles, joined_by_hot_key, keyed, short_batches, written
from .components import components
from .words import U, arrow_slices, find_words, mixed, shingles, slices, text_buffers

SIZE, SIMILARITY, BANDS, ROWS = 5, 0.75, 32, 4
#: Pairs whose signatures agree less are not compared; a pair at 0.75 is four standard deviations above.
AGREEMENT = 0.6
#: Members of a bucket that meet in one task.
BUCKET_PART = 1024
PRIME = (1 << 31) - 1


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, text by text; the text of each; their number by text."""
    w = find_words(data, offsets, lower=True)
    h, first = shingles(w, size)
    text = w.text[first]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        ends = np.cumsum(w.counts)
        extra = []
        for t in short:
            own = w.hashes[ends[t] - w.counts[t] : ends[t]]
            x = np.array([len(own)], U)
            for v in own:
                x = mixed(x ^ v) * U(0xD1342543DE82EF95)
            extra.append(x)
        h, text = np.concatenate([h, *extra]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
        h, text = h[new], text[new]
    return h, text, np.bincount(text, minlength=len(w.counts))


def _universal(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and increments of k hashes x -> (a x + b) mod (2^31 - 1)."""
    rng = np.random.default_rng(7)
    return rng.integers(1, PRIME, k, dtype=np.uint64), rng.integers(0, PRIME, k, dtype=np.uint64)


def _minima(h: np.ndarray, marks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash over each run h[marks[i]:marks[i+1]] (none empty)."""
    x = h % U(PRIME)
    out = np.empty((len(a), len(marks)), np.uint32)
    for i in range(len(a)):
        y = x * a[i] + b[i]
        y = (y & U(PRIME)) + (y >> U(31))
        y = (y & U(PRIME)) + (y >> U(31))
        out[i] = np.minimum.reduceat(y.astype(np.uint32), marks)
    return out


def _signer(size: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _universal(bands * rows)
        salt = mixed(np.arange(1, bands + 1).astype(U))
        for batch in batches:
            for lo, hi, data, offsets in arrow_slices(batch):
                h, text, n = _sets(data, offsets, size)
                full = np.flatnonzero(n)
                node = np.zeros(len(n), np.int64)
                keys = np.zeros((len(n), bands), np.int64)
                if len(full):
                    marks = (np.cumsum(n) - n)[full]
                    node[full] = mixed(np.add.reduceat(mixed(h ^ U(0xA5A5A5A5)), marks) + n[full].astype(U)).view(np.int64)
                    m = _minima(h, marks, a, b)
                    for j in range(bands):
                        key = np.full(len(full), salt[j])
                        for row in m[j * rows : (j + 1) * rows]:
                            key = mixed((key ^ row.astype(U)) * U(0xD1342543DE82EF95))
                        keys[full, j] = key.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]), pa.int32()), pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in ("doc_id", "k1", "k2")), pa.array(n.astype(np.int64)), pa.array(node, mask=n == 0), lists],
                    schema=schema,
                )

    return run


def _confirm(size: int, similarity: float):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    hundred = round(100 * similarity)

    def one(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return _sets(data, np.array([0, len(data)]), size)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            kept = []
            agree = [(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean() for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            for u, v, tu, tv, near in zip(*(batch.column(i).to_pylist() for i in range(4)), agree, strict=True):
                if near < AGREEMENT:
                    continue
                if last[0] != v:
                    last = (v, one(tv))
                x, y = one(tu), last[1]
                i = np.searchsorted(y, x)
                both = int((y[np.minimum(i, len(y) - 1)] == x).sum())
                if 100 * both >= hundred * (len(x) + len(y) - both):
                    kept.append((u, v))
            yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in kept], schema=schema)

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of pairs (u, v) of nodes, those similar enough on their full sets."""
    t = texts.select("node", F.struct("text", "signature").alias("t"))
    both = pairs.join(t.select(F.col("node").alias("u"), F.col("t").alias("tu")), "u").join(t.select(F.col("node").alias("v"), F.col("t").alias("tv")), "v")
    return both.select("u", "v", "tu.text", "tv.text", "tu.signature", "tv.signature").toDF("u", "v", "tu", "tv", "su", "sv").mapInArrow(_confirm(size, similarity), "u long, v long")


def _leftover(size: int, similarity: float):
    """Links between different components in a bucket (or between two parts of one): exact counts of shared shingles, by an index from shingle to
    members. For each member one link to each component that it is similar to.
    """
    hundred = round(100 * similarity)

    def run(table: pa.Table) -> pa.Table:
        node, label, part, two = (table.column(c).to_numpy() for c in ("node", "label", "part", "pair"))
        data, offsets = text_buffers(table.column("text"))
        h, owner = [], []
        for lo, hi in slices(offsets):
            own, text, _ = _sets(data, offsets[lo : hi + 1], size)
            h.append(own)
            owner.append(text + lo)
        owner = np.concatenate(owner)
        n = np.bincount(owner, minlength=len(node))
        shingle = np.unique(np.concatenate(h), return_inverse=True)[1]
        order = np.argsort(shingle, kind="stable")
        holders, starts = owner[order], np.append(0, np.cumsum(np.bincount(shingle)))
        marks = np.append(0, np.cumsum(n))
        labels, group = np.unique(label, return_inverse=True)
        largest = np.bincount(group).argmax()
        us, vs = [], []
        for i in np.flatnonzero(group != largest).tolist():  # of two components one is not the largest
            own = shingle[marks[i] : marks[i + 1]]
            lens = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
            both = np.bincount(holders[at], minlength=len(node))
            near = np.flatnonzero((100 * both >= hundred * (n[i] + n - both)) & (group != group[i]) & ((part != part[i]) | (two[0] == 0)))
            near = near[np.unique(group[near], return_index=True)[1]]
            us.append(np.full(len(near), node[i]))
            vs.append(node[near])
        u = np.concatenate([np.zeros(0, np.int64), *us])
        v = np.concatenate([np.zeros(0, np.int64), *vs])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs: doc_id long, text string (other columns are ignored). Returns a row per row of docs: doc_id, n_shingles, component_id (the smallest
    doc_id of the component, itself included), kept (doc_id = component_id), node (of equal sets; null if empty), k1 and k2 (the row's
    keys, see common.keyed), first (the row is its component's first by null ids last, doc_id, keys; true without words). Rows alike in doc_id
    and text share their keys, so more than one may be first.
    """
    spark = docs.sparkSession
    short_batches(spark)
    d = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    signed = written(d.mapInArrow(_signer(size, bands, rows), "doc_id long, k1 long, k2 long, n_shingles long, node long, bands array<long>"), "signed")
    nodes = signed.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    keys = written(nodes.select("node", F.explode("bands").alias("key")).select("key", "node"), "bands")
    full = keys.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("members")).where("members > 1")
    stars = written(keys.join(full, "key").where("node <> v").groupBy(F.col("node").alias("u"), "v").agg(F.count("*").alias("shared")), "stars")
    involved = stars.select("u").union(stars.select("v")).distinct().withColumnRenamed("u", "node")
    # A row's keys name the text that stands for its node: one row a node, found before any join.
    named = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("m")).join(involved, "node").select("node", "m.k1", "m.k2")
    texts = written(_texts(d, named, size, bands * rows), "texts")
    free_shuffles(spark)
    links = written(_confirmed(_likeliest(stars), texts, size, similarity), "links")
    label = components(links)
    untried = stars.join(_likeliest(stars), ["u", "v"], "left_anti")
    more = written(_likeliest(_apart(untried, label)), "more")
    links = links.unionByName(written(_confirmed(more, texts, size, similarity), "links"))
    label = components(links)
    drop(more)
    free_shuffles(spark)
    found = written(_crossing(keys, texts, label, size, similarity), "links")
    if not found.isEmpty():
        label = components(links.unionByName(found))
    drop(texts)
    free_shuffles(spark)
    # Least ids are found by node first, so a component has a row a node; a node or component that holds many rows is joined by a broadcast.
    by_node = signed.where("node is not null").groupBy("node").agg(F.min(_rank()).alias("m"))
    labelled = written(by_node.join(label, "node", "left").select("node", "m", F.coalesce("label", "node").alias("c")), "labelled")
    least = labelled.groupBy("c").agg(F.min("m").alias("first"))
    named = written(joined_by_hot_key(labelled.select("node", "c"), least, "c").select("node", "first"), "named")
    out = joined_by_hot_key(signed.select("doc_id", "n_shingles", "k1", "k2", "node"), named, "node")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")))
    first = F.col("node").isNull() | ((F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "node", "k1", "k2", first.alias("first"))


def _rank():
    """A total order of rows: null ids last, then doc_id and text by their keys."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")


def _texts(d: DataFrame, named: DataFrame, size: int, minima: int) -> DataFrame:
    """node, text, signature (8 bits a minimum): one text for each node named. The node is made from the text again, which guards the join by keys."""
    schema = pa.schema([("node", pa.int64()), ("text", pa.string()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _universal(minima)
        for batch in batches:
            for lo, hi, data, offsets in arrow_slices(batch):
                h, _, n = _sets(data, offsets, size)
                full = np.flatnonzero(n)
                own, signature = np.zeros(len(n), np.int64), np.zeros((len(n), minima), np.uint8)
                if len(full):
                    marks = (np.cumsum(n) - n)[full]
                    own[full] = mixed(np.add.reduceat(mixed(h ^ U(0xA5A5A5A5)), marks) + n[full].astype(U)).view(np.int64)
                    signature[full] = (mixed(_minima(h, marks, a, b).T.astype(U)) & U(255)).astype(np.uint8)
                same = (own == batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False)) & (n > 0)
                yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in signature], pa.binary())], schema=schema).filter(pa.array(same))

    found = d.select("text", "k1", "k2").join(named, ["k1", "k2"]).select("text", "node").mapInArrow(run, "node long, text string, signature binary")
    return found.dropDuplicates(["node"])


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs of nodes in different components."""
    a = label.select(F.col("node").alias("u"), F.col("label").alias("lu"))
    b = label.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    p = pairs.join(a, "u", "left").join(b, "v", "left")
    return p.where(F.coalesce("lu", "u") != F.coalesce("lv", "v")).select("u", "v", "shared")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """For each u the v with which it shares most buckets."""
    return pairs.groupBy("u").agg(F.max(F.struct("shared", F.col("v"))).alias("m")).select("u", F.col("m.v").alias("v"))


def _crossing(keys: DataFrame, texts: DataFrame, label: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links between different components within the buckets that hold several."""
    own = keys.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed_up = own.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("m")).where("a <> b")
    mixed_up = mixed_up.select("key", F.ceil(F.col("m") / BUCKET_PART).cast("int").alias("parts"))
    members = own.join(mixed_up, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "label")
    members = members.withColumn("pair", (F.col("p") != F.col("q")).cast("int")).join(texts.select("node", "text"), "node")
    return members.groupBy("key", "p", "q").applyInArrow(_leftover(size, similarity), "u long, v long").distinct()
