"""Approximate nearest neighbours by inner product: one neighbour graph over the whole table, made by NN-descent and searched greedily.

Everything is a Spark join by node; no task holds more than its share of nodes, and no node or query is copied to shards.

Nodes: equal vectors are one node, named by a hash (64 bit) of the vector; it keeps its smallest ids, as many as a result can need. Inner products are made
a nearness that a graph can use by one more coordinate, sqrt(M^2 - |x|^2) with M the longest length, which is 0 throughout for vectors of
equal length.

Pivots: about PIVOTS sqrt(n) nodes of smallest hash, PIVOTS_MOST at most, a bounded sample that is broadcast. Every node is indexed.

1. Start. Each node goes to the cells of its nearest pivots, large cells are split by hash, and a cell's nodes are compared with one another.
   Nodes also get a few random links, which join parts of the graph that nearness leaves apart.
2. Descent. A round joins each node's links, and a bounded number of those it is linked from, with their vectors; a node's neighbours are
   compared with one another, and each keeps the nearest it has met. Rounds end when few lists change.
3. Search. A query begins at its nearest pivots. A round joins the nearest nodes that were not followed yet with their links, these with
   their codes (a byte a component and one scale), and keeps the `beam` nearest in the query's row. Rounds end when all of every beam were
   followed. The whole beam is then scored in double precision on the original vectors, and cut at k.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different lengths have no inner product: those of
another length than most take no part either. Rows that share a vec_id count as one another's own. Equal scores go by the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, free_shuffles, written

NEIGHBOURS, REVERSE, RANDOM = 24, 16, 3
ROUNDS, SETTLED = 3, 0.02
PIVOTS, PIVOTS_MOST, CELLS, CELL = 2, 65_536, 16, 2048
BEAM, AT_ONCE, ENTRIES = 160, 24, 16
SEARCH_ROUNDS = 200
KEPT_EACH = 6  # of its nearest in one neighbourhood, those that a node is told


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(F.coalesce(fine, F.lit(False)))


def _matrix(column) -> np.ndarray:
    """Rows of doubles from a binary column."""
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(data.to_pylist()), np.float64).reshape(len(data), -1) if len(data) else np.zeros((0, 1))


def _bytes(v: DataFrame) -> DataFrame:
    """The last column's doubles as bytes, so that a vector is one value to Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            m = flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x.tobytes() for x in m], pa.binary())], names=[*batch.schema.names[:-1], "v"])

    schema = ", ".join(f"{c} {t}" for c, t in v.dtypes[:-1]) + ", v binary"
    return v.mapInArrow(run, schema)


def _placed(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that makes all equally long, in single precision."""
    return np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))]).astype(np.float32)


def _lists(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of values by owner (0 to n - 1, in order)."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _nearest(own: np.ndarray, other: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (own, other, score): each own's `most` highest scores, without repeats, ties to the smaller other."""
    order = np.lexsort((other, -score, own))
    own, other, score = own[order], other[order], score[order]
    # Equal pairs have equal scores but for rounding, so they may stand a little apart: the first of each is taken.
    first = np.sort(np.unique(np.stack([own, other]), axis=1, return_index=True)[1]) if len(own) else np.zeros(0, np.int64)
    own, other, score = own[first], other[first], score[first]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    good = place < most
    return own[good], other[good], score[good]


MET = "node long, others array<long>, scores array<float>"


def _met(own: np.ndarray, other: np.ndarray, score: np.ndarray, most: int) -> pa.RecordBatch:
    """A row a node: the nearest of what it met."""
    own, other, score = _nearest(own, other, score, most)
    node, first = np.unique(own, return_index=True)
    row = np.repeat(np.arange(len(node)), np.diff(np.append(first, len(own))))
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), _lists(row, len(node), other, pa.int64()), _lists(row, len(node), score, pa.float32())], ["node", "others", "scores"])


def _in_single(longest: float):
    """The last column's vectors as _placed has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _placed(_matrix(batch.column(1)), longest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["node", "v"])

    return run


def _single(column: pa.Array) -> np.ndarray:
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(data.to_pylist()), np.float32).reshape(len(data), -1) if len(data) else np.zeros((0, 1), np.float32)


def _to_cells(shared: Broadcast, cells: int, longest: float):
    """Each node with the cells of its nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = _placed(shared.value[1], longest)
        for batch in batches:
            x = _single(batch.column(1))
            most = min(cells, len(pivots))
            for lo in range(0, len(x), 2048):
                s = x[lo : lo + 2048] @ pivots.T
                at = np.argpartition(-s, most - 1, axis=1)[:, :most]
                part = batch.slice(lo, len(s))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(at.astype(np.int32)), pa.list_(pa.int32()))], ["node", "v", "cells"])

    return run


def _in_cell(neighbours: int):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        x = _single(table.column("v"))
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        most = min(neighbours, len(node) - 1)
        if most < 1:
            return pa.Table.from_batches([_met(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), 1)])
        at = np.argpartition(-s, most - 1, axis=1)[:, :most]
        own = np.repeat(np.arange(len(node)), most)
        return pa.Table.from_batches([_met(node[own], node[at.ravel()], s[own, at.ravel()], neighbours)])

    return run


def _in_hood(kept: int):
    """Neighbours of a node compared with one another; each is told its nearest there. Told once a batch, so a node in many lists is few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = np.diff(ids.offsets.to_numpy())
            node = ids.flatten().to_numpy()
            x = _single(vectors.flatten())
            first = np.cumsum(sizes) - sizes
            own, other, score = [], [], []
            for size in np.unique(sizes[sizes > 1]).tolist():
                rows = first[sizes == size]
                at = rows[:, None] + np.arange(size)
                y = x[at]
                s = y @ y.transpose(0, 2, 1)
                s[:, np.arange(size), np.arange(size)] = -np.inf
                most = min(kept, size - 1)
                best = np.argpartition(-s, most - 1, axis=2)[:, :, :most]
                own.append(np.repeat(node[at], most, axis=1).ravel())
                other.append(np.take_along_axis(node[at][:, None, :].repeat(size, 1), best, 2).ravel())
                score.append(np.take_along_axis(s, best, 2).ravel())
            if own:
                yield _met(np.concatenate(own), np.concatenate(other), np.concatenate(score), 2 * kept + 4)

    return run


GRAPH = "node long, near array<long>, scores array<float>, changed int"


def _merge(neighbours: int):
    """A node's nearest of all it has met; changed: how many of them are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, scores, old = batch.column(1), batch.column(2), batch.column(3)
            row = np.repeat(np.arange(len(batch)), np.diff(others.offsets.to_numpy()))
            row, near, score = _nearest(row, others.flatten().to_numpy(), scores.flatten().to_numpy(), neighbours)
            was_row = np.repeat(np.arange(len(batch)), np.diff(old.offsets.to_numpy()))
            was = set(zip(was_row.tolist(), old.flatten().to_pylist(), strict=True))
            new = np.array([p not in was for p in zip(row.tolist(), near.tolist(), strict=True)], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(row, len(batch), near, pa.int64()), _lists(row, len(batch), score, pa.float32()), pa.array(np.bincount(row[new], minlength=len(batch)), pa.int32())],
                ["node", "near", "scores", "changed"],
            )

    return run


def _merged(met: DataFrame, graph: DataFrame | None, neighbours: int) -> DataFrame:
    """A new graph of what nodes met and the old lists. Nodes that met nothing and had no list are not in it."""
    rows = met.withColumn("old", F.array().cast("array<long>"))
    if graph is not None:
        rows = rows.unionByName(graph.select("node", F.col("near").alias("others"), "scores", F.col("near").alias("old")))
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    gathered = rows.groupBy("node").agg(flat("others"), flat("scores"), flat("old"))
    return written(gathered.mapInArrow(_merge(neighbours), GRAPH), "graph")


def random_links(nodes: DataFrame, total: int, links: int) -> DataFrame:
    """node, to: links to nodes that follow it in random rings of about 64 nodes, another ring for each link."""
    out = None
    for j in range(links):
        own = Window.partitionBy("ring").orderBy("h")
        dealt = nodes.select("node", F.xxhash64(F.lit(j), "node").alias("h")).withColumn("ring", F.pmod(F.xxhash64(F.lit(100 + j), "node"), F.lit(max(1, total // 64))))
        ring = dealt.select("node", F.lead("node").over(own).alias("to")).where("to is not null")
        out = ring if out is None else out.unionByName(ring)
    return out


def _sampled_back(forward: DataFrame, reverse: int) -> DataFrame:
    """node, to: the links of forward (node, to) turned round, `reverse` at most for a node, by hash; the rank is cut within tasks before any shuffle."""
    turned = forward.select(F.col("to").alias("node"), F.col("node").alias("to"))
    by = Window.partitionBy("node").orderBy(F.xxhash64("node", "to"), "to")
    return turned.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= reverse).select("node", "to")


def neighbour_graph(nodes: DataFrame, pivots: Broadcast, total: int, longest: float, neighbours: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """nodes: node long, v (bytes). Returns the graph (node, near: the nearest first) and all links of the search (node, links)."""
    single = written(nodes.mapInArrow(_in_single(longest), "node long, v binary"), "single")
    cells = single.mapInArrow(_to_cells(pivots, CELLS, longest), "node long, v binary, cells array<int>").select("node", "v", F.explode("cells").alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    cells = cells.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))  # a row a pivot
    graph = _merged(cells.groupBy("cell", "part").applyInArrow(_in_cell(neighbours), MET), None, neighbours)
    chance = written(random_links(nodes, total, RANDOM), "random-links")
    for turn in range(rounds):
        forward = graph.select("node", F.explode("near").alias("to"))
        hood = forward.unionByName(_sampled_back(forward, reverse))
        hood = hood.unionByName(chance) if turn == 0 else hood
        # A node is in its own neighbourhood, so it meets those it is linked from as well.
        hood = hood.unionByName(graph.select("node", F.col("node").alias("to"))).distinct()
        with_vectors = hood.join(single.select(F.col("node").alias("to"), "v"), "to")
        lists = with_vectors.groupBy("node").agg(F.collect_list("to").alias("ids"), F.collect_list("v").alias("vectors")).select("ids", "vectors")
        new = _merged(lists.mapInArrow(_in_hood(KEPT_EACH), MET), graph, neighbours)
        drop(graph)
        free_shuffles(nodes.sparkSession)
        graph = new
        got = graph.agg(F.sum("changed").alias("c"), F.sum(F.size("near")).alias("n")).first()
        if (got["c"] or 0) <= SETTLED * (got["n"] or 0):
            break
    drop(single)
    forward = graph.select("node", F.explode("near").alias("to"))
    every = forward.unionByName(_sampled_back(forward, neighbours)).unionByName(chance).unionByName(_sampled_back(chance, RANDOM))
    links = written(every.distinct().groupBy("node").agg(F.collect_list("to").alias("links")), "links")
    return graph, links


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, c: a scale in single precision, then a signed byte a component."""
    for batch in batches:
        x = _matrix(batch.column(1))
        scale = (np.abs(x).max(1) / 127 if len(x) else np.zeros(0)).astype(np.float32)
        c = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).clip(-127, 127).astype(np.int8)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() + b.tobytes() for a, b in zip(scale, c, strict=True)], pa.binary())], ["node", "c"])


def _decoded(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return np.ascontiguousarray(raw[:, 4:]).view(np.int8) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


STATE = "query_id long, q binary, nodes array<long>, scores array<double>, done array<boolean>, met long"


def _begin(shared: Broadcast, entries: int):
    """Each query with its nearest pivots as its beam."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            q = _matrix(batch.column(1))
            most = min(entries, len(ids))
            s = q @ x.T if len(ids) else np.zeros((len(q), 0))
            at = np.argsort(-s, axis=1, kind="stable")[:, :most]
            row = np.repeat(np.arange(len(q)), most)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _lists(row, len(q), ids[at.ravel()], pa.int64()), _lists(row, len(q), s[row, at.ravel()], pa.float64()), _lists(row, len(q), np.zeros(len(row), bool), pa.bool_()), pa.array(np.full(len(q), len(ids)), pa.int64())],
                ["query_id", "q", "nodes", "scores", "done", "met"],
            )

    return run


def _step(beam: int, at_once: int):
    """The nodes just met, scored by their codes and put into the beam; those followed in this round are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(1))
            out: list[tuple] = []
            for i, (nodes, scores, done, met, ids, codes) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 8)), strict=True)):
                node, score, old = np.array(nodes, np.int64), np.array(scores), np.array(done, bool)
                old[np.flatnonzero(~old)[:at_once]] = True
                if ids:
                    new = np.array(ids, np.int64)
                    node, score, old = np.concatenate([node, new]), np.concatenate([score, _decoded(codes) @ q[i]]), np.concatenate([old, np.zeros(len(new), bool)])
                    met += len(new)
                order = np.lexsort((node, -score))[:beam]
                out.append((node[order], score[order], old[order], met))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, (pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.int64()), strict=True))], ["query_id", "q", "nodes", "scores", "done", "met"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query_id, met, node, score of pairs of vectors (q, v), in double precision."""
    for batch in batches:
        q, v = _matrix(batch.column(3)), _matrix(batch.column(4))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.einsum("ij,ij->i", q, v) if len(q) else np.zeros(0))], ["query_id", "met", "node", "score"])


def greedy_search(queries: DataFrame, nodes: DataFrame, links: DataFrame, pivots: Broadcast, beam: int = BEAM, at_once: int = AT_ONCE, entries: int = ENTRIES) -> DataFrame:
    """queries: query_id long, q (bytes). Returns query_id, met (nodes scored), node, score of each node of its beam.

    A beam that is followed to its end leaves the joins, so a round costs what the queries still open cost.
    """
    spark = queries.sparkSession
    coded = written(nodes.mapInArrow(_codes, "node long, c binary"), "codes")
    state = written(queries.mapInArrow(_begin(pivots, entries), STATE), "search")
    finished: list[DataFrame] = []
    for _ in range(SEARCH_ROUNDS):
        waiting = F.exists("done", lambda d: ~d)
        closed = state.where(~waiting)
        live = state.where(waiting)
        if live.isEmpty():
            beams = _union([*finished, state]).select("query_id", "met", F.explode("nodes").alias("node"), "q")
            return beams.join(nodes, "node").select("query_id", "met", "node", "q", "v").mapInArrow(_exact, "query_id long, met long, node long, score double")
        finished.append(closed)
        beams = F.filter(F.arrays_zip("nodes", "done"), lambda x: ~x["done"])
        frontier = live.select("query_id", "nodes", F.explode(F.slice(beams, 1, at_once).getField("nodes")).alias("node"))
        met = frontier.join(links, "node").select("query_id", F.explode(F.array_except("links", "nodes")).alias("node")).distinct()
        scored = met.join(coded, "node").groupBy("query_id").agg(F.collect_list("node").alias("ids"), F.collect_list("c").alias("codes"))
        both = live.join(scored, "query_id", "left").select("query_id", "q", "nodes", "scores", "done", "met", "ids", "codes")
        state = written(both.mapInArrow(_step(beam, at_once), STATE), "search")
        free_shuffles(spark)
    raise RuntimeError("the search did not settle")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def found_in(vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """query_id, met, node, score of each usable query and node of its beam, and ids: the smallest vec_ids of the node. See nearest()."""
    spark = vectors.sparkSession
    base = usable(vectors).dropDuplicates()
    common = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    base = base.where(F.size("v") == (common["n"] if common else -1))
    own = Window.partitionBy("v").orderBy("vec_id")
    first = base.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k + 1)
    rows = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    rows = written(_bytes(rows.select(F.xxhash64("v").alias("node"), "ids", "v")), "vectors")
    total = rows.count()
    longest = float(np.sqrt(base.select(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0))
    nodes = rows.select("node", "v")
    wanted = min(PIVOTS_MOST, total, max(4 * ENTRIES, int(PIVOTS * total**0.5)))
    bar = max(0, int(2**64 * min(1.0, 1.2 * wanted / max(1, total))) - 1) - 2**63
    got = nodes.where(F.xxhash64(F.lit(17), "node") <= bar).toArrow()
    pivots = spark.sparkContext.broadcast((got.column("node").to_numpy().astype(np.int64), _matrix(got.column("v"))))
    _, links = neighbour_graph(nodes, pivots, total, longest)
    asked = usable(queries).where(F.size("v") == (common["n"] if common else -1)).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = _bytes(asked.select(F.col("vec_id").alias("query_id"), "v")).withColumnRenamed("v", "q")
    hits = greedy_search(asked, nodes, links, pivots, max(beam, k + 1))
    return hits.join(rows.select("node", "ids"), "node")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """vectors, queries: vec_id, embedding. A row per query and neighbour: query_id, rank (from 1), vec_id, score, n_scored (nodes compared with the
    query): the largest inner products found, ties to the smaller vec_id, the query's own vec_id left out. Queries that take no part have no rows.
    """
    hits = found_in(vectors, queries, k, beam).select("query_id", "score", "met", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.col("met").alias("n_scored"))
