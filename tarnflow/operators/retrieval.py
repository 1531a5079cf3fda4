"""Hybrid retrieval over many queries at once: dense and sparse top lists, rank fusion, reranking, relevance and routing.

Queries are the small side: they go to the tasks, SCAN_BYTES at most for one scan of the rows, so what is sent has a bound and any number can be
asked. Each task scores SLICE rows against QUERY_ROWS queries at a time and keeps the best k rows of each query. What is shuffled after that is
k rows for each query and task; there is no row for a pair.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embedding import KNOWN
from ..functions.text import overlap

QUERY_ROWS, SLICE = 2000, 1000
SCAN_BYTES, SCAN_QUERIES = 64 << 20, 20_000
#: Products of a sparse search that are held at once.
PAIRS = 2_000_000
DIGITS = 9


def prefetch(limit: int) -> int:
    """How long each list is before fusion."""
    return max(4 * limit, 20)


def filtered(index: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns equal the values given (None: not asked). Applied before ranking, so that a filtered top list is exact."""
    for name, value in equal.items():
        if value is not None:
            index = index.where(F.col(name) == F.lit(value))
    return index


def _top(rows: DataFrame, by: str | list[str], k: int, *order: Column) -> DataFrame:
    """rank (from 1) of the first k rows of each query; Spark drops the others before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order))).where(F.col("rank") <= k)


class _Dense:
    """Inner products with the vectors of a scan's queries."""

    positive = False

    def __init__(self, table: pa.Table, query: str):
        self.names = table.column(query).to_pylist()
        self.matrix = np.array(table.column("vector").to_pylist(), float).T

    def read(self, column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def scores(self, x: np.ndarray, a: int, z: int) -> np.ndarray:
        return x @ self.matrix[:, a:z]


class _Sparse:
    """Sums of products over shared tokens, from each token's queries and weights: nothing is as wide as the vocabulary."""

    positive = True

    def __init__(self, table: pa.Table, query: str, counted: bool):
        self.counted = counted
        asked = table.column(query).to_pylist()
        self.names = list(dict.fromkeys(asked))
        place = {name: i for i, name in enumerate(self.names)}
        column = np.array([place[x] for x in asked], np.int64)
        token, weight = table.column("token_id").to_numpy(), table.column("weight").to_numpy()
        order = np.lexsort((column, token))
        self.token, self.column, self.weight = token[order], column[order], weight[order]
        self.tokens = set(self.token.tolist())
        self.known: dict[str, int | None] = {}

    def _number(self, word: str) -> int | None:
        if word not in self.known:
            if len(self.known) > KNOWN:
                self.known.clear()
            number = int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "big")
            self.known[word] = number if number in self.tokens else None
        return self.known[word]

    def read(self, column: pa.Array) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """How many rows, and row, token and weight of what they hold."""
        if not self.counted:
            offsets = column.offsets.to_numpy()
            part = slice(offsets[0], offsets[-1])
            row = np.repeat(np.arange(len(column)), np.diff(offsets))
            return len(column), row, column.keys.to_numpy(zero_copy_only=False)[part], column.items.to_numpy(zero_copy_only=False)[part]
        row, token, weight = [], [], []
        for i, text in enumerate(column.to_pylist()):
            for word, n in Counter(re.findall(r"\w+", (text or "").lower())).items():
                if (number := self._number(word)) is not None:
                    row.append(i)
                    token.append(number)
                    weight.append(n)
        return len(column), np.array(row, np.int64), np.array(token, np.int64), np.array(weight, float)

    def scores(self, x: tuple, a: int, z: int) -> np.ndarray:
        n, row, token, weight = x
        own = np.flatnonzero((self.column >= a) & (self.column < z))
        tokens, column, weights = self.token[own], self.column[own] - a, self.weight[own]
        first, last = np.searchsorted(tokens, token, "left"), np.searchsorted(tokens, token, "right")
        hit = np.flatnonzero(last > first)
        row, weight, first, many = row[hit], weight[hit], first[hit], (last - first)[hit]
        out = np.zeros(n * (z - a))
        edges = np.concatenate([[0], np.cumsum(many)])
        at = 0
        while at < len(hit):
            stop = max(at + 1, int(np.searchsorted(edges, edges[at] + PAIRS, "right")) - 1)
            size = many[at:stop]
            posting = np.repeat(first[at:stop] - (edges[at:stop] - edges[at]), size) + np.arange(edges[stop] - edges[at])
            cell = np.repeat(row[at:stop], size) * (z - a) + column[posting]
            out += np.bincount(cell, np.repeat(weight[at:stop], size) * weights[posting], len(out))
            at = stop
        return out.reshape(n, z - a)


class _Best:
    """The k best rows of each query so far, by score rounded and then key."""

    def __init__(self, k: int, queries: int):
        self.k, self.held, self.size = k, [], 0
        self.bar = np.full(queries, -np.inf)

    def add(self, s: np.ndarray, a: int, keys: pa.Array, positive: bool) -> None:
        s = np.round(s, DIGITS)
        place = min(self.k, len(s)) - 1
        bar = np.maximum(-np.partition(-s, place, axis=0)[place], self.bar[a : a + s.shape[1]])
        rows, columns = np.nonzero((s >= bar) & ((s > 0) | (not positive)))
        if len(rows):
            self.held.append((columns + a, s[rows, columns], keys.take(pa.array(rows))))
            self.size += len(rows)
        if self.size > 4 * self.k * len(self.bar):
            self.reduce()

    def reduce(self) -> None:
        if not self.held:
            return
        column, score = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        keys = pa.concat_arrays([h[2] for h in self.held])
        rank = np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.lexsort((rank, -score, column))
        column = column[order]
        place = np.arange(len(column)) - np.searchsorted(column, column)
        kept = place < self.k
        order, column, place = order[kept], column[kept], place[kept]
        score = score[order]
        full = place == self.k - 1
        self.bar[column[full]] = score[full]
        self.held, self.size = [(column, score, keys.take(pa.array(order)))], len(order)


def _keep_best(lists: list, k: int, kind: pa.DataType):
    """Of a task's rows the k best for each query of each list; lists are searched in one pass over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k, len(one.names)) for one in lists]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for j, one in enumerate(lists):
                    column = part.column(1 + j)
                    there = column.is_valid()
                    keys, x = part.column(0).filter(there), one.read(column.filter(there))
                    for a in range(0, len(one.names) if len(keys) else 0, QUERY_ROWS):
                        best[j].add(one.scores(x, a, min(a + QUERY_ROWS, len(one.names))), a, keys, one.positive)
        for j, one in enumerate(lists):
            best[j].reduce()
            for column, score, keys in best[j].held:
                names = pa.array([one.names[c] for c in column], kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(column), j, np.int32)), names, keys, pa.array(score, pa.float64())], ["l", "q", "k", "score"])

    return run


def _search(rows: DataFrame, lists: list[tuple], query: str, key: str, k: int) -> DataFrame:
    """lists: queries, the rows' column they are held against, bytes of a row of queries, and what scores a table of them. list, query, key, score, rank."""
    names = lists[0][0].schema[query].dataType.simpleString()
    kind = f"l int, q {names}, k {rows.schema[key].dataType.simpleString()}, score double"
    parts = 1
    for queries, _, size, _ in lists:
        n = queries.agg(F.count_distinct(query).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
        parts = max(parts, -(-n["n"] // SCAN_QUERIES), -(-int(n["bytes"]) // SCAN_BYTES))
    found = None
    for p in range(parts):
        tables = [queries.where(F.pmod(F.xxhash64(query), F.lit(parts)) == p).toArrow() for queries, *_ in lists]
        if not any(t.num_rows for t in tables):
            continue
        run = _keep_best([make(t) for t, (*_, make) in zip(tables, lists, strict=True)], k, tables[0].schema.field(query).type)
        one = rows.select(key, *(value for _, value, _, _ in lists)).mapInArrow(run, kind)
        found = one if found is None else found.unionByName(one)
    found = rows.sparkSession.createDataFrame([], kind) if found is None else found
    return _top(found.toDF("list", query, key, "score"), ["list", query], k, F.desc("score"), F.col(key))


def _dense_list(queries: DataFrame, query: str, value: str) -> tuple:
    q = queries.select(query, F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    return q, F.col(value).cast("array<double>").alias("_vector"), 8 * F.size("vector"), lambda table: _Dense(table, query)


def _sparse_list(queries: DataFrame, query: str, value: str) -> tuple:
    q = queries.select(query, F.col("token_id").cast("long").alias("token_id"), F.col("weight").cast("double").alias("weight"))
    column = F.col(value).cast("map<bigint,double>") if value == "lexical" else F.col(value)
    return q, column.alias("_sparse"), F.lit(24), lambda table: _Sparse(table, query, value != "lexical")


def dense_top(queries: DataFrame, rows: DataFrame, k: int, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """queries: query, vector; rows: key, vector (unit vectors for cosine). query, key, score, rank: the k of largest inner product (to nine
    digits, so that the order of summing does not matter), ties by key. Null vectors take no part.
    """
    return _search(rows, [_dense_list(queries, query, "vector")], query, key, k).drop("list")


def sparse_top(queries: DataFrame, rows: DataFrame, k: int, query: str = "query_id", key: str = "chunk_id", value: str = "lexical") -> DataFrame:
    """queries: query, token_id, weight; rows: key, value: lexical (map from token id to weight) or, under another name, a text, whose tokens are
    counted on the way. query, key, score, rank: the k of largest sum of products over shared tokens, ties by key. Rows without one have no place.
    """
    return _search(rows, [_sparse_list(queries, query, value)], query, key, k).drop("list")


def hybrid_top(vectors: DataFrame, posts: DataFrame, rows: DataFrame, k: int, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """dense_top of vectors (list 0) and sparse_top of posts (list 1) in one pass over rows: key, vector, lexical. For fuse()."""
    return _search(rows, [_dense_list(vectors, query, "vector"), _sparse_list(posts, query, "lexical")], query, key, k)


def fuse(lists: list[DataFrame], limit: int, rrf_k: int = 2, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion: score = sum over lists of 1 / (rrf_k + rank from 0), to nine digits; a row may be in one list only. A table of
    several lists, as of hybrid_top(), counts as them.
    """
    every = None
    for one in lists:
        part = one.select(query, key, (F.lit(1.0) / (F.lit(rrf_k) + F.col("rank") - 1)).alias("part"))
        every = part if every is None else every.unionByName(part)
    return _top(every.groupBy(query, key).agg(F.round(F.sum("part"), DIGITS).alias("score")), query, limit, F.desc("score"), F.col(key))


def rerank(hits: DataFrame, limit: int, score: Column | None = None, query: str = "query_id") -> DataFrame:
    """hits: query, query_text, text, rank, score. The first `limit` by a model's score of (query_text, text), ties in the order they had; the score
    of retrieval stays as retrieval_score. Without a model the score is how many terms both share.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    model = overlap(F.col("query_text"), F.col("text")) if score is None else score
    scored = hits.withColumnRenamed("score", "retrieval_score").withColumnRenamed("rank", "retrieval_rank").withColumn("rerank_score", model)
    return _top(scored, query, limit, F.desc("rerank_score"), F.col("retrieval_rank"))


def route(queries: DataFrame, judged: DataFrame, query: str = "query_id") -> DataFrame:
    """query, action, n_hits: Correct if any hit is relevant, Incorrect if all are irrelevant or there are none, else Ambiguous."""
    known = judged.groupBy(query).agg(F.count("*").alias("n"), F.bool_or(F.col("relevance") == "relevant").alias("some"), F.every(F.col("relevance") == "irrelevant").alias("none"))
    action = F.when(F.col("some"), "Correct").when(F.col("n").isNull() | F.col("none"), "Incorrect").otherwise("Ambiguous")
    return queries.select(query).distinct().join(known, query, "left").select(query, action.alias("action"), F.coalesce("n", F.lit(0)).alias("n_hits"))


def judged_once(hits: DataFrame, judgments: DataFrame, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Problems of judgments, which must be one for each hit: missing, unknown, repeated, of an unknown label or without a reason. Empty if they are right."""
    j = judgments.groupBy(query, key).agg(F.count("*").alias("n"), F.min("relevance").alias("relevance"), F.min("reason").alias("reason"))
    both = hits.select(query, key, F.lit(True).alias("_hit")).join(j, [query, key], "full")
    problem = (
        F.when(F.col("n").isNull(), "missing")
        .when(F.col("_hit").isNull(), "unknown")
        .when(F.col("n") > 1, "repeated")
        .when(~F.coalesce(F.col("relevance").isin("relevant", "irrelevant", "uncertain"), F.lit(False)), "label")
        .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "reason")
    )
    return both.select(query, key, problem.alias("problem")).where("problem is not null")


def parents(judged: DataFrame, actions: DataFrame, query: str = "query_id") -> DataFrame:
    """Hits whose strips may serve: relevant ones, and where the action is Ambiguous uncertain ones too; none where it is Incorrect."""
    both = judged.join(actions.select(query, "action"), query)
    return both.where((F.col("action") != "Incorrect") & ((F.col("relevance") == "relevant") | ((F.col("action") == "Ambiguous") & (F.col("relevance") == "uncertain"))))
