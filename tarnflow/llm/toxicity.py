"""Toxic documents by class-conditional Kneser-Ney models of expressions.

An expression is a word: a run of non-space bytes, lower-cased (A-Z), without ASCII punctuation at its ends. Each class has an interpolated
Kneser-Ney model over a ladder of ever longer beginnings (3, 4, 5, 6 bytes, the whole word):

    P(longer | class) = max(n - d, 0) / N + d T / N * P(shorter | class) * S(longer | shorter)

with n, T and N the class's count, kinds and tokens. S, the share of the distinct words that go on so, is counted over both classes
together: rare and unseen expressions are smoothed by shared counts, and what sets the classes apart is how often their beginnings occur.
A word's evidence is log P(word | toxic) - log P(word | ordinary).

A few words make a long text toxic, so likelihoods are normalised by length over the strongest 1, 2 and 4 distinct words, and over the
whole text. A logistic model of these four, fitted on labelled rows that the counts do not see, gives the score.

Likelihoods normalised over the whole text alone do not give right results here, so they are not the only feature: on held-out rows of the
test table they found 58 of 120 toxic documents with 97 false alarms (words) and 10 with 12 (words, pairs and triples of words).

Fitting reads about CLASS_ROWS documents of a class at most (those of smallest hash, so they are the same at each run); the model's size is
bounded by their words. Scores are for every row, over whole texts; rows that repeat have equal scores. A document labelled more than
once is toxic if any label says so. Equal evidence is no tie to break: only its size enters a score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import held_out, short_batches
from .words import U, Words, _hashes, arrow_slices, find_words

CLASS_ROWS, DISCOUNT = 12_000, 0.75
#: A word or beginning of fewer occurrences has the evidence of its next shorter beginning.
LEAST = 2
BEGINNINGS = (3, 4, 5, 6)
STRONGEST = (1, 2, 4)
THRESHOLD = 0.3
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U)
_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 128) if not chr(c).isalnum()]] = True


def expressions(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index among w's words, hash and first six bytes of each expression; words of punctuation alone are none."""
    starts, ends = w.starts.copy(), w.ends.copy()
    todo = np.arange(len(starts))
    while len(todo := todo[(starts[todo] < ends[todo]) & _EDGE[w.data[np.minimum(starts[todo], len(w.data) - 1)]]]):
        starts[todo] += 1
    todo = np.arange(len(starts))
    while len(todo := todo[(starts[todo] < ends[todo]) & _EDGE[w.data[ends[todo] - 1]]]):
        ends[todo] -= 1
    kept = np.flatnonzero(starts < ends)
    starts, ends = starts[kept], ends[kept]
    if not len(kept):
        return kept, np.zeros(0, U), np.zeros(0, U)
    padded = np.zeros(len(w.data) + 8, np.uint8)
    padded[: len(w.data)] = w.data
    lanes = np.ndarray(len(w.data) + 1, "<u8", padded, 0, (1,))
    return kept, _hashes(w.data, starts, ends), lanes[starts] & _MASKS[np.minimum(ends - starts, 6)]


@dataclass
class Model:
    tables: list[tuple[np.ndarray, np.ndarray]]  # whole words first, then beginnings from long to short: sorted keys and evidence
    unknown: float
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def evidence(self, hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.unknown)
        left = np.arange(len(hashes))
        for (keys, values), size in zip(self.tables, (0, *sorted(BEGINNINGS, reverse=True)), strict=True):
            if not len(left) or not len(keys):
                continue
            x = begin[left] & _MASKS[size] if size else hashes[left]
            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            hit = keys[at] == x
            out[left[hit]] = values[at[hit]]
            left = left[~hit]
        return out

    def features(self, w: Words) -> np.ndarray:
        """Of each text: mean evidence of its strongest 1, 2, 4 distinct expressions, and of all."""
        n = len(w.counts)
        kept, hashes, begin = expressions(w)
        value, text = self.evidence(hashes, begin), w.text[kept]
        out = np.zeros((n, len(STRONGEST) + 1))
        out[:, -1] = np.bincount(text, weights=value, minlength=n) / np.maximum(np.bincount(text, minlength=n), 1)
        strong = np.flatnonzero(value > 0)
        text, hashes, value = text[strong], hashes[strong], value[strong]
        order = np.lexsort((hashes, text))
        text, hashes, value = text[order], hashes[order], value[order]
        if len(text):
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])])
            text, value = text[new], value[new]
            order = np.lexsort((-value, text))
            text, value = text[order], value[order]
            place = np.arange(len(text)) - np.searchsorted(text, text)
            for j, k in enumerate(STRONGEST):
                own = place < k
                out[:, j] = np.bincount(text[own], weights=value[own], minlength=n) / k
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((features - self.center) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_counts(hashes: np.ndarray, begin: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, discount: float = DISCOUNT, least: int = LEAST) -> Model:
    """The ladder's evidence from counts of distinct words; weights are set by fit_scores."""
    totals = np.array([max(1, toxic.sum()), max(1, ordinary.sum())], float)
    shorter_key, shorter_p, shorter_kinds = None, None, None
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    kinds_all, unknown = len(hashes), np.ones(2)
    for size in (*BEGINNINGS, 0):
        full = begin & _MASKS[size] if size else hashes
        keys, first, inverse = np.unique(full, return_index=True, return_inverse=True)
        n = np.stack([np.bincount(inverse, weights=toxic), np.bincount(inverse, weights=ordinary)], 1)
        kinds = np.bincount(inverse)
        rest = discount * (n > 0).sum(0) / totals
        if shorter_key is None:
            lower = np.repeat((kinds / kinds_all)[:, None], 2, 1)
        else:
            up = np.searchsorted(shorter_key, begin[first] & _MASKS[before])
            lower = shorter_p[up] * (kinds / shorter_kinds[up])[:, None]
        p = np.maximum(n - discount, 0) / totals + rest * lower
        # A word with nothing longer than this beginning known has the models' rest masses as factors too.
        for k, (x, v) in enumerate(tables):
            tables[k] = (x, v + np.log(rest[0] / rest[1]))
        unknown = unknown * rest
        known = n.sum(1) >= least
        tables.append((keys[known], np.log(p[known, 0] / p[known, 1])))
        shorter_key, shorter_p, shorter_kinds, before = keys, p, kinds, size
    k = len(STRONGEST) + 1
    return Model(tables[::-1], float(np.log(unknown[0] / unknown[1])), np.zeros(k), np.ones(k), np.zeros(k + 1))


def fit_scores(model: Model, features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> None:
    """Logistic weights by Newton's method."""
    model.center, model.scale = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack([np.ones(len(labels)), (features - model.center) / model.scale])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (labels - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each batch with their counts by class."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, _, data, offsets in arrow_slices(batch):
            w = find_words(data, offsets, lower=True, hashes=False)
            kept, h, begin = expressions(w)
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            toxic = np.bincount(inverse, weights=label[lo + w.text[kept]] == 1, minlength=len(keys)).astype(np.int64)
            ordinary = np.bincount(inverse, minlength=len(keys)) - toxic
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(begin[first].view(np.int64)), pa.array(toxic), pa.array(ordinary.astype(np.int64))], ["word", "begin", "toxic", "ordinary"])


def _append_score(shared: Broadcast, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, model, prior = shared.value
        for batch in batches:
            for lo, hi, data, offsets in arrow_slices(batch):
                score = np.full(hi - lo, prior) if model is None else model.score(model.features(find_words(data, offsets, lower=True, hashes=False)))
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(score)], [*own.schema.names, name])

    return run


def with_scores(docs: DataFrame, labels: DataFrame, name: str, modulus: int = 4, class_rows: int = CLASS_ROWS) -> DataFrame:
    """docs as they are, with one more column `name` (which they must not have): the score of each row. Nothing is shuffled but labels and counts."""
    model, prior = fit(docs, labels, modulus, class_rows)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model, prior))
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(_append_score(shared, name), schema)


def _score(shared: Broadcast, features: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, model, prior = shared.value
        for batch in batches:
            for lo, hi, data, offsets in arrow_slices(batch):
                own = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                if model is None:
                    score = np.full(hi - lo, prior)
                else:
                    x = model.features(find_words(data, offsets, lower=True, hashes=False))
                    if features:
                        yield pa.RecordBatch.from_arrays([own[0], *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["label", *(f"f{j}" for j in range(x.shape[1]))])
                        continue
                    score = model.score(x)
                yield pa.RecordBatch.from_arrays([*own, pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, class_rows: int = CLASS_ROWS) -> tuple[Model | None, float]:
    """A model of the labelled rows of docs that are not held out, and the share of toxic ones, which is all there is where a class has no rows.

    A document labelled more than once is toxic if any label says so. Two thirds of the rows go to counts, one third to weights.
    """
    short_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    known = known.where(~held_out(modulus))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    if not n.get(0) or not n.get(1):
        return None, prior
    for label, rows in n.items():
        if rows > class_rows:  # hashes are uniform, so a bar on them leaves about class_rows
            known = known.where((F.col("label") != label) | (F.xxhash64("doc_id") <= int(2**64 * class_rows / rows) - 2**63))
    # What is left are about two times class_rows ids at most: a broadcast, and no text is shuffled.
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    d = d.withColumn("weigh", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) == 0)
    counted = d.where("not weigh").select("text", "label").mapInArrow(_count, "word long, begin long, toxic long, ordinary long")
    counted = counted.groupBy("word").agg(F.first("begin").alias("begin"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow()
    got = [counted.column(c).to_numpy() for c in ("word", "begin", "toxic", "ordinary")]
    if not len(got[0]) or not got[2].sum() or not got[3].sum():
        return None, prior
    model = fit_counts(got[0].view(U), got[1].view(U), got[2], got[3])
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model, prior))
    names = [f"f{j}" for j in range(len(STRONGEST) + 1)]
    x = d.where("weigh").select("label", "label", "text").toDF("label", "same", "text").mapInArrow(_score(shared, True), "label int, " + ", ".join(f"{c} double" for c in names)).toArrow()
    shared.unpersist()
    y = x.column("label").to_numpy()
    if not len(y) or y.min() == y.max():
        return None, prior
    fit_scores(model, np.column_stack([x.column(c).to_numpy() for c in names]), y)
    return model, prior


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, class_rows: int = CLASS_ROWS) -> DataFrame:
    """docs: doc_id long, text string (null: empty); labels: doc_id, toxic (null: not labelled). Learns from labelled rows whose crc32(doc_id
    as text) mod modulus is not 2. A row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.3).
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", held_out(modulus))
    model, prior = fit(docs, labels, modulus, class_rows)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model, prior))
    scored = d.select("doc_id", "held_out", "text").mapInArrow(_score(shared, False), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
