"""A deterministic embedder by hashing, from built-in functions: a stand-in for a model, used where none is given.

Each word's SHA-256 gives a token id (first four bytes), a place (id modulo the dimensions) and a sign (lowest bit of the fifth byte: 1 is plus).
Lexical weights are counts by token id; the dense vector is the signed counts by place, at length 1.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StructField, StructType

from .batches import by_slices
from .text import words
from .vectors import unit


def token_id(word: Column) -> Column:
    return F.conv(F.substring(F.sha2(word, 256), 1, 8), 16, 10).cast("long")


def token_sign(word: Column) -> Column:
    return F.when(F.conv(F.substring(F.sha2(word, 256), 9, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)


def postings(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, token_id, sign, weight: a row for each distinct token of each row. Tokens are counted before anything is hashed."""
    words_ = rows.select(key, F.explode(words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").cast("double").alias("weight"))
    return words_.select(key, token_id(F.col("word")).alias("token_id"), token_sign(F.col("word")).alias("sign"), "weight").groupBy(key, "token_id").agg(F.first("sign").alias("sign"), F.sum("weight").alias("weight"))


def dense(posts: DataFrame, key: str, dimensions: int = 64) -> DataFrame:
    """key, dense: from postings()."""
    places = posts.groupBy(key, (F.col("token_id") % dimensions).cast("int").alias("place")).agg(F.sum(F.col("sign") * F.col("weight")).alias("x"))
    maps = places.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return maps.select(key, unit(full).alias("dense"))


#: Words whose tokens a task remembers at a time.
KNOWN = 100_000
EMBEDDED = StructType([StructField("dense", ArrayType(DoubleType())), StructField("lexical", MapType(LongType(), DoubleType()))])


def embedder(dimensions: int = 64):
    """The same vectors as a function of a text column, a struct of dense and lexical: one pass over texts and no shuffle, for whole corpora."""

    @arrow_udf(EMBEDDED)
    def embed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, int]] = {}

        def token(word: str) -> tuple[int, int]:
            if word not in known:
                if len(known) > KNOWN:
                    known.clear()
                digest = hashlib.sha256(word.encode()).digest()
                known[word] = int.from_bytes(digest[:4], "big"), 1 if digest[4] & 1 else -1
            return known[word]

        def embedded(texts: list) -> pa.Array:
            dense, edges, tokens, counts = np.zeros((len(texts), dimensions)), [0], [], []
            for v, text in zip(dense, texts, strict=True):
                weights: dict[int, float] = {}
                for word, n in Counter(re.findall(r"\w+", (text or "").lower())).items():
                    number, sign = token(word)
                    v[number % dimensions] += sign * n
                    weights[number] = weights.get(number, 0.0) + n
                size = np.sqrt((v * v).sum())
                v /= size or 1.0
                tokens += weights
                counts += weights.values()
                edges.append(len(tokens))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dimensions, pa.int32()), pa.array(dense.ravel()))
            lexical = pa.MapArray.from_arrays(pa.array(edges, pa.int32()), pa.array(tokens, pa.int64()), pa.array(counts, pa.float64()))
            return pa.StructArray.from_arrays([vectors, lexical], ["dense", "lexical"])

        for part in parts:
            yield by_slices(part, embedded)

    return embed
