"""Rows in Python a few at a time: a batch of Spark's has up to 10,000, whose texts and results as Python objects would be many times their bytes.

A batch has 64 MB at most by Spark's setting, and each Python process of an executor holds one and its results. bounded() lowers that.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

ROWS = 200
#: Bytes of a batch that Spark hands to Python, and Spark's setting of them.
BATCH, BATCH_BYTES = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_given: dict[SparkSession, str] = {}


def bounded(spark: SparkSession) -> None:
    """Hand batches of BATCH bytes at most to Python, so that its memory does not grow with the rows of a task. A lower setting of the session stays."""
    given = spark.conf.get(BATCH_BYTES)
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)i?b?", given.strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH:
        _given[spark] = given
        spark.conf.set(BATCH_BYTES, str(BATCH))


def unbounded(spark: SparkSession) -> None:
    """The session's own setting again, where bounded() has changed it and nobody since."""
    if spark in _given and spark.conf.get(BATCH_BYTES) == str(BATCH):
        spark.conf.set(BATCH_BYTES, _given.pop(spark))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_slices(column: pa.Array, make: Callable[[list], pa.Array], rows: int = ROWS) -> pa.Array:
    """make(values) of a column, slice after slice: only one slice is there as Python objects."""
    return pa.concat_arrays([make(column.slice(at, rows).to_pylist()) for at in range(0, max(len(column), 1), rows)])


def text_udf(function: Callable[[str | None], str | None]):
    """A function of texts as one of columns. It is not moved past filters, as Spark would run it for the filter and again for the column."""

    @arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return by_slices(texts, lambda part: pa.array(map(function, part), pa.string()))

    return run.asNondeterministic()
