"""A corpus pipeline over documents: stages of the llm operators, each written as Parquet and read again for the next."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.llm import decontaminate, minhash, packing, substring, toxicity
from tarnflow.llm.common import left, read, remove, remove_left, row_keys, shared_dir, written
from tarnflow.ship import ship

#: Intermediate tables of the stage before, by thread: the next stage removes them, as its input is written by then.
_before = threading.local()
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Row keys are broadcast up to so many (16 bytes each).
FEW_KEYS = 1_000_000


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    while name in docs.columns:
        name += "_"
    return name


def _with_keys(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the two keys of common.keyed, under names it does not use, and their names."""
    a, b = _unused(docs, "k1"), _unused(docs, "k2")
    one, two = row_keys()
    return docs.withColumn(a, one).withColumn(b, two), a, b


def _stage(f: Callable) -> Callable:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        remove_left(spark, getattr(_before, "paths", []))
        had = set(left(spark))
        out = f(spark, docs, sf_dir)
        _before.paths = [p for p in left(spark) if p not in had]
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, each row judged by its own text: a null doc_id or a repeated one changes nothing."""
    score = _unused(docs, "score")
    scored = toxicity.with_scores(docs, read(spark, sf_dir, "labels"), score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the first by doc_id (null last), then by keys of the row. Decisions are by doc_id and text, so another
    text of the same doc_id stays. Of rows alike in both, one stays. Rows without words are linked with nothing and all stay.
    """
    groups = minhash.near_duplicates(docs).where("first").select("k1", "k2", F.col("node").isNull().alias("none")).distinct()
    rows, a, b = _with_keys(docs)
    g1, g2, many, place = (_unused(rows, c) for c in ("g1", "g2", "none", "place"))
    kept = rows.join(groups.toDF(g1, g2, many), (F.col(a) == F.col(g1)) & (F.col(b) == F.col(g2)))
    kept = kept.withColumn(place, F.row_number().over(Window.partitionBy(a, b).orderBy(a)))
    return kept.where(F.col(many) | (F.col(place) == 1)).select(*docs.columns)


@_stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that repeat; n_chars follows. Other texts stay as they are, null ones too."""
    less = substring.without_repeats(docs)
    rows, a, b = _with_keys(docs)
    l1, l2, kept = (_unused(rows, c) for c in ("l1", "l2", "kept"))
    joined = rows.join(less.toDF(l1, l2, kept), (F.col(a) == F.col(l1)) & (F.col(b) == F.col(l2)), "left")
    new = {
        "text": lambda kind: F.coalesce(F.col(kept), F.col("text")),
        "n_chars": lambda kind: F.when(F.col(kept).isNotNull(), F.char_length(kept).cast(kind)).otherwise(F.col("n_chars")),
    }
    return joined.select(*(new[c](kind).alias(c) if c in new else F.col(c) for c, kind in docs.dtypes))


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row judged by its own text; a null text holds none."""
    found = decontaminate.contaminated_rows(docs, read(spark, sf_dir, "benchmark")).select("k1", "k2").distinct()
    rows, a, b = _with_keys(docs)
    g1, g2 = _unused(rows, "g1"), _unused(rows, "g2")
    gone = written(found.toDF(g1, g2), "contaminated")
    gone = F.broadcast(gone) if gone.count() <= FEW_KEYS else gone
    return rows.join(gone, (F.col(a) == F.col(g1)) & (F.col(b) == F.col(g2)), "left_anti").select(*docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed into sequences of 1024 tokens: a row per piece. A null or empty text is its end id alone."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_repeats", drop_repeats),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Learned models, components and tokenizers: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents. Only the last stage's table is left in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/tarnflow/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
