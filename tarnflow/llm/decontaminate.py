"""Benchmark decontamination: which documents hold most of a benchmark item's shingles. DataFrame operations only.

Words are lower-cased runs of non-space characters; shingles are runs of five words, of all words in a text that has fewer. The containment of
an item in a document is the share of the item's distinct shingles that the document holds.

Search: an item's MinHash sketch is its shingles of smallest hash. Items are partitioned by size (powers of two), and the sketch grows with the
size: of n shingles, a containment of t leaves out n - ceil(t n) at most, so the smallest n - ceil(t n) + 1 hashes always hold one that the
document has. A fixed number of minima would miss short items in long documents, whose Jaccard similarity is near 0; this one misses none.
Each document's shingle hashes probe, in one pass, the partitions whose least item it is long enough to hold: an item of 2^c shingles or
more is in no document of fewer than ceil(t 2^c) runs. Each pair found is verified by its exact shingles.

Sketches, items and candidates are broadcast if they measure BROADCAST_BYTES at most; beyond, they are joined by a shuffle, salted where a common
shingle may be hot.

An item of one to four words has one shingle, all its words, which only a text of just these words has: such items are not found inside longer
texts, where one common word would be a hit. Nulls: a null text is empty and holds nothing; an item without words is in no document. A
null doc_id or item_id stays null in the result. A row wholly like another adds nothing, in either table. There are no ties: every pair that
reaches the containment is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, written

SIZE, CONTAINMENT = 5, 0.75
BROADCAST_BYTES = 32_000_000
SALT = 16
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE)), f"[{SPACE}]+")


def shingles(words: Column, size: int) -> Column:
    """Distinct runs of size words, each as one string (words hold no space, so a string is one run only)."""

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))

    # The words are bound to a variable: inside the inner lambda they would be split again for each run.
    return F.array_remove(F.array_distinct(F.transform(F.array(words), runs)[0]), "")


def run_hash(words: Column, i: Column, size: int) -> Column:
    """Of words i, i + 1, ...; those beyond the end are null, which the hash passes over."""
    return F.xxhash64(*(F.get(words, i + j) for j in range(size)))


def needed(n: Column, containment: float) -> Column:
    """Shingles that an item of n must share."""
    return F.ceil(F.lit(containment) * n - 1e-9)


def sketches(items: DataFrame, size: int, containment: float) -> DataFrame:
    """item_key, size_class, hash: of each item the smallest hashes, as many as its size needs."""
    own = F.array_sort(F.transform(F.transform("shingles", lambda s: F.split(s, " ")), lambda w: run_hash(w, F.lit(0), size)))
    n = F.col("n_item_shingles")
    parted = items.select("item_key", F.floor(F.log2(n)).alias("size_class"), F.slice(own, F.lit(1), (n - needed(n, containment) + 1).cast("int")).alias("h"))
    return parted.select("item_key", "size_class", F.explode("h").alias("hash")).distinct()


def probes(docs: DataFrame, size: int) -> DataFrame:
    """doc_key, runs, hash: a row per run of size words (of the whole text if it has fewer); runs is their number in the text."""

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: run_hash(w, i, size))

    hashes = docs.select("doc_key", F.transform(F.array(words(F.col("text"))), runs)[0].alias("hashes"))
    return hashes.select("doc_key", F.size("hashes").alias("runs"), F.explode("hashes").alias("hash"))


def _measured(table: DataFrame, width: Column) -> int:
    """Bytes of a table whose rows are of this width."""
    return table.agg(F.sum(width).alias("b")).first()["b"] or 0


def contaminated_rows(docs: DataFrame, items: DataFrame, size: int = SIZE, containment: float = CONTAINMENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """As contaminated(), with k1 and k2, the keys of the document's row (common.keyed)."""
    d = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("doc_key", F.col("k1"))
    i = items.select(F.col("item_id").cast("long").alias("item_id"), shingles(words(F.col("text")), size).alias("shingles")).where(F.size("shingles") > 0)
    known = written(i.distinct().withColumn("n_item_shingles", F.size("shingles")).withColumn("item_key", F.xxhash64("item_id", "shingles")), "items")
    sketch = written(sketches(known, size, containment), "sketches")
    least = needed(F.pow(F.lit(2), "size_class"), containment)
    found = probes(d, size)
    if _measured(sketch, F.lit(24)) <= broadcast_bytes:
        found = found.join(F.broadcast(sketch), "hash")
    else:  # a shingle that many documents hold is dealt to SALT tasks
        salted = sketch.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = found.withColumn("salt", F.pmod(F.xxhash64("doc_key"), F.lit(SALT)).cast("int")).join(salted, ["hash", "salt"])
    # Distinct first within each task: a passage that many documents share is soon few rows.
    pairs = written(found.where(F.col("runs") >= least).select("doc_key", "item_key").distinct(), "candidates")
    wanted = pairs.groupBy("doc_key").agg(F.collect_set("item_key").alias("items"))
    texts = d.join(F.broadcast(wanted) if _measured(pairs, F.lit(32)) <= broadcast_bytes else wanted, "doc_key")
    each = texts.select("doc_id", "k1", "k2", shingles(words(F.col("text")), size).alias("own"), F.explode("items").alias("item_key"))
    text_bytes = F.aggregate("shingles", F.lit(64).cast("long"), lambda n, x: n + F.octet_length(x) + 16)
    few = _measured(known, text_bytes) <= broadcast_bytes
    both = each.join(F.broadcast(known) if few else known, "item_key").withColumn("n_shared", F.size(F.array_intersect("own", "shingles")))
    out = both.where(F.col("n_shared") >= needed(F.col("n_item_shingles"), containment))
    numbers = [F.col("n_item_shingles").cast("long").alias("n_item_shingles"), F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("n_item_shingles")).alias("containment")]
    return out.select("doc_id", "item_id", *numbers, "k1", "k2")


def contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE, containment: float = CONTAINMENT) -> DataFrame:
    """docs: doc_id, text; items: item_id, text (other columns are ignored). A row per document and item that it holds at `containment` or
    more: doc_id, item_id, n_item_shingles, n_shared, containment.
    """
    return contaminated_rows(docs, items, size, containment).drop("k1", "k2").distinct()
