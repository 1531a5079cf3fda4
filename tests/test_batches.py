"""Python works on a few rows at a time, whatever a batch holds."""

import importlib

import pyarrow as pa
from pyspark.sql import functions as F

from tarnflow.functions import batches
from tarnflow.functions.embedding import dense, embedder, postings
from tarnflow.functions.text import CONTROL, clean_text, cleaned, nfc
from tarnflow.operators import chunking


def test_slices_and_columns_by_slices():
    whole = pa.RecordBatch.from_arrays([pa.array([*range(999), None])], ["x"])
    parts = list(batches.slices([whole, whole.slice(0, 0)]))
    assert len(parts) > 1 and max(p.num_rows for p in parts) <= batches.ROWS
    assert pa.concat_arrays([p.column(0) for p in parts]).equals(whole.column(0))
    seen = []
    out = batches.by_slices(whole.column(0), lambda v: seen.append(len(v)) or pa.array(v, pa.int64()))
    assert out.equals(whole.column(0)) and max(seen) <= batches.ROWS
    assert len(batches.by_slices(pa.array([], pa.string()), lambda v: pa.array(v, pa.string()))) == 0


def test_strips_come_slice_after_slice():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["One. Two. Three."] * 1000)], ["k", "text"])

    class Rows:
        schema = {"k": type("F", (), {"dataType": type("T", (), {"simpleString": lambda s: "bigint"})()})()}

        def select(self, *names):
            return self

        def mapInArrow(self, run, kind):
            return list(run(iter([batch])))

    out = chunking.strips(Rows(), "k")
    assert len(out) > 1 and sum(b.num_rows for b in out) == 2000


def test_embedded_and_composed_alike_over_many_rows(spark):
    rows = spark.range(450).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("\u00e9 one Two "), F.col("id").cast("string"))).alias("text")).coalesce(1)
    got = {r["k"]: r["e"] for r in rows.select("k", embedder()("text").alias("e")).collect()}
    posts = postings(rows.where("text IS NOT NULL"), "k").cache()
    vectors = {r["k"]: r["dense"] for r in dense(posts, "k").collect()}
    for k, e in got.items():
        assert all(abs(a - b) < 1e-12 for a, b in zip(e["dense"], vectors.get(k, [0.0] * 64), strict=True))
        assert e["lexical"] == ({} if k % 7 == 0 else e["lexical"]) and len(e["dense"]) == 64
    assert {(r["k"], r["token_id"]): r["weight"] for r in posts.collect()} == {(k, t): w for k, e in got.items() for t, w in e["lexical"].items()}
    assert [r[0] for r in rows.orderBy("k").select(nfc(F.replace("text", F.lit("\u00e9"), F.lit("e\u0301")))).collect()] == [None if k % 7 == 0 else f"\u00e9 one Two {k}" for k in range(450)]


def test_texts_are_cleaned_in_one_pass_as_by_the_patterns(spark):
    texts = [f"a{chr(i)}{chr(j)}b {chr(i)}\n{chr(i)}" for i in [*range(1, 0x250), *range(0x1680, 0x1690), *range(0x180B, 0x180F), *range(0x2000, 0x2070), *range(0x3000, 0x3004), 0xFEFF] for j in (9, 10, 13, 32, 0xA0, 0x2028, 120)]
    rows = spark.createDataFrame(enumerate([*texts, "", None]), "k int, t string")
    t = F.regexp_replace(nfc(F.col("t")), "\r\n?", "\n")
    t = F.regexp_replace(F.replace(F.replace(t, F.lit("\u00ad"), F.lit("")), F.lit("\u00a0"), F.lit(" ")), CONTROL, "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?U)[\s&&[^\n]]+", " "), " ?\n ?", "\n"), "\n{3,}", "\n\n")
    assert rows.select("t", F.btrim(t, F.lit(" \n")).alias("w")).collect() == [(x, cleaned(x)) for x in [*texts, "", None]]
    # No pattern is left to the JVM, which would match it twice for a text that is filtered.
    out = rows.select(clean_text(F.col("t")).alias("t")).where("t <> ''")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("ArrowEvalPython") == 1 and out.count() > 0


def test_batches_for_python_are_bounded_by_their_bytes(spark):
    entry = importlib.import_module("__spark_entry__")
    query = entry._shipped(lambda s, d: s.range(3000).select(F.repeat(F.lit("x"), 10_000).alias("t")).coalesce(1), batches.bounded)
    rows = query(spark, "")

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_pydict({"n": [part.nbytes]})

    held = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(held) >= 30_000_000 and max(held) < 2 * batches.BATCH
    # A training-data operator has the session's own setting; a lower one stays.
    plain = entry._shipped(lambda s, d: s.conf.get(batches.BATCH_BYTES), batches.unbounded)
    assert plain(spark, "") == "67108864b" == plain(spark, "")
    spark.conf.set(batches.BATCH_BYTES, "64k")
    batches.bounded(spark)
    assert spark.conf.get(batches.BATCH_BYTES) == "64k"
    batches.unbounded(spark)
    assert spark.conf.get(batches.BATCH_BYTES) == "64k"
    spark.conf.unset(batches.BATCH_BYTES)
