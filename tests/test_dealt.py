"""Tables whose tasks stay of one size as they grow."""

import pytest
from pyspark.sql import functions as F

from tarnflow.plans import layout_queries, tables


@pytest.mark.parametrize("n", [10, 100])
def test_parts_grow_with_the_table(spark, n):
    rows = spark.range(n * 40).select(F.col("id").alias("k"), F.when(F.col("id") % 9 > 0, F.repeat(F.lit("é"), 500)).alias("t"))
    out = tables.dealt(rows, "k", "t", 1 << 14)
    assert out.count() == n * 40
    out = out.withColumn("p", F.spark_partition_id())
    parts = out.groupBy("p").agg(F.sum(F.octet_length("t"))).collect()
    assert len(parts) > n * 40 * 1000 * 8 / 9 / (1 << 14) * 0.7 and max(size for _, size in parts) < 4 * (1 << 14)
    assert out.groupBy("k").agg(F.count_distinct("p").alias("n")).where("n > 1").isEmpty()


def test_no_text_at_all(spark):
    assert tables.dealt(spark.createDataFrame([], "k int, t string"), "k", "t", 9).count() == 0


@pytest.mark.parametrize("name", ["page_segments", "page_columns", "size_headings"])
def test_words_of_pages_are_not_moved(spark, tmp_path, name):
    rows = [(i, f"<h1>Title {i}</h1>" + "<p>some words, and Others of it</p>" * 60) for i in range(30)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = layout_queries.QUERIES[name](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Whole pages are dealt out, or the plan reads blocks that were made once.
    assert ("REPARTITION_BY_NUM" in plan and plan.count("Exchange ") == plan.count("REPARTITION_BY_")) if name == "page_segments" else "regexp_extract_all" not in plan
    assert name == "size_headings" or not out.isEmpty()


def test_words_and_boxes_of_pages_are_not_moved(spark, tmp_path):
    rows = [(i, f"<h1>Title {i}</h1>" + "<p>some words, and Others of it</p>" * 60) for i in range(30)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = layout_queries.QUERIES["text_outside_boxes"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Words and boxes meet where their pages were dealt out: no join and no other exchange.
    assert "Join" not in plan and plan.count("Exchange ") == plan.count("REPARTITION_BY_") > 0
    assert out.count() == 30
