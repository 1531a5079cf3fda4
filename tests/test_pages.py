"""Texts of pages and which page of an address is read."""

from pyspark.sql import functions as F

from tarnflow.operators import web
from tarnflow.plans import queries


def test_only_ended_references_are_decoded_where_asked():
    html = "<p>a &amp b&amp</p><p>&lt;c&gt; &ampx; &am &#65; &#66 &copy;&</p>"
    assert web.html_text(html) == "a & b&\n\n<c> &x; &am A B ©&"
    assert web.html_text(html, ended=True) == "a &amp b&amp\n\n<c> &ampx; &am A &#66 ©&"


def _pages(spark, folder, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_the_query_decodes_as_its_sql(spark, tmp_path):
    d = _pages(spark, tmp_path, [(1, "http://a.example/", "<h1>x &amp</h1><p>&amp;lt;</p>")])
    assert [tuple(r) for r in queries.page_text(spark, d).collect()] == [(1, "x &amp\n\n&lt;")]


def test_of_one_address_the_smallest_page_stays(spark, tmp_path):
    rows = [(i, f"http://a.example/{i % 7}{'#top' if i % 2 else '?ref=x'}", f"<p>page {i}</p>") for i in range(70, 0, -1)]
    got = queries.page_dedup(spark, _pages(spark, tmp_path, rows)).select("content_sha256")
    wanted = spark.createDataFrame([(f"page {i}",) for i in range(1, 8)], "t string").select(F.sha2(F.encode("t", "UTF-8"), 256))
    assert sorted(got.collect()) == sorted(wanted.collect())
