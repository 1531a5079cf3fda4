"""Queries of operators/layout.py over `pages`, and the same in SQL.

The tables hold no laid-out pages, so words get their place from their offset in the html: 80 characters a row, 60 rows a sheet, every second page set in
two columns; tops, sizes and styles follow from the words, so that rows, gaps and sizes vary. Markup leaves gaps.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import layout
from .tables import dealt, read

BY = ["page_id", "sheet"]
WIDTH, HEIGHT = 672.0, 720.0
#: Bytes of html whose words a task places at a time; with their boxes they are many times as large.
PLACED = 1 << 20


def _words(spark, d):
    tokens = F.regexp_extract_all("html", F.lit(r"<[^>]*>|[^< \n\r\t]+|[ \n\r\t]+"), F.lit(0))
    # Pages are moved before they become words, and stay where they are in all windows over them.
    pages = dealt(read(spark, d, "pages").select("page_id", "html"), "page_id", "html", PLACED)
    rows = pages.select("page_id", F.posexplode(tokens).alias("word_no", "text")).withColumn("n", F.length("text"))
    before = F.sum("n").over(Window.partitionBy("page_id").orderBy("word_no")) - F.col("n")
    rows = rows.withColumn("o", before).where(r"NOT text LIKE '<%' AND NOT text RLIKE '^[ \n\r\t]'")
    rows = rows.selectExpr("*", "o div 80 AS r", "o % 80 AS c")
    return rows.selectExpr(
        "page_id", "r div 60 AS sheet", "word_no", "text", "r % 60 AS r", "c",
        "6.0D * c + CASE WHEN c >= 40 AND page_id % 2 = 0 THEN 96 ELSE 0 END AS x0",
        "6.0D * (c + n) + CASE WHEN c >= 40 AND page_id % 2 = 0 THEN 96 ELSE 0 END AS x1",
        "12.0D * (r % 60) + 1.5D * (n % 3) + CASE WHEN n % 7 = 0 THEN 4 ELSE 0 END AS top",
        "12.0D * (r % 60) + 1.5D * (n % 3) + CASE WHEN n % 7 = 0 THEN 4 ELSE 0 END + 10 AS bottom",
        "9.0D + n % 12 AS size", r"text RLIKE '^[A-Z]' AS bold", "text LIKE '%,' AS italic",
    )


def _segments(spark, d):
    return layout.segments(_words(spark, d), BY, WIDTH)


def page_segments(spark, d):
    texts = F.array_join(F.transform("runs", lambda r: r["text"]), "|")
    return _segments(spark, d).select(*BY, "row_id", "segment", F.md5("text").alias("text_md5"), "x0", "top", "x1", "bottom", "font_size", "bold", "italic", "n_words", F.md5(texts).alias("runs_md5"))


def text_outside_boxes(spark, d):
    words = _words(spark, d)
    boxes = words.where("r % 7 = 3 AND c BETWEEN 10 AND 50").groupBy(*BY, "r").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    left = layout.outside(words, boxes, BY)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ")
    return left.groupBy(*BY).agg(F.count("*").alias("n_words"), F.md5(text).alias("text_md5"))


def page_columns(spark, d):
    # Blocks are made once: the columns are found from them and joined with them.
    own = layout.columns(cut(_segments(spark, d).drop("runs")), BY, WIDTH, HEIGHT)
    return own.select(*BY, "row_id", "segment", "multi_column", "column", "reading_group", "place")


def size_headings(spark, d):
    kind, height = F.when(F.col("row_id") % 5 == 4, "table").otherwise("paragraph"), F.lit(HEIGHT)
    # Blocks are made once: sizes, ranks and headings are all of them.
    blocks = cut(_segments(spark, d).drop("runs")).withColumns({"kind": kind, "page_height": height})
    return layout.sized_headings(blocks, "page_id").where("heading_level IS NOT NULL").select(*BY, "row_id", "segment", "font_size", "heading_level")


def page_heading_paths(spark, d):
    """h1 to h6 of each page; paragraphs whose length leaves 1 over fours stand for headings of level 2 to 6, as the pages have few."""
    parts = F.regexp_extract_all("html", F.lit(r"<(h[1-6]|p|li)>[^<]*"), F.lit(0))
    rows = read(spark, d, "pages").select("page_id", F.posexplode(parts).alias("ordinal", "part"))
    rows = rows.selectExpr("page_id", "ordinal", "substring_index(part, '>', 1) AS tag", "btrim(substr(part, locate('>', part) + 1), ' ') AS text")
    level = "CASE WHEN tag LIKE '<h%' THEN int(substr(tag, 3)) WHEN tag = '<p' AND length(text) % 4 = 1 THEN 2 + length(text) % 5 END"
    rows = layout.heading_paths(rows.withColumn("heading_level", F.expr(level)), ["page_id"], ["ordinal"])
    return rows.select("page_id", "ordinal", "heading_level", F.size("heading_path").alias("depth"), F.md5(F.array_join("heading_path", "|")).alias("path_md5"))


QUERIES = {f.__name__: f for f in (page_segments, text_outside_boxes, page_columns, size_headings, page_heading_paths)}

_PLACED = """
6.0::DOUBLE * {} + CASE WHEN c >= 40 AND page_id % 2 = 0 THEN 96 ELSE 0 END"""

WORDS = rf"""
tok AS (SELECT page_id, t, i, sum(length(t)) OVER (PARTITION BY page_id ORDER BY i) - length(t) AS o FROM
  (SELECT page_id, unnest(l) AS t, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<[^>]*>|[^< \n\r\t]+|[ \n\r\t]+') AS l FROM pages))),
cells AS (SELECT page_id, t, i, length(t) AS n, (o // 80)::BIGINT AS line, (o % 80)::BIGINT AS c FROM tok WHERE NOT starts_with(t, '<') AND NOT regexp_matches(t, '^[ \n\r\t]')),
words AS (SELECT page_id, line // 60 AS sheet, i AS word_no, t AS text, line % 60 AS r, c, {_PLACED.format("c")} AS x0, {_PLACED.format("(c + n)")} AS x1,
  12.0::DOUBLE * (line % 60) + 1.5 * (n % 3) + CASE WHEN n % 7 = 0 THEN 4 ELSE 0 END AS top, top + 10 AS bottom, 9.0::DOUBLE + n % 12 AS size,
  regexp_matches(t, '^[A-Z]') AS bold, ends_with(t, ',') AS italic FROM cells)"""

SEGMENTS = rf"""
{WORDS},
begins AS (SELECT page_id, sheet, min(top) AS a FROM words GROUP BY ALL
  UNION ALL SELECT b.page_id, b.sheet, (SELECT min(w.top) FROM words w WHERE w.page_id = b.page_id AND w.sheet = b.sheet AND w.top > b.a + 3) AS next FROM begins b WHERE next IS NOT NULL),
firsts AS (SELECT page_id, sheet, a, row_number() OVER (PARTITION BY page_id, sheet ORDER BY a) - 1 AS row_id FROM begins),
rowed AS (SELECT w.*, f.row_id FROM words w ASOF JOIN firsts f ON w.page_id = f.page_id AND w.sheet = f.sheet AND w.top >= f.a),
gaps AS (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY page_id, sheet, row_id ORDER BY x0, top, word_no) > greatest(36, 672 * 0.08), false) AS cut FROM rowed),
cuts AS (SELECT *, sum(cut::INT) OVER (PARTITION BY page_id, sheet, row_id ORDER BY x0, top, word_no) AS segment FROM gaps),
styles AS (SELECT *, CASE WHEN lag((size, bold, italic)) OVER s IS DISTINCT FROM (size, bold, italic) AND lag(size) OVER s IS NOT NULL THEN '|' ELSE ' ' END AS mark
  FROM cuts WINDOW s AS (PARTITION BY page_id, sheet, row_id, segment ORDER BY x0, top, word_no)),
segments AS (SELECT page_id, sheet, row_id, segment::BIGINT AS segment, string_agg(text, ' ' ORDER BY x0, top, word_no) AS text, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom,
  median(size) AS font_size, bool_or(bold) AS bold, bool_or(italic) AS italic, count(*) AS n_words, substr(string_agg(mark || text, '' ORDER BY x0, top, word_no), 2) AS runs FROM styles GROUP BY ALL)"""

SQL = {
    "page_segments": f"WITH RECURSIVE {SEGMENTS} SELECT page_id, sheet, row_id, segment, md5(text) AS text_md5, x0, top, x1, bottom, font_size, bold, italic, n_words, md5(runs) AS runs_md5 FROM segments",
    "text_outside_boxes": f"""
WITH {WORDS},
boxes AS (SELECT page_id, sheet, min(x0) AS a, min(top) AS b, max(x1) AS c, max(bottom) AS d FROM words WHERE r % 7 = 3 AND c BETWEEN 10 AND 50 GROUP BY page_id, sheet, r)
SELECT page_id, sheet, count(*) AS n_words, md5(string_agg(text, ' ' ORDER BY word_no)) AS text_md5 FROM words w
WHERE NOT EXISTS (SELECT 1 FROM boxes x WHERE x.page_id = w.page_id AND x.sheet = w.sheet AND (w.x0 + w.x1) / 2 BETWEEN x.a AND x.c AND (w.top + w.bottom) / 2 BETWEEN x.b AND x.d)
GROUP BY ALL""",
    "page_columns": f"""
WITH RECURSIVE {SEGMENTS},
pairs AS (SELECT page_id, sheet, row_id, arg_min((x0, x1, top, length(text)), segment) AS a, arg_max((x0, x1, top, length(text)), segment) AS z FROM segments GROUP BY ALL HAVING count(*) > 1),
multi AS (SELECT page_id, sheet, median((a[2] + z[1]) / 2) AS line FROM pairs GROUP BY ALL
  HAVING count(*) FILTER (WHERE a[3] >= 720 * 0.03 AND a[3] <= 720 * 0.9 AND a[4] >= 6 AND z[4] >= 6 AND a[2] < 672 * 0.58 AND z[1] > 672 * 0.42) >= 2),
sided AS (SELECT s.*, m.line IS NOT NULL AS multi_column, CASE WHEN s.x1 <= line THEN 0 WHEN s.x0 >= line THEN 1 END AS side FROM segments s LEFT JOIN multi m USING (page_id, sheet)),
high AS (SELECT page_id, sheet, min(top) AS high FROM sided WHERE side IS NOT NULL GROUP BY ALL),
grouped AS (SELECT s.*, CASE WHEN NOT multi_column THEN NULL WHEN side IS NOT NULL THEN side + 1 WHEN top <= high THEN 0 ELSE 3 END AS reading_group FROM sided s LEFT JOIN high USING (page_id, sheet))
SELECT page_id, sheet, row_id, segment, multi_column, side AS "column", reading_group, row_number() OVER (PARTITION BY page_id, sheet ORDER BY coalesce(reading_group, 0), top, x0, row_id, segment) - 1 AS place FROM grouped""",
    "size_headings": f"""
WITH RECURSIVE {SEGMENTS},
texts AS (SELECT *, greatest(1, least(20, len(regexp_extract_all(text, '[^\\s]+')))) AS w FROM segments WHERE row_id % 5 <> 4),
body AS (SELECT page_id, median(font_size) AS body FROM (SELECT page_id, font_size, unnest(range(w)) FROM texts) GROUP BY 1),
large AS (SELECT t.*, round_even(font_size, 2) AS z FROM texts t JOIN body USING (page_id)
  WHERE font_size >= greatest(body + 1.5, body * 1.15) AND length(text) <= 180 AND NOT regexp_matches(text, '[.;,]$') AND top >= 720 * 0.015 AND bottom <= 720 * 0.985)
SELECT page_id, sheet, row_id, segment, font_size, least(6, dense_rank() OVER (PARTITION BY page_id ORDER BY z DESC)) AS heading_level FROM large""",
    "page_heading_paths": """
WITH RECURSIVE parts AS (SELECT page_id, unnest(l) AS p, unnest(range(len(l))) AS ordinal FROM (SELECT page_id, regexp_extract_all(html, '<(h[1-6]|p|li)>[^<]*') AS l FROM pages)),
blocks AS (SELECT page_id, ordinal, p, trim(substr(p, instr(p, '>') + 1), ' ') AS text, length(trim(substr(p, instr(p, '>') + 1), ' ')) AS n FROM parts),
leveled AS (SELECT *, CASE WHEN starts_with(p, '<h') THEN p[3]::INT WHEN starts_with(p, '<p') AND n % 4 = 1 THEN 2 + n % 5 END AS level FROM blocks),
walk AS (SELECT page_id, -1::BIGINT AS ordinal, []::VARCHAR[] AS path FROM leveled WHERE ordinal = 0
  UNION ALL SELECT l.page_id, l.ordinal, CASE WHEN level IS NULL THEN path ELSE list_append(path[1:level - 1], text) END FROM walk w JOIN leveled l ON l.page_id = w.page_id AND l.ordinal = w.ordinal + 1)
SELECT page_id, ordinal, level AS heading_level, len(path) AS depth, md5(array_to_string(path, '|')) AS path_md5 FROM walk JOIN leveled USING (page_id, ordinal)""",
}
