"""Layout of pages from the boxes of their words: rows, segments, tables, columns, headings and heading paths.

A words table has the columns of `by` (a document and its page), word_no (order of reading), text, x0, top, x1, bottom, size, bold, italic. A page, and a
document's blocks, come from one file of bounded size, so windows over them are bounded too.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units between the tops of words of one row; the least gap between segments, in units and as a share of the page's width.
ROW_UNITS, GAP_UNITS, GAP_SHARE = 3.0, 36.0, 0.08
LEVELS = 6


def rows_of_words(words: DataFrame, by: list[str], units: float = ROW_UNITS) -> DataFrame:
    """words with row_id (from 0, downwards): a row is begun by the highest word that no row has yet, and takes those at most `units` below it.

    A chain of words each near the next is cut by the distance to the row's first word, so gaps alone do not tell rows. Tops are cut into runs without a
    larger gap; of each run the first words of rows are found by a fold over its distinct tops. All are windows within a page, so words that are already
    dealt out by page, or by document, are not moved again. Words without a top are left out.
    """
    words = words.where("top IS NOT NULL")
    page = Window.partitionBy(*by).orderBy("top")
    # Words of one top are peers: the first of them has the gap, and the running sum counts it for all.
    new = F.coalesce((F.col("top") - F.lag("top").over(page) > units).cast("int"), F.lit(0))
    runs = words.withColumn("_new", new).withColumn("_run", F.sum("_new").over(page))
    none = F.array().cast("array<double>")

    def begin(found: Column, top: Column) -> Column:
        return F.when((F.size(found) == 0) | (top - F.element_at(found, -1) > units), F.concat(found, F.array(top))).otherwise(found)

    tops = F.array_sort(F.collect_set(F.col("top").cast("double")).over(Window.partitionBy(*by, "_run")))
    rows = runs.withColumn("_tops", tops)
    first = F.array_max(F.filter(F.aggregate("_tops", none, begin), lambda x: x <= F.col("top")))
    rows = rows.withColumn("_first", first).drop("_new", "_run", "_tops")
    return rows.withColumn("row_id", F.dense_rank().over(Window.partitionBy(*by).orderBy("_first")) - 1).drop("_first")


def segments(words: DataFrame, by: list[str], width: Column | float, units: float = ROW_UNITS) -> DataFrame:
    """Rows cut where the gap to the next word is over max(GAP_UNITS, GAP_SHARE * width): by, row_id, segment (from 0, to the right), text (words joined by a
    space), x0, top, x1, bottom (the box of its words), font_size (median), bold, italic (any word's), n_words, runs (words that follow each
    other in one style, as text, size, bold, italic).

    Words of equal place keep their order. A null size, bold or italic counts as 0 or false; words with a null text, x0 or x1 are left out.
    """
    words = words.where("text IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL")
    words = words.withColumns({"size": F.coalesce(F.col("size").cast("double"), F.lit(0.0)), "bold": F.coalesce("bold", F.lit(False)), "italic": F.coalesce("italic", F.lit(False))})
    limit = F.greatest(F.lit(GAP_UNITS), width * F.lit(GAP_SHARE) if isinstance(width, Column) else F.lit(width * GAP_SHARE))
    row = Window.partitionBy(*by, "row_id").orderBy("x0", "top", "word_no")
    wide = F.coalesce((F.col("x0") - F.lag("x1").over(row) > limit).cast("int"), F.lit(0))
    cut = rows_of_words(words, by, units).withColumn("_wide", wide).withColumn("segment", F.sum("_wide").over(row))
    inner = Window.partitionBy(*by, "row_id", "segment").orderBy("x0", "top", "word_no")
    style = F.struct("size", "bold", "italic")
    changed = F.coalesce((~style.eqNullSafe(F.lag(style).over(inner))).cast("int"), F.lit(0))
    cut = cut.withColumn("_run", changed).withColumn("_run", F.sum("_run").over(inner))
    word = F.struct("x0", "top", "word_no", "text")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda w: w["text"]), " ")
    runs = cut.groupBy(*by, "row_id", "segment", "_run", "size", "bold", "italic").agg(
        text(word).alias("text"), F.count("*").alias("n"), F.collect_list("size").alias("sizes"),
        *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "top"), (F.max, "x1"), (F.max, "bottom"))),
    )
    whole = F.array_sort(F.collect_list(F.struct("_run", "text", "size", "bold", "italic")))
    sizes = F.array_sort(F.flatten(F.collect_list("sizes")))
    out = runs.groupBy(*by, "row_id", "segment").agg(
        whole.alias("_runs"), sizes.alias("_sizes"), F.sum("n").alias("n_words"), F.max("bold").alias("bold"), F.max("italic").alias("italic"),
        *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "top"), (F.max, "x1"), (F.max, "bottom"))),
    )
    n = F.size("_sizes")
    middle = (F.element_at("_sizes", F.floor((n + 1) / 2).cast("int")) + F.element_at("_sizes", F.floor(n / 2 + 1).cast("int"))) / 2
    joined = F.btrim(F.array_join(F.transform("_runs", lambda r: r["text"]), " "))
    runs = F.transform("_runs", lambda r: r.dropFields("_run"))
    return out.select(*by, "row_id", "segment", joined.alias("text"), "x0", "top", "x1", "bottom", middle.alias("font_size"), "bold", "italic", "n_words", runs.alias("runs"))


def outside(words: DataFrame, boxes: DataFrame, by: list[str], base: float = 32.0) -> DataFrame:
    """words whose centre lies in no box of their page (edges belong to a box). boxes: by, x0, top, x1, bottom.

    Boxes fall into grids by their size, each with cells as wide as its largest boxes, so a box meets four cells at most; a word looks into one cell of
    each grid that is in use. So no word meets every box. Boxes with a null edge, or turned inside out, hold nothing; so do null centres.

    Words and boxes of a cell meet in one window instead of a join, so what is dealt out alike by page, or by document, is not moved again. Beside the
    first grid a word is there with its place only.
    """
    named = lambda names: reduce(and_, (F.col(c).isNotNull() for c in names))
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top"), F.lit(base))
    held = boxes.where("x0 <= x1 AND top <= bottom").where(named(by)).withColumn("_grid", F.ceil(F.log2(size / base)).cast("int"))
    grids = [r["_grid"] for r in held.select("_grid").distinct().collect()]  # one a power of two
    if not grids:
        return words
    cell = lambda x, grid: F.floor(x / (F.lit(base) * F.pow(F.lit(2.0), grid))).cast("long")
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a), F.col("_grid")), cell(F.col(b), F.col("_grid"))))
    edges = ("x0", "top", "x1", "bottom")
    held = held.select(*by, "_grid", *(F.col(c).alias(f"_{c}") for c in edges)).dropDuplicates()
    held = held.withColumn("_cx", span("_x0", "_x1")).withColumn("_cy", span("_top", "_bottom"))
    held = held.select(*by, "_grid", "_cx", "_cy", F.struct(*(F.col(f"_{c}").alias(c) for c in edges)).alias("_box"))
    keys = [*by, "word_no"]
    first = F.col("_grid") == grids[0]
    asked = words.withColumns({"_x": (F.col("x0") + F.col("x1")) / 2, "_y": (F.col("top") + F.col("bottom")) / 2, "_grid": F.explode(F.array(*map(F.lit, grids)))})
    asked = asked.withColumns({c: F.when(first, F.col(c)) for c in words.columns if c not in keys})
    asked = asked.withColumns({"_cx": cell(F.col("_x"), F.col("_grid")), "_cy": cell(F.col("_y"), F.col("_grid")), "_first": first})
    near = F.collect_list("_box").over(Window.partitionBy(*by, "_grid", "_cx", "_cy"))
    inside = F.exists("_near", lambda b: F.col("_x").between(b["x0"], b["x1"]) & F.col("_y").between(b["top"], b["bottom"]))
    met = asked.unionByName(held, allowMissingColumns=True).withColumn("_near", near).where("_first IS NOT NULL")
    met = met.withColumn("_hit", F.coalesce(inside & named(keys), F.lit(False))).where("_first OR _hit")
    left = met.withColumn("_hit", F.bool_or("_hit").over(Window.partitionBy(*keys))).where("_first AND NOT _hit")
    return left.select(*words.columns)


def columns(blocks: DataFrame, by: list[str], width: float, height: float) -> DataFrame:
    """Reading order of a page's blocks. blocks: by, row_id (null: a table), segment, text, x0, top, x1, bottom. With multi_column, column, reading_group and
    place (from 0).

    A page has two columns if two of its rows or more do: first and last segment of 6 characters or more, the first ending before 58 % of the width, the last
    beginning after 42 %, the row between 3 and 90 % of the height. The line between them is the median of the middles of the rows' gaps. Blocks
    left of it are read first, then those right of it; what lies across comes before if it is not lower than the highest block of a column, else after.
    """
    segment = F.struct("x0", "segment", "x1", "top", F.length("text").alias("chars"))
    rows = blocks.where("row_id IS NOT NULL").groupBy(*by, "row_id").agg(F.min(segment).alias("a"), F.max(segment).alias("z"), F.count("*").alias("n")).where("n > 1")
    both = (F.col("a.top").between(height * 0.03, height * 0.90)) & (F.col("a.chars") >= 6) & (F.col("z.chars") >= 6)
    both = both & (F.col("a.x1") < width * 0.58) & (F.col("z.x0") > width * 0.42)
    pages = rows.groupBy(*by).agg(F.count_if(both).alias("_rows"), F.median((F.col("a.x1") + F.col("z.x0")) / 2).alias("_line")).where("_rows >= 2").drop("_rows")
    own = blocks.join(pages, by, "left")
    page = Window.partitionBy(*by)
    multi = F.col("_line").isNotNull()
    column = F.when(F.col("x1") <= F.col("_line"), 0).when(F.col("x0") >= F.col("_line"), 1)
    own = own.withColumn("multi_column", multi).withColumn("column", column)
    high = F.min(F.when(F.col("column").isNotNull(), F.col("top"))).over(page)
    group = F.when(multi, F.when(F.col("column").isNotNull(), F.col("column") + 1).when(F.col("top") <= high, 0).otherwise(3))
    own = own.withColumn("reading_group", group)
    order = Window.partitionBy(*by).orderBy(F.coalesce("reading_group", F.lit(0)), "top", "x0", F.col("row_id").asc_nulls_last(), "segment")
    return own.withColumn("place", F.row_number().over(order) - 1).drop("_line")


def body_size(blocks: DataFrame, by: str = "document_id") -> DataFrame:
    """by, body_size: the median of font sizes, a block counting once for each of its words, up to 20. Sums by size first, so no document's blocks meet in
    one place. Blocks without a size do not count."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    weight = F.greatest(F.lit(1), F.least(F.lit(20), words)).cast("long")
    sizes = blocks.where("font_size IS NOT NULL").groupBy(by, F.col("font_size").cast("double").alias("size")).agg(F.sum(weight).alias("w"))
    upto = F.sum("w").over(Window.partitionBy(by).orderBy("size"))
    all_ = F.sum("w").over(Window.partitionBy(by))
    placed = sizes.withColumn("_upto", upto).withColumn("_all", all_)
    # The middle weight, or both of an even number of them.
    first, second = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    reached = lambda k: F.min(F.when(F.col("_upto") >= k, F.col("size")))
    return placed.groupBy(by).agg(((reached(first) + reached(second)) / 2).alias("body_size"))


def sized_headings(blocks: DataFrame, by: str = "document_id") -> DataFrame:
    """blocks: by, text, kind, font_size, top, bottom, page_height. With heading_level (1 to LEVELS, null for other blocks): of blocks of text those clearly larger than the
    body, short, of one line, without an end of a sentence and not at the very edge of a page; the largest size is level 1, and so on. Blocks that are
    headings already keep their level, or get 1."""
    is_text = F.col("kind").isin("paragraph", "list_item", "formula") & F.col("font_size").isNotNull()
    sizes = body_size(blocks.where(is_text), by)
    own = blocks.join(sizes, by, "left")
    edge = F.coalesce((F.col("page_height") > 0) & ((F.col("top") < F.col("page_height") * 0.015) | (F.col("bottom") > F.col("page_height") * 0.985)), F.lit(False))
    stripped = F.regexp_replace("text", r"(?U)\s+$", "")
    one_line = (F.col("text") != "") & ~F.regexp_replace("text", r"(\r\n|[\n\r])$", "").rlike(r"[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    large = F.col("font_size") >= F.greatest(F.col("body_size") + 1.5, F.col("body_size") * 1.15)
    fits = is_text & large & (F.length("text") <= 180) & one_line & ~stripped.rlike(r"[.;,]$") & ~edge
    own = own.withColumn("_size", F.when(F.coalesce(fits, F.lit(False)), F.bround(F.col("font_size").cast("double"), 2)))
    ranks = own.where("_size IS NOT NULL").select(by, "_size").distinct()
    ranks = ranks.withColumn("_level", F.least(F.lit(LEVELS), F.dense_rank().over(Window.partitionBy(by).orderBy(F.desc("_size")))))
    given = F.when(F.col("kind") == "heading", F.coalesce(F.col("heading_level"), F.lit(1)) if "heading_level" in blocks.columns else F.lit(1))
    out = own.join(ranks, [by, "_size"], "left").withColumn("heading_level", F.coalesce("_level", given))
    return out.drop("_size", "_level", "body_size")


def heading_paths(blocks: DataFrame, by: list[str], order: list[str], text: str = "text", level: str = "heading_level") -> DataFrame:
    """blocks with heading_path: the headings above each block, a heading's own last. level: from 1; null for blocks that are no headings.

    A heading of level k is put after the first k - 1 headings of the path before it, or after all of them if they are fewer. So the path's length after the
    i-th heading is the least of i and of level_j + i - j over the headings j up to it: a running minimum. The heading at each place of the path is
    the last one that was put there. Levels over LEVELS count as LEVELS, those under 1 as 1; a null text counts as empty.
    """
    up_to = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.col(level)))
    rows = blocks.withColumn("_i", F.count(level).over(up_to))
    least = F.min(F.when(F.col(level).isNotNull(), own - F.col("_i"))).over(up_to)
    rows = rows.withColumn("_length", (F.col("_i") + F.least(F.lit(0), F.coalesce(least, F.lit(0)))).cast("int"))
    put = lambda k: F.when(F.col(level).isNotNull() & (F.col("_length") == k), F.coalesce(text, F.lit("")))
    places = F.array(*(F.last(put(k), ignorenulls=True).over(up_to) for k in range(1, LEVELS + 1)))
    return rows.withColumn("heading_path", F.slice(places, F.lit(1), F.col("_length"))).drop("_i", "_length")
