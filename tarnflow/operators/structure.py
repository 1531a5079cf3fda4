"""Trees in tables: properties inherited along links to parents, and tables nested in cells of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: A key with more than one row in so many is hot: its one table row is broadcast, so there are fewer than so many of them.
HOT_SHARE = 128


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows left joined with table, which has one row a key. Keys of very many rows do not go through one task."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    hot = [r[key] for r in counts.where(F.col("n") * HOT_SHARE > max(total, HOT_SHARE)).select(key).collect()]
    if not hot:
        return rows.join(table, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    rest = rows.where(~is_hot).join(table.where(~F.col(key).isin(hot)), key, "left")
    return rest.unionByName(rows.where(is_hot).join(F.broadcast(table.where(F.col(key).isin(hot))), key, "left"))


def inherited(nodes: DataFrame, key: str, parent: str, properties: list[str]) -> DataFrame:
    """nodes with each property taken from the nearest of the node and its ancestors that has one (else null), and <property>_from, that node's key.

    Pointers jump: after k rounds a node knows the nearest value among 2^k ancestors and points to the one after them, so chains of n links take log2 n rounds.
    A chain ends at a null or unknown parent. As long as any walk has an end or a value ahead, one of them comes to it in each round; so once a round
    ends none, what is left goes round in rings without a value. Of rows of one key the smallest by parent and properties is the parent of others; each row keeps its own values. Rows
    without a key are nobody's parent.
    """
    own = lambda p: F.when(F.col(p).isNotNull(), F.struct(F.col(p).alias("value"), F.col(key).alias("of"))).alias(f"_{p}")
    state = nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(parent).alias("_up"), *properties)).alias("r")).select(key, "r.*")
    # A row that is its own parent ends its chain.
    state = cut(state.select(F.col(key).alias("_key"), F.when(F.col("_up") != F.col(key), F.col("_up")).alias("_up"), *(own(p) for p in properties)))
    lacks = F.lit(False)
    for p in properties:
        lacks = lacks | F.col(f"_{p}").isNull()
    parts, before = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), None
    while (n := state.where(lacks & F.col("_up").isNotNull()).count()) and n != before:
        before = n
        open_rows = state.where(lacks & F.col("_up").isNotNull())
        above = state.select(F.col("_key").alias("_up"), F.col("_up").alias("_next"), *(F.col(f"_{p}").alias(f"_{p}_above") for p in properties))
        met = looked_up(open_rows, above, "_up")
        met = met.select("_key", F.col("_next").alias("_up"), *(F.coalesce(f"_{p}", f"_{p}_above").alias(f"_{p}") for p in properties))
        # A union has the partitions of all its parts; without this they would double each round.
        state = cut(state.where(~(lacks & F.col("_up").isNotNull())).unionByName(met).coalesce(parts))
    found = state.select(F.col("_key").alias("_parent"), *(F.col(f"_{p}") for p in properties))
    rows = looked_up(nodes.withColumn("_parent", F.col(parent)), found, "_parent")
    for p in properties:
        rows = rows.withColumn(f"{p}_from", F.when(F.col(p).isNotNull(), F.col(key)).otherwise(F.col(f"_{p}.of"))).withColumn(p, F.coalesce(F.col(p), F.col(f"_{p}.value")))
    return rows.drop("_parent", *(f"_{p}" for p in properties))


def _joined(items: Column, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), by)


def rendered_tables(parts: DataFrame, by: list[str]) -> DataFrame:
    """Tables as texts. parts: by (their document), table, row, cell, part, text or nested (the key of a table of that document) or neither (an empty cell).
    by, table, text of the tables that stand in no cell.

    Texts of a cell come first, then its tables, each in order of part, joined by " / "; cells by " | ", rows by new lines. A nested table is announced
    and set in by two spaces for each table around it. Blank texts, empty tables and rows without text are left out. The deepest tables are made first,
    so a level costs one pass over its own parts. Tables that hold each other stand in no table of the page and are left out; a part of two tables is in both.
    """
    key = [*by, "table"]
    # Parts are made once: levels and texts are all of them.
    parts = cut(parts.select(*key, "row", "cell", "part", F.trim("text").alias("text"), "nested"))
    tables = parts.select(*key).distinct()
    links = parts.where("nested IS NOT NULL").select(*key, "nested")
    level = cut(tables.join(links.select(*by, F.col("nested").alias("table")), key, "left_anti"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        level = cut(links.join(level, key).select(*by, F.col("nested").alias("table")).distinct().join(tables, key))
    if not levels:
        return tables.withColumn("text", F.lit("")).where("false")
    below, placed = None, levels[0].withColumn("_depth", F.lit(0))
    for depth, one in enumerate(levels[1:], 1):
        placed = placed.unionByName(one.withColumn("_depth", F.lit(depth)))
    placed = cut(parts.join(placed, key))
    for depth in range(len(levels) - 1, -1, -1):
        own = placed.where(F.col("_depth") == depth).drop("_depth")
        texts = own.where("nested IS NULL").select(*key, "row", "cell", F.lit(0).alias("kind"), "part", "text")
        if below is not None:
            pad = F.lit("  " * (depth + 1))
            inner = below.select(*by, F.col("table").alias("nested"), F.concat(F.lit("[Nested table]\n"), pad, F.regexp_replace("text", "\n", "\n" + "  " * (depth + 1))).alias("inner"))
            held = own.where("nested IS NOT NULL").join(inner, [*by, "nested"], "left")
            texts = texts.unionByName(held.select(*key, "row", "cell", F.lit(1).alias("kind"), "part", F.col("inner").alias("text")))
        said = F.when(F.col("text") != "", F.struct("kind", "part", "text"))
        cells = texts.groupBy(*key, "row", "cell").agg(_joined(F.collect_list(said), " / ").alias("text"))
        rows = cells.groupBy(*key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda x: x["text"]), " | ").alias("text"))
        line = F.when(F.btrim("text", F.lit(" |")) != "", F.struct("row", "text"))
        below = cut(rows.groupBy(*key).agg(_joined(F.collect_list(line), "\n").alias("text")).where("text <> ''"))
    return below
