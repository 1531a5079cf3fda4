"""A manifest of a dataset: trees of hashes over its rows, and a proof for each row.

Rows are leaves, one tree a language; the roots of these trees are leaves of one more. Of each tree the number of leaves is known, so the number of
children of each node is too.

1. Leaves get their place in their tree from a range partitioning by language and id: their place within their part, plus the rows of earlier parts.
2. Each part folds its leaves into a forest: nodes not yet joined, keyed by tree, level and index. Adding a node that completes its run of
   siblings takes the run out and adds the parent. Forests form a commutative monoid, so parts can be merged in any order; they are merged
   in a tree of tasks, neighbours first, so that each holds few nodes besides the two edges of its range.
3. Runs that were taken out are kept as rows. From the roots downward each level's runs meet the paths of their parents; leaves meet the lowest
   runs last, so a path is carried for every eighth leaf only, and no task ever sees more than its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY = 8
FAN = 16
#: Leaves of a part.
PART_ROWS = 1_000_000
OPEN, RUN, ROOT = 0, 1, 2
_FOREST = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string()))])
_FOREST_SQL = "kind int, part long, tree string, n long, level int, idx long, digest string, children array<string>"


class Forest:
    """Nodes that wait for siblings. `done` gathers the rows of runs and roots that have been taken out."""

    def __init__(self):
        self.waiting: dict[tuple[str, int, int], dict[int, str]] = {}
        self.leaves: dict[str, int] = {}
        self.done: list[tuple] = []

    def add(self, tree: str, n: int, level: int, idx: int, digest: str) -> None:
        """n: leaves of the whole tree."""
        while True:
            width = -(-n // ARITY**level)
            if width == 1:
                self.done.append((ROOT, None, tree, n, level, 0, digest, None))
                return
            parent = idx // ARITY
            run = self.waiting.setdefault((tree, level, parent), {})
            run[idx] = digest
            if len(run) < min(ARITY, width - ARITY * parent):
                self.leaves[tree] = n
                return
            del self.waiting[tree, level, parent]
            children = [run[i] for i in sorted(run)]
            self.done.append((RUN, None, tree, n, level, parent, None, children))
            level, idx, digest = level + 1, parent, hashlib.sha256("".join(children).encode()).hexdigest()

    def open_rows(self, part: int) -> list[tuple]:
        return [(OPEN, part, tree, self.leaves[tree], level, i, d, None) for (tree, level, _), run in self.waiting.items() for i, d in run.items()]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOREST, strict=True)], schema=_FOREST) if rows else _FOREST.empty_table()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves by part: rows of what each part has joined, and of what it leaves open."""
    part, forest = None, Forest()
    for batch in batches:
        for p, tree, n, idx, leaf in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if p != part:
                if rows := forest.open_rows(part):
                    yield from _table(rows).to_batches()
                part, forest.waiting, forest.leaves = p, {}, {}
            forest.add(tree, n, 0, idx, leaf)
        if forest.done:
            yield from _table(forest.done).to_batches()
            forest.done = []
    if rows := forest.open_rows(part):
        yield from _table(rows).to_batches()


def _merge(nodes: pa.Table) -> pa.Table:
    """Open nodes of neighbouring parts: one forest."""
    forest, part = Forest(), nodes.column("up")[0].as_py()
    for row in zip(*(nodes.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "digest")), strict=True):
        forest.add(*row)
    return _table(forest.done + forest.open_rows(part))


def indexed(rows: DataFrame, tree: str, order: list[str], name: str) -> tuple[DataFrame, int]:
    """rows with part, idx (place within its tree, by order) and n (rows of its tree), and the number of parts. tree: a column without nulls."""
    total = rows.count()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))
    dealt = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), f"{name}-dealt")
    sizes = dealt.groupBy("part", tree).agg(F.min("at").alias("from"), F.count("*").alias("rows"))
    so_far = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.select("part", tree, (F.sum("rows").over(so_far) - F.col("rows") - F.col("from")).alias("shift"), F.sum("rows").over(Window.partitionBy(tree)).alias("n"))
    placed = dealt.join(sizes, ["part", tree]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "shift")
    return written(placed, f"{name}-placed"), parts


def grown(leaves: DataFrame, tree: str, parts: int, name: str) -> tuple[DataFrame, DataFrame]:
    """leaves: part, tree, n, idx, leaf. (runs: tree, level, idx of the parent, children), (roots: tree, n, level, digest)."""
    rows = leaves.select("part", F.col(tree).alias("tree"), "n", "idx", "leaf").sortWithinPartitions("part", "tree", "idx")
    tables, k = [written(rows.mapInArrow(_fold, _FOREST_SQL), f"{name}-forest")], 0
    while parts > 1:
        parts, k = -(-parts // FAN), k + 1
        nodes = tables[-1].where(F.col("kind") == OPEN).withColumn("up", F.floor(F.col("part") / FAN))
        tables.append(written(nodes.groupBy("up").applyInArrow(_merge, _FOREST_SQL), f"{name}-merged-{k}"))
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    runs = every.where(F.col("kind") == RUN).select("tree", "level", "idx", "children")
    return runs, every.where(F.col("kind") == ROOT).select("tree", "n", "level", "digest")


def _step(pos):
    """The siblings left and right of a place of a run, as texts."""
    text = lambda a, n: F.array_join(F.slice("children", a, n), "")
    return F.struct(text(F.lit(1), pos).alias("left"), text(pos + 2, F.lit(ARITY)).alias("right"))


def lowest(runs: DataFrame, roots: DataFrame) -> DataFrame:
    """roots: tree, n, level, path, and columns to carry. For each run of leaves: tree, idx of its parent, children, path from the parent to the root, and the
    carried columns; for a tree of one leaf one row without children."""
    carried = [c for c in roots.columns if c not in ("n", "level", "path", "tree")]
    top = (roots.agg(F.max("level").alias("level")).first() or [None])["level"] or 0
    own = lambda level: roots.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), "path", *carried)
    nodes = own(top)
    for level in range(top - 1, -1, -1):
        met = runs.where(F.col("level") == level).select("tree", "idx", "children").join(nodes, ["tree", "idx"])
        if not level:
            single = own(0).select("tree", "idx", F.lit(None).cast("array<string>").alias("children"), "path", *carried)
            return met.select("tree", "idx", "children", "path", *carried).unionByName(single)
        below = met.select("tree", "idx", "children", "path", *carried, F.posexplode("children").alias("pos", "_"))
        below = below.select("tree", (F.col("idx") * ARITY + F.col("pos")).alias("idx"), F.concat(F.array(_step(F.col("pos"))), F.col("path")).alias("path"), *carried)
        nodes = own(level).unionByName(below)
    return nodes.select("tree", "idx", F.lit(None).cast("array<string>").alias("children"), "path", *carried)


def with_path(leaves: DataFrame, tree: str, runs: DataFrame) -> DataFrame:
    """leaves with path: the siblings on its way to the root, lowest first, and the columns that runs (of lowest) carry."""
    at = leaves.withColumn("parent", F.floor(F.col("idx") / ARITY)).join(runs.withColumnsRenamed({"tree": tree, "idx": "parent", "path": "above"}), [tree, "parent"])
    pos = (F.col("idx") % ARITY).cast("int")
    return at.withColumn("path", F.when(F.col("children").isNull(), F.col("above")).otherwise(F.concat(F.array(_step(pos)), F.col("above")))).drop("children", "above", "parent")


def leaf_digest(columns: list):
    """sha256 of columns, each as its number of bytes, a colon and its text, or - if null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(part(c.cast("string")) for c in columns)), 256)


def manifest(rows: DataFrame, tampered=None) -> DataFrame:
    """rows: doc_id, source, lang, n_chars, text; other columns are left alone. tampered: a condition on rows whose text has A-Z in lower case when it
    is checked. A row per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Any column may be null. Rows of one doc_id follow each other by their leaves; rows alike are leaves of their own, next to each other. A tree of one
    leaf is that leaf; where nothing lies beside the way to the root the proof is that of the empty text. No rows: no rows.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    checked = F.when(tampered, leaf_digest([*columns[:4], changed])) if tampered is not None else F.lit(None).cast("string")
    # Languages in byte order, null first, as a text without nulls; a number a row tells rows alike apart in the partitioning.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    own = rows.select("doc_id", leaf_digest(columns).alias("leaf"), checked.alias("checked"), tree.alias("lang_tree"))
    own = written(own.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves, parts = indexed(own, "lang_tree", ["doc_id", "leaf", "row"], "leaves")
    runs, roots = grown(leaves, "lang_tree", parts, "leaves")
    # The tree of the languages' roots.
    subroots = roots.select("tree", "n", "level", F.col("digest").alias("leaf"), F.lit("").alias("all"))
    tops, top_parts = indexed(subroots.drop("n"), "all", ["tree"], "subroots")
    top_runs, top_roots = grown(tops, "all", top_parts, "subroots")
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    top_lowest = lowest(top_runs, top_roots.select("tree", "n", "level", no_path.alias("path"), F.col("digest").alias("root")))
    paths = with_path(tops.select("tree", "level", "leaf", "idx", "all"), "all", top_lowest)
    paths = written(paths.select("tree", F.lit(0).alias("n"), "level", "path", F.col("leaf").alias("subroot"), "root"), "paths")
    proofs = with_path(leaves, "lang_tree", lowest(runs, paths))
    siblings = F.array_join(F.flatten(F.transform("path", lambda x: F.array(x["left"], x["right"]))), "")
    folded = F.aggregate("path", F.coalesce("checked", "leaf"), lambda digest, x: F.sha2(F.concat(x["left"], digest, x["right"]), 256))
    out = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
