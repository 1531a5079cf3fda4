"""Sessions of events that come late: every version of each session, and which later version retracts it.

Events come in batches. After each batch a user's events so far form sessions: neighbours in time at most `gap` apart share one. A session that
holds an event of the batch is a new version and retracts the earlier standing sessions it contains.

1. Points. Events of one user, second and batch are summed where they are read. Timelines are cut into cells of fixed length, so a user with a
   large share of all rows is spread over many keys; within a cell and a batch, points at most `gap` apart are one interval: they come at
   once and always share a session. So a cell has at most one interval per gap and batch, however many events it holds.
2. Units. Sessions of all events, at any batch, never cross a gap that is there in the end. Gaps within a cell are found by a window over the
   cell, those across cells by a window over one row a cell. Units go to tasks by user and start.
3. Tree. Of each unit, batch after batch, intervals are put into a splay tree. A node knows the extent, the sums and the largest inner gap of
   its subtree, so from an inserted interval the search outward skips subtrees without a gap and ends at the breaks that bound its session.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP, CELL = 420, 6 * 3600
_NODES = ["user", "unit", "batch", "start", "end", "n", "total"]
_VERSION = ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "total", "retracted_batch", "retracted_start_s"]


class ActiveEvents:
    """A splay tree of disjoint intervals in time order. Index 0 stands for no node."""

    def __init__(self, gap: int):
        self.limit, self.root = gap, 0
        self.left, self.right = [0], [0]
        self.start, self.end, self.n, self.total = [0], [0], [0], [0]
        self.first, self.last, self.widest, self.count, self.sum = [0], [0], [0], [0], [0]  # of the subtree

    def _update(self, x: int) -> None:
        a, b = self.left[x], self.right[x]
        first, last, widest, count, total = self.start[x], self.end[x], 0, self.n[x], self.total[x]
        if a:
            widest = max(self.widest[a], first - self.last[a])
            first = self.first[a]
            count += self.count[a]
            total += self.sum[a]
        if b:
            widest = max(widest, self.widest[b], self.first[b] - last)
            last = self.last[b]
            count += self.count[b]
            total += self.sum[b]
        self.first[x], self.last[x], self.widest[x], self.count[x], self.sum[x] = first, last, widest, count, total

    def _rotate(self, parent: int, x: int) -> None:
        if self.left[parent] == x:
            self.left[parent], self.right[x] = self.right[x], parent
        else:
            self.right[parent], self.left[x] = self.left[x], parent
        self._update(parent)

    def _splay(self, path: list[int]) -> int:
        """Bring the last node of a path from a root up to that root."""
        x = path.pop()
        while path:
            parent = path.pop()
            if not path:
                self._rotate(parent, x)
                break
            above = path.pop()
            if (self.left[above] == parent) == (self.left[parent] == x):
                self._rotate(above, parent)
                self._rotate(parent, x)
            else:
                if self.left[above] == parent:
                    self._rotate(parent, x)
                    self.left[above] = x
                else:
                    self._rotate(parent, x)
                    self.right[above] = x
                self._rotate(above, x)
            if path:
                if self.left[path[-1]] == above:
                    self.left[path[-1]] = x
                else:
                    self.right[path[-1]] = x
        self._update(x)
        return x

    def _split(self, x: int, keys: list[int], bound: int) -> tuple[int, int]:
        """Trees of the nodes whose key is under bound, and of the others."""
        path = []
        while x:
            path.append(x)
            x = self.right[x] if keys[x] < bound else self.left[x]
        if not path:
            return 0, 0
        x = self._splay(path)
        if keys[x] < bound:
            rest, self.right[x] = self.right[x], 0
            self._update(x)
            return x, rest
        rest, self.left[x] = self.left[x], 0
        self._update(x)
        return rest, x

    def insert(self, start: int, end: int, n: int, total: int) -> None:
        """Put an interval in; those that it meets become one with it."""
        before, rest = self._split(self.root, self.end, start)
        met, after = self._split(rest, self.start, end + 1)
        if met:
            start, end = min(start, self.first[met]), max(end, self.last[met])
            n, total = n + self.count[met], total + self.sum[met]
        for column, value in ((self.left, before), (self.right, after), (self.start, start), (self.end, end), (self.n, n), (self.total, total)):
            column.append(value)
        for column in (self.first, self.last, self.widest, self.count, self.sum):
            column.append(0)
        self.root = len(self.start) - 1
        self._update(self.root)

    def _outward(self, side: list[int], back: list[int], near: list[int], far: list[int], edge: list[int], own: list[int], sign: int) -> tuple[int, int, int]:
        """From the root to one side: the session's bound there, and what lies between, counted and summed. near, far: a subtree's end towards the
        root and away from it; edge, own: the same of a node."""
        bound, count, total = own[self.root], 0, 0
        path, x = [self.root], side[self.root]
        while x and sign * (bound - near[x]) <= self.limit:
            path.append(x)
            if self.widest[x] <= self.limit:
                bound, count, total = far[x], count + self.count[x], total + self.sum[x]
                break
            inner = back[x]
            if inner and self.widest[inner] > self.limit:
                x = inner
                continue
            if inner:
                bound, count, total = far[inner], count + self.count[inner], total + self.sum[inner]
            if sign * (bound - edge[x]) > self.limit:
                break
            bound, count, total = own[x], count + self.n[x], total + self.total[x]
            x = side[x]
        if len(path) > 2:
            # The deepest node seen comes up below the root, so that the next search there is short.
            side[self.root] = self._splay(path[1:])
            self._update(self.root)
        return bound, count, total

    def session(self, at: int) -> tuple[int, int, int, int]:
        """First second, last second, events and sum of the session whose interval holds `at`."""
        path, x = [], self.root
        while True:
            path.append(x)
            if at < self.start[x]:
                x = self.left[x]
            elif at > self.end[x]:
                x = self.right[x]
            else:
                break
        self.root = x = self._splay(path)
        first, n1, s1 = self._outward(self.left, self.right, self.last, self.first, self.end, self.start, 1)
        last, n2, s2 = self._outward(self.right, self.left, self.first, self.last, self.start, self.end, -1)
        return first, last, n1 + self.n[x] + n2, s1 + self.total[x] + s2


def unit_versions(rows: list[tuple], gap: int) -> list[list]:
    """rows: (batch, start, end, n, total) of one unit, by batch and start. Versions without their user."""
    tree, starts, standing, out, i = ActiveEvents(gap), [], [], [], 0
    while i < len(rows):
        batch, j = rows[i][0], i
        while j < len(rows) and rows[j][0] == batch:
            tree.insert(*rows[j][1:])
            j += 1
        last = None
        for _, start, _, n, _ in rows[i:j]:
            if last is not None and start <= last:
                out[-1][4] += n
                continue
            first, last, count, total = tree.session(start)
            a, b = bisect_left(starts, first), bisect_right(starts, last)
            for k in standing[a:b]:
                out[k][7:] = [batch, first]
            out.append([batch, first, last, count, n, b - a, total, None, None])
            starts[a:b], standing[a:b] = [first], [len(out) - 1]
        i = j
    return out


def _sweep(gap: int):
    schema = pa.schema([(c, pa.int64()) for c in _VERSION])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own, ready = None, [], []
        for batch in batches:
            for user, unit, *row in zip(*(batch.column(k).to_pylist() for k in range(len(_NODES))), strict=True):
                if (user, unit) != of:
                    ready += [(of[0], *v) for v in unit_versions(own, gap)] if own else []
                    of, own = (user, unit), []
                    if len(ready) >= 10_000:
                        yield table(ready)
                        ready = []
                own.append(tuple(row))
        ready += [(of[0], *v) for v in unit_versions(own, gap)] if own else []
        if ready:
            yield table(ready)

    return run


def _intervals(events: DataFrame, gap: int, cell: int) -> DataFrame:
    """user, unit, batch, start, end, n, total."""
    points = events.groupBy("user", "at", "batch").agg(F.count("*").alias("n"), F.sum("total").alias("total"))
    points = points.withColumn("cell", (F.col("at") - F.pmod("at", F.lit(cell))) / cell).withColumn("cell", F.col("cell").cast("long"))

    def broken(window):
        """The latest point up to this one before which there is a gap."""
        before = F.lag("at").over(window)
        return F.when(before.isNull() | (F.col("at") - before > gap), F.col("at"))

    in_cell = Window.partitionBy("user", "cell").orderBy("at")
    in_batch = Window.partitionBy("user", "cell", "batch").orderBy("at")
    points = points.repartition("user", "cell").withColumn("island", broken(in_cell)).withColumn("run", broken(in_batch))
    points = points.withColumn("island", F.max("island").over(in_cell)).withColumn("run", F.max("run").over(in_batch))
    runs = points.groupBy("user", "cell", "batch", "run").agg(F.min("island").alias("island"), F.max("at").alias("end"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    # One row a cell: its first and last second, and where its last island starts.
    cells = points.groupBy("user", "cell").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("island").alias("tail"))
    by_user = Window.partitionBy("user").orderBy("cell")
    linked = F.coalesce(F.col("first") - F.lag("last").over(by_user) <= gap, F.lit(False))
    cells = cells.withColumn("linked", linked).withColumn("own", F.when(~(F.col("linked") & (F.col("tail") == F.col("first"))), F.col("tail")))
    earlier = F.last("own", ignorenulls=True).over(by_user.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("user", "cell", "first", F.when(F.col("linked"), earlier).otherwise(F.col("first")).alias("head"))
    unit = F.when(F.col("island") == F.col("first"), F.col("head")).otherwise(F.col("island"))
    return runs.join(cells, ["user", "cell"]).select("user", unit.alias("unit"), "batch", F.col("run").alias("start"), "end", "n", "total")


def session_versions(events: DataFrame, gap: int = GAP, cell: int = CELL) -> DataFrame:
    """events: user, at (seconds), batch, total, all long; other columns are left alone. A row per version: user, batch, start_s, end_s, n_events, n_new
    (events of its batch), n_retracted, total (sum over its events), retracted_batch and retracted_start_s (null if it stands in the end).

    Each row is an event, rows alike too. Events without user, at or batch take no part; a null total counts as 0. No events: no rows. Events of
    one second share a session whatever their batches.
    """
    if not 0 <= gap <= cell:
        raise ValueError("gap is 0 to cell seconds")
    used = events.where("user IS NOT NULL AND at IS NOT NULL AND batch IS NOT NULL")
    used = used.select(*(F.col(c).cast("long").alias(c) for c in ("user", "at", "batch")), F.coalesce(F.col("total").cast("long"), F.lit(0)).alias("total"))
    nodes = _intervals(used, gap, cell).select(*_NODES).repartition("user", "unit").sortWithinPartitions("user", "unit", "batch", "start")
    return nodes.mapInArrow(_sweep(gap), ", ".join(f"{c} long" for c in _VERSION))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """user, at, batch, total of conversations: conv_id, turn. Rows without turn are no events; those without conv_id have no user."""
    checksum = lambda text: F.crc32(F.encode(text, "UTF-8"))
    of = conversations.where("turn IS NOT NULL").select(F.col("conv_id").cast("long").alias("v"), F.col("turn").cast("long").alias("t"))
    of = of.select("v", "t", checksum(F.col("v").cast("string")).alias("c"), checksum(F.concat(F.col("v").cast("string"), F.lit(":"), F.col("t").cast("string"))).alias("h"))
    of = of.selectExpr("2 * ((v - pmod(v, 8)) div 8) + c % 2 AS user", "(c div 2) % 7200 + 300 * t + h % 600 AS at", "h div 600 AS g", "h AS total")
    return of.selectExpr("user", "at", "(at - pmod(at, 3600)) div 3600 + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS batch", "total")
