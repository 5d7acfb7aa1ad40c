"""Triangles by groups of nodes: wedges are made and closed in memory, never shuffled.

Edges point from the end of lower degree, so a list of out-neighbours is at most about
the square root of twice the edges long. A group is a run of node ids with about GROUP_EDGES
out-edges; it is sent the list of every node that its edges point to, once. For u in the group
and v behind it, each w behind v closes a triangle if u points to w.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.plans.catalog import number_rows
from meshwalk.plans.durable import cut, discard
from meshwalk.plans.shipping import ship

ship(__name__)

GROUP_EDGES = 600_000
#: Wedges that are looked at in one step.
STEP = 1_000_000
#: Counted tables of at most so many rows of three numbers (48 MB) are broadcast.
BROADCAST_ROWS = 2_000_000
A, B = np.uint32(2654435761), np.uint32(2246822519)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each run of so many."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


class Group:
    """The out-edges of a group, by node, by target and as a set with a one-hash filter before it."""

    def __init__(self, u: np.ndarray, size: np.ndarray, to: np.ndarray):
        self.u, at = u, np.repeat(np.arange(len(u)), size)
        self.target, w = np.unique(to, return_inverse=True)
        self.key = np.sort(at * len(self.target) + w)
        order = np.argsort(w, kind="stable")
        self.edge = order
        self.into, count = at[order], np.bincount(w, minlength=len(self.target))
        self.first, self.count = np.cumsum(count) - count, count
        self.hash = np.arange(len(u), dtype=np.uint32) * A
        self.mask = np.uint32((1 << max(10, int(len(to) * 12).bit_length())) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[(np.repeat(self.hash, size) + to.astype(np.uint32) * B) & self.mask] = True

    def closed(self, v: np.ndarray, size: np.ndarray, to: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for x, y, z, *_ in self.places(v, size, to):
            yield self.u[x], self.target[y], self.target[z]

    def places(self, v: np.ndarray, size: np.ndarray, to: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Triangles as places in u, target and target, and their edges: two as places in the group's lists, the last in ``to``."""
        at = np.searchsorted(self.target, v)
        start, hashed = np.cumsum(size) - size, to.astype(np.uint32) * B
        row = np.repeat(np.arange(len(v)), self.count[at])
        edge = ragged(self.first[at], self.count[at])
        u, edge = self.into[edge], self.edge[edge]
        step = np.cumsum(size[row]) // STEP
        for a, b in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))(np.flatnonzero(np.diff(step, prepend=-1, append=-1)))):
            r, x, uv = row[a:b], u[a:b], edge[a:b]
            n = size[r]
            i = ragged(start[r], n)
            hit = np.flatnonzero(self.maybe[(np.repeat(self.hash[x], n) + hashed[i]) & self.mask])
            pair = np.searchsorted(np.cumsum(n), hit, "right")
            vw = i[hit]
            w, x, r, uv = to[vw], x[pair], r[pair], uv[pair]
            t = np.minimum(np.searchsorted(self.target, w), len(self.target) - 1)
            k = x * len(self.target) + t
            uw = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            real = (self.target[t] == w) & (self.key[uw] == k)
            yield x[real], at[r[real]], t[real], uv[real], uw[real], vw[real]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Group, Iterator[tuple[np.ndarray, ...]], np.ndarray | None]]:
    """Rows (g, kind, u, to[, base]) in the order of g and kind: 0 are the group's lists, 1 those that are sent to it.

    With bases, a group has the numbers of its edges, and those of the edges that are sent come third.
    """
    now, parts, group = None, [], None
    for batch in batches:
        g, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ends = np.flatnonzero(np.diff(g * 2 + kind, append=-1))
        begin = 0
        for end in ends + 1:
            run = batch.slice(begin, end - begin)
            lists = run.column(3)
            u, to = run.column(2).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy())
            number = ragged(run.column(4).to_numpy(), size) if batch.num_columns > 4 else None
            if g[begin] != now:
                now, parts, group = g[begin], [], None
            if kind[begin] == 0:
                parts.append((u, size, to, *([] if number is None else [number])))
            else:
                if group is None:
                    held, parts = [np.concatenate(x) for x in zip(*parts)], []
                    group = Group(*held[:3])
                    group.number = held[3] if len(held) > 3 else None
                yield group, group.places(u, size, to), number
            begin = end


def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group, places, _ in _found(batches):
        for x, y, z, *_ in places:
            if len(x):
                found = np.sort(np.stack((group.u[x], group.target[y], group.target[z])), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "c"])


def close_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n): the triangles that a group finds, by node."""

    def rows():
        for ids, n in ((last.u, own), (last.target, sent)):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some])], names=["node", "n"])

    last = None
    for group, places, _ in _found(batches):
        if group is not last:
            if last is not None:
                yield from rows()
            last, own, sent = group, np.zeros(len(group.u), np.int64), np.zeros(len(group.target), np.int64)
        for x, y, z, *_ in places:
            own += np.bincount(x, minlength=len(own))
            sent += np.bincount(y, minlength=len(sent)) + np.bincount(z, minlength=len(sent))
    if last is not None:
        yield from rows()


def close_numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, c): the numbers of a triangle's pairs."""
    for group, places, number in _found(batches):
        for *_, uv, uw, vw in places:
            if len(uv):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (group.number[uv], group.number[uw], number[vw])], names=["a", "b", "c"])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, u, to, base): lists with how many pairs of their group come before. A group is in one partition."""
    before: dict[int, int] = {}
    for b in batches:
        g, size = b.column(0).to_numpy(), np.diff(b.column(2).offsets.to_numpy())
        base = np.zeros(len(g), np.int64)
        for x in np.unique(g).tolist():
            at = np.flatnonzero(g == x)
            end = np.cumsum(size[at])
            base[at] = before.get(x, 0) + end - size[at]
            before[x] = before.get(x, 0) + int(end[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base)], names=["g", "u", "to", "base"])


def numbered_rows(pairs: DataFrame, degree: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """What close_numbered reads, the lists as (u, base, to), and the first number of each group and of none."""
    rows, (lists,) = _rows(pairs, degree, True)
    sizes = {r["g"]: r["n"] for r in lists.groupBy("g").agg(F.sum(F.size("to")).alias("n")).collect()}  # a row for each group
    first = np.concatenate([[0], np.cumsum([sizes.get(g, 0) for g in range(max(sizes, default=-1) + 1)])]).astype(np.int64)
    shift = F.broadcast(pairs.sparkSession.createDataFrame([(g, int(first[g])) for g in sizes] or [(0, 0)], "_g long, _first long"))
    moved = rows.columns
    # The sent lists' bases are within their own groups, so the shift is that of the group that has the list.
    rows = rows.join(shift, F.col("home") == F.col("_g")).withColumn("base", F.col("base") + F.col("_first")).select(*(x for x in moved if x != "home"))
    groups = max(1, len(first) - 1)
    rows = rows.repartition(groups, "g").sortWithinPartitions("g", "kind", "u")
    return rows, lists.join(shift, F.col("g") == F.col("_g")).select("u", (F.col("base") + F.col("_first")).alias("base"), "to"), first


def counts_of(pairs: DataFrame, degree: DataFrame) -> DataFrame:
    """(node, n) of pairs as for triangles_of: its triangles by node, in several rows."""
    rows, _ = _rows(pairs, degree)
    return rows.mapInArrow(close_counted, "node long, n long").select(F.col("node").cast(dict(pairs.dtypes)["src"]), "n")


def triangles_of(pairs: DataFrame, degree: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b, c) of pairs that are there once, with src < dst, of whole numbers; and the cuts that it reads.

    ``degree`` is (src, d) of both ends.
    """
    kind = dict(pairs.dtypes)["src"]
    rows, read = _rows(pairs, degree)
    found = rows.mapInArrow(close, "a long, b long, c long")
    return found.select(*(F.col(x).cast(kind).alias(x) for x in "abc")), read


def _rows(pairs: DataFrame, degree: DataFrame, numbered: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    nodes = cut(number_rows(degree, ["src"], "_at"))
    n, m = nodes.count(), pairs.count()
    groups = max(1, -(-m // GROUP_EDGES))
    nodes_g = nodes.select("src", "d", F.expr(f"_at * {groups} div {max(1, n)}").alias("g"))
    nodes_g = F.broadcast(nodes_g) if n <= BROADCAST_ROWS else nodes_g
    ranked = pairs.join(nodes_g.withColumnsRenamed({"d": "ds", "g": "gs"}), "src").join(nodes_g.withColumnsRenamed({"src": "dst", "d": "dd", "g": "gd"}), "dst")
    low_first = F.struct("ds", "src") < F.struct("dd", "dst")
    pick = lambda x, y: F.when(low_first, F.col(x)).otherwise(F.col(y))
    e = ranked.select(pick("gs", "gd").alias("g"), pick("src", "dst").cast("long").alias("u"), pick("dst", "src").cast("long").alias("v"))
    made = e.repartition(groups, "g").groupBy("g", "u").agg(F.sort_array(F.collect_list("v")).alias("to"))
    if numbered:
        made = made.select(F.col("g").cast("long").alias("g"), "u", "to").mapInArrow(_number, "g long, u long, to array<long>, base long")
    lists = cut(made)
    discard(nodes)
    more = ["base", F.col("g").alias("home")] if numbered else []
    wanted = lists.select("g", F.explode("to").alias("u")).distinct().join(lists.select("u", "to", *more), "u")
    rows = lists.select("g", F.lit(0).alias("kind"), "u", "to", *more).unionByName(wanted.select("g", F.lit(1).alias("kind"), "u", "to", *(["base", "home"] if numbered else [])))
    return rows if numbered else rows.repartition(groups, "g").sortWithinPartitions("g", "kind", "u"), [lists]
