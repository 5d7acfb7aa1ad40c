"""How many nodes each lane reaches over shared stops, without a row for each pair of lane and node.

A group is a run of lanes with about GROUP_ROWS stops; it is sent the list of nodes of every stop
that it has, once, and counts in memory. Groups go in rounds, so that what is sent fits a bounded part of the disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.plans.durable import cut, discard
from meshwalk.plans.shipping import ship

from .closing import ragged

ship(__name__)

GROUP_ROWS = 600_000
#: Nodes that are looked at in one step, but for a lane of more.
STEP = 4_000_000
#: Numbers of 8 bytes that are sent to groups in one round, but for a group of more.
ROUND = 150_000_000


class Stops:
    """The nodes of some stops, as offsets from the least or, if far apart, as places in their order."""

    def __init__(self, stop: np.ndarray, size: np.ndarray, to: np.ndarray):
        order = np.argsort(stop)
        self.stop, self.size, self.start = stop[order], size[order], (np.cumsum(size) - size)[order]
        self.span = int(to.max()) - int(to.min()) + 1
        if self.span < 2**32:
            self.to = (to - to.min()).astype(np.uint32)
        else:
            known, at = np.unique(to, return_inverse=True)
            self.span, self.to = len(known), at.astype(np.uint32)

    def reached(self, size: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How many nodes each run of so many stops has."""
        at = np.minimum(np.searchsorted(self.stop, stop), len(self.stop) - 1)
        known = self.stop[at] == stop
        lane = np.repeat(np.arange(len(size)), size)[known]
        at = at[known]
        work = np.bincount(lane, weights=self.size[at], minlength=len(size)).astype(np.int64)
        out, begin, end = np.zeros(len(size), np.int64), 0, np.cumsum(work)
        most = max(64, 2**32 // self.span)  # lanes that keep keys within 32 bits
        while begin < len(size):
            stopped = max(begin + 1, min(begin + most, int(np.searchsorted(end, end[begin] - work[begin] + STEP, "right"))))
            a, b = np.searchsorted(lane, (begin, stopped))
            n = self.size[at[a:b]]
            key = np.uint32 if (stopped - begin) * self.span <= 2**32 else np.uint64
            x = np.repeat((lane[a:b] - begin).astype(key) * key(self.span), n) + self.to[ragged(self.start[at[a:b]], n)]
            x.sort()
            first = x[np.flatnonzero(np.diff(x, prepend=x[:1] + key(1)))] // key(self.span)
            out[begin:stopped] = np.bincount(first.astype(np.int64), minlength=stopped - begin)
            begin = stopped
        return out


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, kind, id, to) in the order of g and kind: 0 are stops with their nodes, 1 lanes with their stops."""
    now, parts, stops = None, [], None
    for batch in batches:
        g, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        begin = 0
        for end in np.flatnonzero(np.diff(g * 2 + kind, append=-1)) + 1:
            run = batch.slice(begin, end - begin)
            lists = run.column(3)
            who, to, size = run.column(2).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            if g[begin] != now:
                now, parts, stops = g[begin], [], None
            if kind[begin] == 0:
                parts.append((who, size, to))
            elif parts or stops:
                if parts:
                    stops, parts = Stops(*(np.concatenate(x) for x in zip(*parts))), []
                n = stops.reached(size, to)
                yield pa.RecordBatch.from_arrays([pa.array(who[n > 0]), pa.array(n[n > 0])], names=["lane", "n"])
            begin = end


def reach_sizes(near: DataFrame, far: DataFrame) -> DataFrame:
    """(lane, n) for (lane, stop) and (stop, node) of whole numbers, over lanes of at least one node; rows may repeat."""
    kind = dict(near.dtypes)["lane"]
    near = near.select(F.col("lane").cast("long"), F.col("stop").cast("long"))
    groups = max(1, -(-near.count() // GROUP_ROWS))
    of_lane = near.repartitionByRange(groups, "lane").groupBy("lane").agg(F.collect_list("stop").alias("to"))
    lanes = cut(of_lane.select(F.spark_partition_id().cast("long").alias("g"), "lane", "to"))
    stops = cut(far.select(F.col("stop").cast("long"), F.col("node").cast("long")).groupBy("stop").agg(F.collect_list("node").alias("to")))
    wanted = cut(lanes.select("g", F.explode("to").alias("stop")).distinct().join(stops.select("stop", F.size("to").alias("_n")), "stop"))
    rounds, held = [[]], 0
    for r in wanted.groupBy("g").agg(F.sum("_n").alias("n")).orderBy("g").collect():  # a row for each group
        if rounds[-1] and held + r["n"] > ROUND:
            rounds.append([])
            held = 0
        rounds[-1].append(r["g"])
        held += r["n"]
    out = []
    for these in rounds:
        some = F.col("g").between(min(these, default=0), max(these, default=0))
        rows = wanted.where(some).join(stops, "stop").select("g", F.lit(0).alias("kind"), F.col("stop").alias("id"), "to")
        rows = rows.unionByName(lanes.where(some).select("g", F.lit(1).alias("kind"), F.col("lane").alias("id"), "to"))
        rows = rows.repartition(max(1, len(these)), "g").sortWithinPartitions("g", "kind")
        out.append(cut(rows.mapInArrow(_reach, "lane long, n long")))
    for x in (lanes, stops, wanted):
        discard(x)
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.select(F.col("lane").cast(kind), "n")
