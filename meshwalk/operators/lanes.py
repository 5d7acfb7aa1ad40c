"""Many-seed traversals: one frontier per lane, all in one plan with a ``lane`` column.

There is no limit of 64 lanes. Bit masks (bigint) hold 64 lanes each: block b has
lanes 64 b to 64 b + 63, and an expression on ``lane`` sees one block's mask at a time.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwalk.functions import cel
from meshwalk.plans.catalog import GraphCatalog
from meshwalk.plans.durable import cut


def lane_hop(lanes: DataFrame, edges: DataFrame, direction: str = "out", tripped: DataFrame | None = None) -> DataFrame:
    """One hop of every lane; ``tripped`` (lane, edge_id) are edges that a lane can't use."""
    if direction == "both":
        return lane_hop(lanes, edges, "out", tripped).unionByName(lane_hop(lanes, edges, "in", tripped)).distinct()
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    cols = [F.col(near).alias("_near"), F.col(far).alias("_far"), *([F.col("edge_id")] if tripped is not None else [])]
    met = lanes.join(edges.select(*cols), F.col("node") == F.col("_near"))
    if tripped is not None:
        met = met.join(tripped.select("lane", "edge_id"), ["lane", "edge_id"], "left_anti")
    return met.select("lane", F.col("_far").alias("node")).distinct()


def lane_closure(lanes: DataFrame, edges: DataFrame, direction: str = "out", max_hops: int = 1024, tripped: DataFrame | None = None) -> DataFrame:
    edges = cut(edges.select("src", "dst", *(["edge_id"] if tripped is not None else [])).distinct())
    tripped = cut(tripped.select("lane", "edge_id").distinct()) if tripped is not None else None
    seen = cut(lanes.select("lane", "node").distinct())
    new = seen
    for _ in range(max_hops):
        new = cut(lane_hop(new, edges, direction, tripped).join(seen, ["lane", "node"], "left_anti"), [new] if new is not seen else ())
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new), [seen])
    if max_hops >= 1000:
        raise RuntimeError(f"the closure did not settle in {max_hops} hops")
    return seen


def masks(lanes: DataFrame) -> DataFrame:
    """(node, block, mask): the lanes of each block that hold the node."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("lane", F.lit(64)).cast("int"))
    return lanes.groupBy("node", F.floor(F.col("lane") / 64).cast("long").alias("block")).agg(F.bit_or(bit).alias("mask"))


@dataclass(frozen=True)
class MultiLane:
    catalog: GraphCatalog
    lanes: DataFrame | None = None
    domain: str | None = None
    tripped: DataFrame | None = None
    values: DataFrame | None = None
    params: Mapping[str, Any] | None = None

    # ------------------------------------------------------------------ seeds

    def from_seeds(self, domain: str, ids: Sequence[Any]) -> MultiLane:
        """Lane i starts at the i-th id."""
        self.catalog.domain(domain)
        rows = self.catalog.spark.createDataFrame(list(enumerate(ids)) or [(0, None)], "lane int, node long").where("node IS NOT NULL")
        return replace(self, lanes=rows, domain=domain)

    def from_groups(self, domain: str, pairs: DataFrame) -> MultiLane:
        """A lane for each value of ``lane`` in (lane, node)."""
        self.catalog.domain(domain)
        return replace(self, lanes=pairs.select("lane", "node").distinct(), domain=domain)

    def from_keys(self, domain: str, attr: str, keys: Sequence[Any]) -> MultiLane:
        named = self.catalog.spark.createDataFrame(list(enumerate(keys)), ["lane", "_key"])
        nodes = self.catalog.domain(domain).nodes.select("node", F.col(attr).alias("_key"))
        return replace(self, lanes=named.join(nodes, "_key").select(F.col("lane").cast("int"), "node"), domain=domain)

    def from_concept_vectors(self, domain: str, attr: str, vectors: Sequence[Sequence[float]], k: int, metric: str = "cosine") -> MultiLane:
        """Lane i starts at the k nodes nearest to the i-th vector."""
        from .vectors import batch_top_k

        q = self.catalog.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query long, vector array<double>")
        hits = batch_top_k(self.catalog.domain(domain).nodes, q, k, metric, "node", attr)
        return replace(self, lanes=hits.select(F.col("query").cast("int").alias("lane"), "node"), domain=domain)

    def from_outages(self, domain: str, ids: Sequence[Any], tripped: DataFrame) -> MultiLane:
        """Every lane of ``tripped`` (lane, edge_id) starts at all ids, without its tripped edges."""
        self.catalog.domain(domain)
        seeds = self.catalog.spark.createDataFrame([(i,) for i in ids], "node long")
        lanes = tripped.select("lane").distinct().join(F.broadcast(seeds))
        return replace(self, lanes=lanes, domain=domain, tripped=tripped)

    # ------------------------------------------------------------------- steps

    def _edges(self, relation: str, edge_cel: str | None) -> DataFrame:
        e = self.catalog.edge_ids(relation) if self.tripped is not None else self.catalog.relation(relation).edges
        return e if edge_cel is None else e.where(cel.compile_test(edge_cel, cel.columns_of(e.dtypes), self.params))

    def _hop(self, relations: tuple[str, ...], direction: str, edge_cel: str | None) -> MultiLane:
        rel = self.catalog.relation(relations[0])
        here, there = (rel.src_domain, rel.dst_domain) if direction != "in" else (rel.dst_domain, rel.src_domain)
        if self.domain not in (here, there if direction == "both" else here):
            raise ValueError(f"relation {relations[0]} doesn't start in {self.domain}")
        out = None
        for r in relations:
            one = lane_hop(self.lanes, self._edges(r, edge_cel), direction, self.tripped)
            out = one if out is None else out.unionByName(one).distinct()
        return replace(self, lanes=out, domain=self.domain if direction == "both" else there)

    def out(self, *relations: str, where: str | None = None) -> MultiLane:
        return self._hop(relations, "out", where)

    def in_(self, *relations: str, where: str | None = None) -> MultiLane:
        return self._hop(relations, "in", where)

    def both(self, *relations: str, where: str | None = None) -> MultiLane:
        return self._hop(relations, "both", where)

    def repeat(self, times: int, relation: str) -> MultiLane:
        out = self
        for _ in range(times):
            out = out.out(relation)
        return out

    def repeat_until_stable(self, relation: str, max_hops: int = 1024, direction: str = "out") -> MultiLane:
        from meshwalk.plans.compiler import doubled, is_functional

        rel = self.catalog.relation(relation)
        if self.tripped is None and (rel.multiplicity or 9) <= 1 and max_hops >= 1000 and is_functional(rel.edges, direction):
            return replace(self, lanes=doubled(self.lanes.select("lane", "node"), rel.edges, direction))
        return replace(self, lanes=lane_closure(self.lanes, self._edges(relation, None), direction, max_hops, self.tripped))

    def union(self, other: MultiLane) -> MultiLane:
        return replace(self, lanes=self.lanes.unionByName(other.lanes).distinct())

    def intersect(self, other: MultiLane) -> MultiLane:
        return replace(self, lanes=self.lanes.join(other.lanes, ["lane", "node"], "left_semi"))

    def difference(self, other: MultiLane) -> MultiLane:
        return replace(self, lanes=self.lanes.join(other.lanes, ["lane", "node"], "left_anti"))

    def _with_attributes(self, expression: str) -> DataFrame:
        """(node, attributes) of every node of any lane, by block and with the mask as ``lane`` where the expression may ask for it."""
        nodes = self.catalog.domain(self.domain).nodes.dropDuplicates(["node"])
        held = masks(self.lanes).withColumnsRenamed({"mask": "lane", "block": "_block"}) if re.search(r"\blane\b", expression) else self.lanes.select("node").distinct()
        return held.join(nodes, "node", "left")

    def _where(self, expression: str, how: str) -> MultiLane:
        df = self._with_attributes(expression)
        met = df.where(cel.compile_test(expression, cel.columns_of(df.dtypes), self.params))
        if "_block" not in df.columns:
            return replace(self, lanes=self.lanes.join(met.select("node"), "node", how))
        own = self.lanes.withColumn("_block", F.floor(F.col("lane") / 64).cast("long"))
        return replace(self, lanes=own.join(met.select("node", "_block"), ["node", "_block"], how).select("lane", "node"))

    def filter(self, expression: str) -> MultiLane:
        """Nodes where the expression holds; ``lane`` is the node's mask, block of 64 lanes by block."""
        return self._where(expression, "left_semi")

    def project(self, expression: str) -> MultiLane:
        """``lane = expr`` makes the mask new; anything else stores a value for each node."""
        tree = cel.optimise(cel.parse(expression))
        df = self._with_attributes(expression)
        of = cel.Compiler(cel.columns_of(df.dtypes), self.params)
        if isinstance(tree, cel.Op) and tree.name == "=":
            if tree.args[0] != cel.Name("lane"):
                raise cel.CelError("only lane can be assigned")
            mask = of.typed(tree.args[1]).col.cast("long")
            bit = lambda i: F.call_function("shiftrightunsigned", F.col("_m"), i.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
            rows = df.select("node", "_block", mask.alias("_m")).select("node", "_block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), bit)).alias("_bit"))
            return replace(self, lanes=rows.select((F.col("_block") * 64 + F.col("_bit")).alias("lane"), "node"))
        if "_block" in df.columns:
            df = df.where("_block = 0")  # one value a node: that of the first 64 lanes' mask
        return replace(self, values=df.select("node", of.typed(tree).col.cast("double").alias("value")))

    def prune_where(self, expression: str) -> MultiLane:
        return self._where(expression, "left_anti")

    def prune_nodes(self, nodes: DataFrame) -> MultiLane:
        return replace(self, lanes=self.lanes.join(nodes.select("node"), "node", "left_anti"))

    def prune_lanes(self, lanes: Sequence[int]) -> MultiLane:
        return replace(self, lanes=self.lanes.where(~F.col("lane").isin(list(lanes))))

    def prune_denied_by(self, denied: MultiLane) -> MultiLane:
        """A lane loses the nodes that the same lane of ``denied`` holds."""
        return self.difference(denied)

    def prune_upper_half(self, half: int = 32) -> MultiLane:
        """Lane i keeps what lane i + half doesn't hold; the upper lanes go."""
        low, high = self.lanes.where(F.col("lane") < half), self.lanes.where(F.col("lane") >= half).select((F.col("lane") - half).alias("lane"), "node")
        return replace(self, lanes=low.join(high, ["lane", "node"], "left_anti"))

    def prune_hubs(self, relation: str, max_degree: int, min_lanes: int) -> MultiLane:
        """Nodes of a larger out-degree stay only if so many lanes hold them."""
        hubs = self.catalog.relation(relation).edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")).where(F.col("d") > max_degree)
        few = self.lanes.groupBy("node").agg(F.count_distinct("lane").alias("n")).where(F.col("n") < min_lanes)
        return self.prune_nodes(hubs.join(few, "node"))

    # ------------------------------------------------------------------ quorum

    def _quorum(self, k: int, required: Sequence[int] | None = None, forbidden: Sequence[int] = ()) -> DataFrame:
        wanted = F.col("lane") if required is None else F.when(F.col("lane").isin(list(required)), F.col("lane"))
        bad = F.count(F.when(F.col("lane").isin(list(forbidden)), 1)) if forbidden else F.lit(0)
        by = self.lanes.groupBy("node").agg(F.count_distinct(wanted).alias("n"), bad.alias("bad"))
        return by.where((F.col("n") >= k) & (F.col("bad") == 0)).select("node", "n")

    def where_quorum(self, k: int) -> MultiLane:
        return replace(self, lanes=self.lanes.join(self._quorum(k), "node", "left_semi"))

    def where_mask(self, required: Sequence[int], forbidden: Sequence[int] = (), k: int | None = None) -> MultiLane:
        return replace(self, lanes=self.lanes.join(self._quorum(len(required) if k is None else k, required, forbidden), "node", "left_semi"))

    def must_hit_at_least(self, k: int, lanes: Sequence[int]) -> MultiLane:
        return self.where_mask(lanes, (), k)

    def must_avoid_all(self, lanes: Sequence[int]) -> MultiLane:
        return replace(self, lanes=self.lanes.join(self._quorum(0, None, lanes), "node", "left_semi"))

    # --------------------------------------------------------------- terminals

    def collect(self) -> DataFrame:
        """(node, block, mask, popcount); lanes 0 to 63 are block 0."""
        return masks(self.lanes).withColumn("popcount", F.bit_count("mask"))

    def attribution(self) -> DataFrame:
        """(node, lanes): which lanes hold the node, ascending."""
        return self.lanes.groupBy("node").agg(F.array_sort(F.collect_set("lane")).alias("lanes"))

    def nodes_with_quorum(self, k: int) -> DataFrame:
        return self._quorum(k).select("node")

    def keys_with_quorum(self, k: int, attr: str) -> DataFrame:
        return self.nodes_with_quorum(k).join(self.catalog.domain(self.domain).nodes, "node").select(F.col(attr).alias("key"))

    def set_cover_pairs(self, lanes: Sequence[int]) -> DataFrame:
        """(a, b) of nodes that together are held by all of the lanes; candidates meet by the lanes they lack."""
        if len(set(lanes)) > 63:
            raise ValueError(f"{len(set(lanes))} lanes; a pair is sought for 63 at most")
        full = (1 << len(set(lanes))) - 1
        place = F.create_map(*(F.lit(x) for i, k in enumerate(sorted(set(lanes))) for x in (k, i)))
        m = masks(self.lanes.where(F.col("lane").isin(list(lanes))).select(place[F.col("lane").cast("int")].alias("lane"), "node"))
        kinds = cut(m.groupBy("mask").agg(F.count("*").alias("n")))  # at most 2 ** lanes rows
        good = kinds.select(F.col("mask").alias("ma")).join(kinds.select(F.col("mask").alias("mb")), F.col("ma").bitwiseOR(F.col("mb")) == F.lit(full).cast("long"))
        a = m.select(F.col("node").alias("a"), F.col("mask").alias("ma")).join(good, "ma")
        return a.join(m.select(F.col("node").alias("b"), F.col("mask").alias("mb")), "mb").where("a < b").select("a", "b")

    def greedy_set_cover(self, max_nodes: int | None = None) -> DataFrame:
        """(step, node, gain): the node of most lanes not yet covered, ties by least id, until all are or ``max_nodes`` are taken."""
        left, out = cut(self.lanes.select("lane", "node").distinct()), []
        while max_nodes is None or len(out) < max_nodes:
            best = left.groupBy("node").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), "node").first()
            if best is None:
                break
            out.append((len(out), best["node"], best["gain"]))
            left = cut(left.join(left.where(F.col("node") == best["node"]).select("lane"), "lane", "left_anti"), [left])
        return self.catalog.spark.createDataFrame(out, "step int, node long, gain long")

    def top_k_with_quorum(self, k: int, quorum: int) -> DataFrame:
        """(node, value) by stored value, else by number of lanes."""
        q = self._quorum(quorum)
        scored = q.join(self.values, "node") if self.values is not None else q.select("node", F.col("n").cast("double").alias("value"))
        return scored.select("node", "value").where("value IS NOT NULL").orderBy(F.desc("value"), "node").limit(k)

    def reduce_per_lane(self, expression: str, how: str) -> DataFrame:
        """(lane, result): SUM, MUL, MIN, MAX, AVG, COUNT, ARGMIN or ARGMAX; missing values are skipped."""
        nodes = self.catalog.domain(self.domain).nodes.dropDuplicates(["node"])
        v = nodes.select("node", cel.compile_value(expression, cel.columns_of(nodes.dtypes), self.params).col.cast("double").alias("v"))
        met = self.lanes.join(v, "node", "left")
        ok = F.col("v").isNotNull()
        least: Column = F.struct("v", "node")
        aggregates = {
            "SUM": F.coalesce(F.sum("v"), F.lit(0.0)), "MUL": F.coalesce(F.product("v"), F.lit(0.0)), "MIN": F.coalesce(F.min("v"), F.lit(0.0)), "MAX": F.coalesce(F.max("v"), F.lit(0.0)),
            "AVG": F.avg("v"), "COUNT": F.count("v").cast("double"), "ARGMIN": F.min(F.when(ok, least))["node"], "ARGMAX": F.min(F.when(ok, F.struct((-F.col("v")).alias("v"), "node")))["node"],
        }
        return met.groupBy("lane").agg(aggregates[how.upper()].alias("result"))

    def all_reached(self, universe: DataFrame | None = None) -> DataFrame:
        """(lane, reached, all_reached) against a node universe, the domain's by default."""
        nodes = self.catalog.domain(self.domain).nodes if universe is None else universe
        total = nodes.select("node").distinct().agg(F.count("*").alias("total"))
        by = self.lanes.groupBy("lane").agg(F.count_distinct("node").alias("reached"))
        return by.join(F.broadcast(total)).select("lane", "reached", (F.col("reached") == F.col("total")).alias("all_reached"))

    def universal_nodes(self) -> DataFrame:
        """Nodes that every lane holds."""
        n = self.lanes.agg(F.count_distinct("lane").alias("lanes"))
        by = self.lanes.groupBy("node").agg(F.count_distinct("lane").alias("n"))
        return by.join(F.broadcast(n)).where("n = lanes").select("node")

    def steiner_subgraph(self, relation: str, quorum: int) -> tuple[DataFrame, DataFrame]:
        """Bridge nodes (held by a quorum) and the relation's edges between nodes of any lane."""
        held = self.lanes.select("node").distinct()
        e = self.catalog.relation(relation).edges.select("src", "dst").distinct()
        inside = e.join(held.withColumnRenamed("node", "src"), "src", "left_semi").join(held.withColumnRenamed("node", "dst"), "dst", "left_semi")
        return self.nodes_with_quorum(quorum), inside.select("src", "dst")

    def to_traversal(self, quorum: int = 1):
        from meshwalk.plans.traversal import Traversal

        return Traversal(self.catalog).from_frame(self.domain, self.nodes_with_quorum(quorum))
