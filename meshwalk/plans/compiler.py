"""Logical plan to DataFrame. A frontier is a distinct one-column DataFrame ``node``."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.functions import cel

from . import logical as L
from .catalog import GraphCatalog
from .durable import cut


#: A limit of so many hops means none: what isn't settled by then is an error, not an answer.
UNBOUNDED = 1000


def hop(frontier: DataFrame, edges: DataFrame, direction: str = "out", distinct: bool = True) -> DataFrame:
    """{v : (u, v) an edge, u in the frontier}; reversed for ``in``, both ways for ``both``."""
    if direction == "both":
        return hop(frontier, edges, "out", False).unionByName(hop(frontier, edges, "in", False)).distinct()
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    ends = edges.select(F.col(near).alias("_near"), F.col(far).alias("_far"))
    out = frontier.join(ends, F.col("node") == F.col("_near")).select(F.col("_far").alias("node"))
    return out.distinct() if distinct else out


def is_functional(edges: DataFrame, direction: str = "out") -> bool:
    """Whether every node has one way on at most."""
    return edges.groupBy("src" if direction == "out" else "dst").count().where("count > 1").isEmpty()


def doubled(reached: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """Closure over a functional relation by squaring it: rounds are the logarithm of the length of a chain.

    ``reached`` has ``node`` and any columns that belong to a seed, such as a lane.
    """
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    jump = cut(edges.select(F.col(near).alias("_near"), F.col(far).alias("_far")).distinct())
    rest = [c for c in reached.columns if c != "node"]
    seen = cut(reached.distinct())
    size = seen.count()
    while True:
        far_on = seen.join(jump, F.col("node") == F.col("_near")).select(*rest, F.col("_far").alias("node"))
        seen = cut(seen.select(*rest, "node").unionByName(far_on).distinct(), [seen])
        now = seen.count()
        if now == size:
            return seen.select(*reached.columns)
        size = now
        again = jump.select(F.col("_near").alias("_mid"), F.col("_far").alias("_end"))
        jump = cut(jump.join(again, F.col("_far") == F.col("_mid")).select("_near", F.col("_end").alias("_far")), [jump])


def closure(seeds: DataFrame, edges: DataFrame, direction: str = "out", max_hops: int = 1024, include_seeds: bool = True, functional: bool = False) -> DataFrame:
    """Nodes reachable over the edges: semi-naive rounds on the new nodes alone, each cut.

    ``functional`` relations (one way on at most) are squared instead, unless few hops are asked for.
    """
    if functional and include_seeds and max_hops >= UNBOUNDED and is_functional(edges, direction):
        return doubled(seeds.select("node"), edges, direction)
    edges = cut(edges.select("src", "dst").distinct())
    seen = cut(seeds.select("node").distinct()) if include_seeds else cut(hop(seeds.select("node").distinct(), edges, direction))
    new = seen
    for _ in range(max_hops if include_seeds else max_hops - 1):
        new = cut(hop(new, edges, direction).join(seen, "node", "left_anti"), [new] if new is not seen else ())
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new), [seen])
    if max_hops >= UNBOUNDED:
        raise RuntimeError(f"the closure did not settle in {max_hops} hops")
    return seen


class Planner:
    """Compiles plans against a catalog; ``rewrites=False`` turns the rewrites off."""

    def __init__(self, catalog: GraphCatalog, params: Mapping[str, Any] | None = None, rewrites: bool = True):
        self.catalog, self.params, self.rewrites = catalog, params or {}, rewrites

    def domain_of(self, plan: L.Plan) -> str | None:
        """Of multi-relation hops, the first relation decides; both-way hops stay where they are."""
        if isinstance(plan, L.Seed | L.Frame):
            return plan.domain
        if isinstance(plan, L.Hop):
            if plan.direction == "both":
                return self.domain_of(plan.child)
            r = self.catalog.relation(plan.relations[0])
            return r.dst_domain if plan.direction == "out" else r.src_domain
        if isinstance(plan, L.Sample | L.Walk | L.Repeat):
            return self.catalog.relation(plan.relation).dst_domain
        return self.domain_of(getattr(plan, "child", None) or plan.left)

    def edges(self, relations: tuple[str, ...], edge_cel: str | None = None) -> DataFrame:
        found = [self.catalog.relation(r).edges for r in relations]
        if edge_cel is not None:
            found = [e.where(cel.compile_test(edge_cel, cel.columns_of(e.dtypes), self.params)) for e in found]
        return reduce(DataFrame.unionByName, (e.select("src", "dst") for e in found))

    def run(self, plan: L.Plan) -> DataFrame:
        """The plan's node set."""
        if self.rewrites:
            plan = L.rewrite(plan, lambda r: self.catalog.relation(r).multiplicity)
        return self._df(plan)

    def attributes(self, frontier: DataFrame, domain: str) -> DataFrame:
        return frontier.join(self.catalog.domain(domain).nodes, "node", "left")

    def _df(self, plan: L.Plan) -> DataFrame:
        if isinstance(plan, L.Frame):
            return plan.df.select("node").distinct()
        if isinstance(plan, L.Seed):
            nodes = self.catalog.domain(plan.domain).nodes.select("node").distinct()
            if plan.ids is None:
                return nodes
            return nodes.where(F.col("node").isin(list(plan.ids))) if plan.ids else nodes.where(F.lit(False))
        if isinstance(plan, L.Hop):
            return hop(self._df(plan.child), self.edges(plan.relations, plan.edge_cel), plan.direction, plan.distinct)
        if isinstance(plan, L.Filter):
            domain = self.catalog.domain(self.domain_of(plan.child))
            test = cel.compile_test(plan.cel, cel.columns_of(domain.nodes.dtypes), self.params)
            if isinstance(plan.child, L.Seed) and plan.child.ids is None:
                return domain.nodes.where(test).select("node").distinct()
            # The filter stands on the attribute side, so that it reaches the scan.
            return self._df(plan.child).join(domain.nodes.where(test).select("node"), "node", "left_semi")
        if isinstance(plan, L.Within):
            return self._df(plan.child).join(self._df(plan.other), "node", "left_anti" if plan.negated else "left_semi")
        if isinstance(plan, L.Union):
            return self._df(plan.left).unionByName(self._df(plan.right)).distinct()
        if isinstance(plan, L.Repeat):
            return self._df(L.rewrite(plan, lambda _: None))
        if isinstance(plan, L.Fixpoint):
            low = len(plan.relations) == 1 and (self.catalog.relation(plan.relations[0]).multiplicity or 9) <= 1
            return closure(self._df(plan.child), self.edges(plan.relations), plan.direction, plan.max_hops, plan.min_hops == 0, low)
        if isinstance(plan, L.ValidAt):
            nodes = self.catalog.domain(self.domain_of(plan.child)).nodes
            of = cel.columns_of(nodes.dtypes)
            start, end = of(plan.start).col, of(plan.end).col
            valid = nodes.where((start.isNull() | (start <= plan.millis)) & (end.isNull() | (end > plan.millis)))
            return self._df(plan.child).join(valid.select("node"), "node", "left_semi")
        if isinstance(plan, L.KCore):
            from meshwalk.operators.algorithms import core_numbers

            cores = core_numbers(self.edges((plan.relation,)))
            return self._df(plan.child).join(cores.where(F.col("core") >= plan.k).select("node"), "node", "left_semi")
        if isinstance(plan, L.Sample):
            from meshwalk.operators.sampling import sample_neighbors

            return sample_neighbors(self._df(plan.child), self.edges((plan.relation,)), plan.k, plan.seed).select(F.col("dst").alias("node")).distinct()
        if isinstance(plan, L.Walk):
            from meshwalk.operators.sampling import random_walks

            return random_walks(self._df(plan.child), self.edges((plan.relation,)), plan.steps, plan.seed).where(F.col("step") == plan.steps).select("node").distinct()
        raise TypeError(f"no way to compile {type(plan).__name__}")
