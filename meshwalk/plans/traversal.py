"""The fluent traversal: an immutable builder over the logical plan, lazy until a terminal call."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwalk.functions import cel

from . import logical as L
from .catalog import GraphCatalog
from .compiler import Planner

REDUCERS = ("SUM", "MIN", "MAX", "AVG", "COUNT", "MUL", "ARGMIN", "ARGMAX")


@dataclass(frozen=True)
class Value:
    """One step of the state vector, which starts at 1.0 for each active node."""

    kind: str  # mul, div, scale, project, rerank
    arg: Any
    metric: str = ""


@dataclass(frozen=True)
class Traversal:
    catalog: GraphCatalog
    plan: L.Plan | None = None
    domain: str | None = None
    values: tuple[Value, ...] = ()
    params: Mapping[str, Any] | None = None
    rewrites: bool = True

    # ------------------------------------------------------------------ seeds

    def all(self, domain: str) -> Traversal:
        self.catalog.domain(domain)
        return replace(self, plan=L.Seed(domain), domain=domain)

    def from_(self, domain: str, *ids: Any) -> Traversal:
        """Seeds by key; unknown keys drop out."""
        self.catalog.domain(domain)
        return replace(self, plan=L.Seed(domain, tuple(ids)), domain=domain)

    def from_key(self, domain: str, attr: str, *keys: Any) -> Traversal:
        """Seeds by another unique attribute."""
        names = {f"_k{i}": k for i, k in enumerate(keys)}
        return replace(self.all(domain), params={**(self.params or {}), **names}, plan=L.Filter(L.Seed(domain), f"{attr} in [{', '.join('$' + n for n in names)}]"))

    def from_frame(self, domain: str, df: DataFrame) -> Traversal:
        return replace(self, plan=L.Frame(domain, df), domain=domain)

    def bind(self, **params: Any) -> Traversal:
        return replace(self, params={**(self.params or {}), **params})

    # ------------------------------------------------------------------- steps

    def _step(self, plan: L.Plan, domain: str | None = None) -> Traversal:
        return replace(self, plan=plan, domain=domain or self.domain)

    def _hop(self, relations: tuple, direction: str, edge_cel: str | None = None) -> Traversal:
        names = tuple(relations[0]) if len(relations) == 1 and isinstance(relations[0], list | tuple) else relations
        rel = self.catalog.relation(names[0])
        here, there = (rel.src_domain, rel.dst_domain) if direction != "in" else (rel.dst_domain, rel.src_domain)
        if self.domain not in (here, there if direction == "both" else here):
            raise ValueError(f"relation {names[0]} doesn't start in {self.domain}")
        return self._step(L.Hop(self.plan, names, direction, edge_cel), self.domain if direction == "both" else there)

    def out(self, *relations) -> Traversal:
        return self._hop(relations, "out")

    def in_(self, *relations) -> Traversal:
        return self._hop(relations, "in")

    def both(self, *relations) -> Traversal:
        return self._hop(relations, "both")

    def out_predicate(self, relation: str, expression: str) -> Traversal:
        return self._hop((relation,), "out", expression)

    def in_predicate(self, relation: str, expression: str) -> Traversal:
        return self._hop((relation,), "in", expression)

    def out_filtered(self, relation: str, targets: Traversal) -> Traversal:
        hopped = self.out(relation)
        return hopped._step(L.Within(hopped.plan, targets.plan))

    def repeat(self, times: int, relation: str) -> Traversal:
        return self._step(L.Repeat(self.plan, relation, times))

    def repeat_until_stable(self, *relations: str, max_hops: int = 1024) -> Traversal:
        return self._step(L.Fixpoint(self.plan, relations, max_hops))

    def filter(self, expression: str) -> Traversal:
        cel.parse(expression)
        return self._step(L.Filter(self.plan, expression))

    def valid_at(self, millis: int, start: str, end: str) -> Traversal:
        return self._step(L.ValidAt(self.plan, millis, start, end))

    def union_with(self, other: Traversal) -> Traversal:
        return self._step(L.Union(self.plan, other.plan))

    def intersect(self, other: Traversal) -> Traversal:
        return self._step(L.Within(self.plan, other.plan))

    def difference(self, other: Traversal) -> Traversal:
        return self._step(L.Within(self.plan, other.plan, True))

    ewise_add, ewise_mult = union_with, intersect

    def mxv(self, relation: str) -> Traversal:
        return self.out(relation)

    def vxm(self, relation: str) -> Traversal:
        return self.in_(relation)

    def sample_neighbors(self, relation: str, k: int, seed: int = 0) -> Traversal:
        return self._step(L.Sample(self.plan, relation, k, seed), self.catalog.relation(relation).dst_domain)

    def random_walk(self, relation: str, steps: int, seed: int = 0) -> Traversal:
        return self._step(L.Walk(self.plan, relation, steps, seed), self.catalog.relation(relation).dst_domain)

    def k_core(self, relation: str, k: int) -> Traversal:
        return self._step(L.KCore(self.plan, relation, k))

    # ------------------------------------------------------------ state vector

    def _value(self, v: Value) -> Traversal:
        return replace(self, values=(*self.values, v))

    def project(self, expression: str) -> Traversal:
        """The value becomes that of the expression; a comparison also filters."""
        tree = cel.parse(expression)
        kept = self.filter(expression) if isinstance(tree, cel.Op) and tree.name in ("==", "!=", "<", "<=", ">", ">=", "in") else self
        return kept._value(Value("project", expression))

    def mul_node_attr(self, attr: str) -> Traversal:
        return self._value(Value("mul", attr))

    def div_node_attr(self, attr: str) -> Traversal:
        return self._value(Value("div", attr))

    def scale_state(self, factor: float) -> Traversal:
        return self._value(Value("scale", float(factor)))

    def rerank(self, vector: list[float], attr: str, metric: str = "cosine") -> Traversal:
        return self._value(Value("rerank", (tuple(vector), attr), metric))

    # --------------------------------------------------------------- terminals

    def planner(self) -> Planner:
        return Planner(self.catalog, self.params, self.rewrites)

    def nodes(self) -> DataFrame:
        """The set as a DataFrame ``node``."""
        if self.plan is None:
            raise ValueError("a traversal needs seeds")
        return self.planner().run(self.plan)

    def collect(self) -> list:
        """Ascending ids."""
        return [r["node"] for r in self.nodes().orderBy("node").collect()]

    def keys(self, attr: str) -> DataFrame:
        return self._joined().select(F.col(attr).alias("key"))

    def count(self) -> int:
        return self.nodes().count()

    def contains(self, node: Any) -> bool:
        return not self.nodes().where(F.col("node") == F.lit(node)).isEmpty()

    def degree(self, relation: str, per_node: bool = False) -> DataFrame:
        """The number of edges that leave the set, or of each node."""
        edges = self.catalog.relation(relation).edges.select(F.col("src").alias("node"))
        if not per_node:
            return self.nodes().join(edges, "node").agg(F.count("*").alias("degree"))
        return self.nodes().join(edges.groupBy("node").agg(F.count("*").alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))

    def _joined(self) -> DataFrame:
        """One row a node with the attributes of its domain."""
        nodes = self.catalog.domain(self.domain).nodes.dropDuplicates(["node"])
        return self.nodes().join(nodes, "node", "left")

    def attribute(self, expression: str) -> DataFrame:
        """(node, value) of an expression over the node's attributes."""
        df = self._joined()
        return df.select("node", cel.compile_value(expression, cel.columns_of(df.dtypes), self.params).col.alias("value"))

    def state(self) -> DataFrame:
        """(node, value): the state vector after all value steps."""
        df = self._joined() if self.values else self.nodes()
        value: Column = F.lit(1.0)
        of = cel.columns_of(df.dtypes)
        for v in self.values:
            if v.kind == "scale":
                value = value * v.arg
            elif v.kind == "mul":
                value = value * F.coalesce(of(v.arg).col.cast("double"), F.lit(0.0))
            elif v.kind == "div":
                by = of(v.arg).col.cast("double")
                value = F.when(by.isNull() | (by == 0), value).otherwise(F.try_divide(value, by))
            elif v.kind == "project":
                value = cel.compile_value(v.arg, of, self.params).col.cast("double")
            else:
                from meshwalk.operators.vectors import similarity

                value = similarity(F.col(v.arg[1]), list(v.arg[0]), v.metric)
        return df.select("node", value.alias("value"))

    def top_k(self, k: int) -> DataFrame:
        """The k largest values, ties by least id; missing values don't count."""
        return self.state().where(F.col("value").isNotNull() & ~F.isnan("value")).orderBy(F.desc("value"), "node").limit(k)

    def reduce_attr(self, expression: str, how: str) -> DataFrame:
        """One row ``result``: NULL and NaN are skipped, COUNT counts nodes, an empty SUM is 0."""
        how = how.upper()
        if how == "COUNT":
            return self.nodes().agg(F.count("*").alias("result"))
        return reduce_vector(self.attribute(expression), how)

    def reduce_state(self, how: str) -> DataFrame:
        return reduce_vector(self.state(), how.upper())

    def walk_reduce_sum(self, relation: str, attr: str | None = None) -> DataFrame:
        """Per target, the sum over walked edges of the target's attribute, else the edge's, else the target's id."""
        rel = self.catalog.relation(relation)
        met = self.nodes().join(rel.edges, F.col("node") == F.col("src"))
        target = self.catalog.domain(rel.dst_domain).nodes
        if attr is not None and attr in target.columns:
            met = met.select("dst").join(target.select(F.col("node").alias("dst"), F.col(attr).alias("v")), "dst", "left")
        else:
            met = met.select("dst", F.col(attr if attr is not None else "dst").alias("v"))
        return met.groupBy(F.col("dst").alias("node")).agg(F.sum(F.nanvl(F.col("v").cast("double"), F.lit(None))).alias("value"))


def reduce_vector(vec: DataFrame, how: str) -> DataFrame:
    """SUM, MUL, MIN, MAX, AVG, COUNT, ARGMIN or ARGMAX of (node, value); ties go to the least node."""
    x = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    some = F.when(x.isNotNull(), F.struct(x.alias("v"), F.col("node")))
    aggregates = {
        "SUM": lambda: F.coalesce(F.sum(x), F.lit(0.0)), "MUL": lambda: F.product(x), "MIN": lambda: F.min(x), "MAX": lambda: F.max(x), "AVG": lambda: F.avg(x),
        "COUNT": lambda: F.count(x), "ARGMIN": lambda: F.min(some)["node"], "ARGMAX": lambda: F.min(F.when(x.isNotNull(), F.struct((-x).alias("v"), F.col("node"))))["node"],
    }
    if how not in aggregates:
        raise ValueError(f"unknown reduction {how}")
    return vec.agg(aggregates[how]().alias("result"))


def traverse(catalog: GraphCatalog, rewrites: bool = True) -> Traversal:
    return Traversal(catalog, rewrites=rewrites)
