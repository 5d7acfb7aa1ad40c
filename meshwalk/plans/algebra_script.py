"""The matrix script: assignments over relations (matrices), vectors and sets.

    x = seeds(part, 1, 2)
    y = CO_BOUGHT * x
    r = pagerank(CO_BOUGHT, 0.85, 10)
    return topk(r, 5)

A matrix times a set is a hop; times a vector it is the plus-times product.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.operators import algebra as A
from meshwalk.operators import algorithms as G
from meshwalk.operators import vectors as V
from meshwalk.operators.components import connected_components
from meshwalk.operators.lanes import MultiLane

from .catalog import GraphCatalog
from .compiler import closure, hop


class ScriptError(ValueError):
    pass


_TOKEN = re.compile(r"[ \t]*(?:(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<param>\$\w+)|(?P<name>[A-Za-z_]\w*)|(?P<op>[-+*/=(),\[\]]))")


class Script:
    def __init__(self, catalog: GraphCatalog, params: Mapping[str, Any] | None = None):
        self.catalog, self.params, self.names = catalog, params or {}, {}

    def run(self, text: str) -> DataFrame:
        last = None
        for line in re.split(r"[;\n]", re.sub(r"(?m)(^|\s)(//|#|/ ).*$", "", text)):
            if not line.strip():
                continue
            m = re.match(r"\s*(?:(return)\b|(\w+)\s*[=:](?!=))?(.*)$", line)
            self.toks, self.at = self._tokens(m[3]), 0
            last = self._sum()
            if self.at < len(self.toks):
                raise ScriptError(f"unexpected {self.toks[self.at][1]!r} in {line.strip()!r}")
            if m[2]:
                self.names[m[2]] = last
            if m[1]:
                break
        if isinstance(last, MultiLane):
            return last.collect()
        if not isinstance(last, DataFrame):
            if last is None or isinstance(last, str):
                raise ScriptError("the script has no result")
            return self.catalog.spark.createDataFrame([(last,)], ["result"])
        return last

    def _tokens(self, text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ScriptError(f"unexpected text {text[at:]!r}")
            out.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        return out

    def _peek(self) -> str:
        return self.toks[self.at][1] if self.at < len(self.toks) else ""

    def _sum(self) -> Any:
        left = self._product()
        while self._peek() in ("+", "-"):
            op = self._peek()
            self.at += 1
            right = self._product()
            left = self._combine(left, right, "ADD" if op == "+" else "SUB")
        return left

    def _combine(self, a: Any, b: Any, op: str) -> Any:
        if isinstance(a, DataFrame) and isinstance(b, DataFrame):
            if "value" not in a.columns or "value" not in b.columns:
                return A.union(a, b) if op == "ADD" else A.difference(a, b)
            return A.ewise(a, b, op)
        if isinstance(b, DataFrame):
            a, b = b, a
        if isinstance(a, DataFrame):
            return a.select("node", ({"ADD": A.value() + b, "SUB": A.value() - b, "MUL": A.value() * b}[op]).alias("value"))
        return {"ADD": a + b, "SUB": a - b, "MUL": a * b}[op]

    def _product(self) -> Any:
        left = self._atom()
        while self._peek() == "*":
            self.at += 1
            right = self._atom()
            if isinstance(left, str):
                edges = self.catalog.relation(left).edges
                if isinstance(right, MultiLane):
                    left = right.out(left)
                else:
                    left = A.mxv(edges, right) if "value" in right.columns else hop(right, edges)
            else:
                left = self._combine(left, right, "MUL")
        return left

    def _atom(self) -> Any:
        if self.at >= len(self.toks):
            raise ScriptError("unexpected end")
        kind, v = self.toks[self.at]
        self.at += 1
        if kind == "num":
            return float(v) if re.search(r"[.eE]", v) else int(v)
        if kind == "str":
            return v[1:-1]
        if kind == "param":
            return self.params[v[1:]]
        if v == "(":
            out = self._sum()
            self._need(")")
            return out
        if v == "[":
            out = []
            while self._peek() != "]":
                out.append(self._sum())
                if self._peek() == ",":
                    self.at += 1
            self.at += 1
            return out
        if kind != "name":
            raise ScriptError(f"unexpected {v!r}")
        if self._peek() == "(":
            self.at += 1
            args = []
            while self._peek() != ")":
                if self.at >= len(self.toks):
                    raise ScriptError("unexpected end")
                args.append(self._sum())
                if self._peek() == ",":
                    self.at += 1
            self.at += 1
            return self._call(v, args)
        return self.names.get(v, v)

    def _need(self, op: str) -> None:
        if self._peek() != op:
            raise ScriptError(f"expected {op!r}")
        self.at += 1

    def _edges(self, name: Any, weight: bool = False) -> DataFrame:
        return self.catalog.relation(name).edges

    def _call(self, f: str, a: list) -> Any:
        spark = self.catalog.spark
        frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "node long")
        numbers = [x for x in a if isinstance(x, int | float)]
        table = {
            "seeds": lambda: self.catalog.domain(a[0]).nodes.select("node").distinct().where(F.col("node").isin(a[1:])),
            "nodes": lambda: self.catalog.domain(a[0]).nodes.select("node").distinct(),
            "ones": lambda: self.catalog.domain(a[0]).nodes.select("node", F.lit(1.0).alias("value")).distinct(),
            "column": lambda: self.catalog.domain(a[0]).nodes.select("node", F.col(a[1]).cast("double").alias("value")),
            "mxv": lambda: A.mxv(self._edges(a[0]), a[1], *(a[2:3] or ["plus_times"])),
            "vxm": lambda: A.vxm(self._edges(a[0]), a[1], *(a[2:3] or ["plus_times"])),
            "out": lambda: hop(a[1], self._edges(a[0])),
            "in": lambda: hop(a[1], self._edges(a[0]), "in"),
            "closure": lambda: closure(a[1], self._edges(a[0])),
            "pagerank": lambda: G.pagerank(self._edges(a[0]), None, numbers[0] if numbers else 0.85, int(numbers[1]) if len(numbers) > 1 else 20).withColumnRenamed("rank", "value"),
            "afforest": lambda: connected_components(self._edges(a[0])).withColumnRenamed("component", "value"),
            "degree": lambda: self._edges(a[0]).groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("value")),
            "bfs": lambda: G.bfs_levels(self._edges(a[0]), a[1]).withColumnRenamed("level", "value"),
            "sssp": lambda: G.shortest_paths(self._edges(a[0]), a[1], a[2]).withColumnRenamed("distance", "value"),
            "triangles": lambda: G.triangle_counts(self._edges(a[0])).withColumnRenamed("triangles", "value"),
            "k_core": lambda: G.core_numbers(self._edges(a[0])).withColumnRenamed("core", "value"),
            "k_truss": lambda: G.k_truss(self._edges(a[0]), a[1]),
            "hits": lambda: G.hits(self._edges(a[0])),
            "katz": lambda: G.katz(self._edges(a[0])).withColumnRenamed("score", "value"),
            "eigenvector": lambda: G.eigenvector(self._edges(a[0])).withColumnRenamed("score", "value"),
            "jaccard": lambda: G.neighbour_similarity(self._edges(a[0])),
            "cosine": lambda: G.neighbour_similarity(self._edges(a[0]), "cosine"),
            "mst": lambda: G.minimum_spanning_forest(self._edges(a[0]), a[1]),
            "topological_sort": lambda: G.topological_levels(self._edges(a[0])).withColumnRenamed("level", "value"),
            "communities": lambda: G.communities(self._edges(a[0])).withColumnRenamed("community", "value"),
            "betweenness": lambda: G.betweenness(self._edges(a[0]), a[1]).withColumnRenamed("score", "value"),
            "ewise_mul": lambda: A.ewise(a[0], a[1], "MUL") if "value" in a[0].columns else A.intersect(a[0], a[1]),
            "ewise_add": lambda: A.ewise(a[0], a[1], "ADD") if "value" in a[0].columns else A.union(a[0], a[1]),
            "reduce": lambda: _reduce(a[0], a[1]),
            "topk": lambda: a[0].where(A.value().isNotNull()).orderBy(F.desc("value"), "node").limit(a[1]),
            "ann_search": lambda: V.top_k(self.catalog.domain(a[0]).nodes, a[2], a[3], a[4] if len(a) > 4 else "cosine", "node", a[1]).withColumnRenamed("score", "value"),
            "rerank_dot": lambda: V.rerank(a[0], self.catalog.domain(a[1]).nodes, a[3], "dot", None, "node", a[2]).withColumnRenamed("score", "value"),
            "lane_seeds": lambda: MultiLane(self.catalog).from_seeds(a[0], a[1:]),
            "lane_out": lambda: a[1].out(a[0]),
            "lane_in": lambda: a[1].in_(a[0]),
            "lane_closure": lambda: a[1].repeat_until_stable(a[0]),
            "lane_quorum": lambda: a[0].nodes_with_quorum(a[1]),
            "lane_set_cover": lambda: a[0].greedy_set_cover().select("node"),
            "set": lambda: frame(a),
        }
        if f not in table:
            raise ScriptError(f"no function {f}")
        return table[f]()


def _reduce(vec: DataFrame, how: str) -> DataFrame:
    from .traversal import reduce_vector

    return reduce_vector(vec, how.upper())


def run(text: str, catalog: GraphCatalog, params: Mapping[str, Any] | None = None) -> DataFrame:
    return Script(catalog, params).run(text)
