"""The S-expression form of plans: a reader and an evaluator.

Forms of a program thread one value, the current set, vector or lanes; a form's
last argument may name another.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.operators import algebra as A
from meshwalk.operators import vectors as V
from meshwalk.operators.lanes import MultiLane

from .catalog import GraphCatalog, number_rows
from .compiler import closure, hop


class SchemeError(ValueError):
    pass


class Symbol(str):
    pass


def read(text: str) -> list:
    """The expressions of a text as nested lists."""
    toks = re.findall(r'"(?:\\.|[^"\\])*"|[()]|[^\s()]+', re.sub(r";[^\n]*", "", text))
    at = 0

    def one() -> Any:
        nonlocal at
        if at >= len(toks):
            raise SchemeError("unexpected end")
        t = toks[at]
        at += 1
        if t == "(":
            out = []
            while True:
                if at >= len(toks):
                    raise SchemeError("a parenthesis isn't closed")
                if toks[at] == ")":
                    at += 1
                    return out
                out.append(one())
        if t == ")":
            raise SchemeError("a parenthesis isn't open")
        if t[0] == '"':
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        if re.fullmatch(r"-?\d*\.\d+(?:[eE][+-]?\d+)?", t):
            return float(t)
        return {"#t": True, "#f": False}.get(t, Symbol(t))

    out = []
    while at < len(toks):
        out.append(one())
    return out


class Evaluator:
    MAX_LOOPS = 1000

    def __init__(self, catalog: GraphCatalog, seed: DataFrame | None = None, domain: str | None = None, params: Mapping[str, Any] | None = None):
        self.catalog, self.current, self.domain, self.params = catalog, seed, domain, params or {}
        self.names: dict[str, Any] = {}
        self.queries: dict[str, list] = {}

    def ev(self, e: Any) -> Any:
        if isinstance(e, Symbol):
            if e in self.names:
                return self.names[e]
            if e[0] in "$@" and e[1:] in self.params:
                return self.params[e[1:]]
            raise SchemeError(f"unknown name {e}")
        if not isinstance(e, list):
            return e
        if not e:
            return []
        head, rest = e[0], e[1:]
        if not isinstance(head, Symbol):
            return [self.ev(x) for x in e]
        f = getattr(self, "do_" + re.sub(r"\W", "_", head).strip("_"), None)
        if f is None:
            raise SchemeError(f"no form {head}")
        return f(rest)

    def _body(self, forms: list) -> Any:
        for x in forms:
            self.current = self.ev(x)
        return self.current

    do_program = do_begin = _body

    def do_define_query(self, r: list) -> Any:
        self.queries[r[0] if not isinstance(r[0], list) else r[0][0]] = r[1:]
        return self._body(r[1:])

    def do_let(self, r: list) -> Any:
        for name, value in r[0]:
            self.names[name] = self.ev(value)
        return self._body(r[1:])

    def do_set(self, r: list) -> Any:
        self.names[r[0]] = self.ev(r[1])
        return self.names[r[0]]

    def do_return(self, r: list) -> Any:
        return self.ev(r[0]) if r else self.current

    def do_loop_while(self, r: list) -> Any:
        """Runs the body while the test (a set that isn't empty, a true value) holds."""
        for _ in range(self.MAX_LOOPS):
            t = self.ev(r[0])
            if (t.isEmpty() if isinstance(t, DataFrame) else not t):
                return self.current
            self._body(r[1:])
        raise SchemeError("the loop doesn't end")

    def _set(self, r: list, at: int) -> DataFrame:
        s = self.ev(r[at]) if len(r) > at else self.current
        if s is None:
            raise SchemeError("there is no current set; give a seed")
        return s.to_traversal().nodes() if isinstance(s, MultiLane) else s

    def do_bitset_empty(self, r: list) -> DataFrame:
        return self.catalog.spark.createDataFrame([], "node long")

    def do_bitset_all(self, r: list) -> DataFrame:
        self.domain = str(r[0])
        return self.catalog.domain(self.domain).nodes.select("node").distinct()

    def do_bitset_from(self, r: list) -> DataFrame:
        ids = r[0] if len(r) == 1 and isinstance(r[0], list) else r
        return self.catalog.spark.createDataFrame([(self.ev(i),) for i in ids], "node long").distinct()

    def do_bitset_cardinality(self, r: list) -> int:
        return self._set(r, 0).count()

    def _hop(self, r: list, direction: str) -> DataFrame:
        return hop(self._set(r, 1), self.catalog.relation(str(r[0])).edges, direction)

    def do_csr_walk(self, r: list) -> DataFrame:
        return self._hop(r, "out")

    def do_csc_walk(self, r: list) -> DataFrame:
        return self._hop(r, "in")

    def do_csr_walk_2hop(self, r: list) -> DataFrame:
        first = hop(self._set(r, 2), self.catalog.relation(str(r[0])).edges, "out", False)
        return hop(first, self.catalog.relation(str(r[1])).edges)

    def do_fixpoint(self, r: list) -> DataFrame:
        rel = self.catalog.relation(str(r[0]) or str(r[2][1]))
        return closure(self._set(r, 3), rel.edges, "in" if len(r) > 2 and r[2][0] == "csc-walk" else "out", int(r[1]), True, (rel.multiplicity or 9) <= 1)

    def _pair(self, r: list) -> tuple[DataFrame, DataFrame]:
        here = self.current  # both sides start from what is current
        a = self.ev(r[0])
        self.current = here
        b = self.ev(r[1])
        self.current = here
        return a, b

    def do_set_union(self, r: list) -> DataFrame:
        return A.union(*self._pair(r))

    def do_set_intersect(self, r: list) -> DataFrame:
        return A.intersect(*self._pair(r))

    def do_set_difference(self, r: list) -> DataFrame:
        return A.difference(*self._pair(r))

    def do_collect_bitset(self, r: list) -> DataFrame:
        return self._set(r, 0)

    do_collect_array = do_collect_vector = do_collect_bitset

    def do_collect_count(self, r: list) -> DataFrame:
        return self._set(r, 0).agg(F.count("*").alias("result"))

    do_collect_scalar = do_collect_count

    def do_topk(self, r: list) -> DataFrame:
        return self._set(r, 1).where("value IS NOT NULL").orderBy(F.desc("value"), "node").limit(int(r[0]))

    def do_lane_init_seeds(self, r: list) -> MultiLane:
        """A lane for each id given, or for each node of the set, in their order."""
        if r and isinstance(r[0], list) and r[0]:
            return MultiLane(self.catalog).from_seeds(self.domain, [self.ev(i) for i in r[0]])
        return MultiLane(self.catalog).from_groups(self.domain, number_rows(self.current.select("node").distinct(), ["node"], "lane"))

    def do_lane_csr_walk(self, r: list) -> MultiLane:
        return self.current.out(str(r[0]))

    def do_lane_csc_walk(self, r: list) -> MultiLane:
        return self.current.in_(str(r[0]))

    do_lane_walk_csr, do_lane_walk_csc = do_lane_csr_walk, do_lane_csc_walk

    def do_lane_filter_quorum(self, r: list) -> MultiLane:
        return self.current.where_quorum(int(r[0]))

    def do_lane_set_cover(self, r: list) -> DataFrame:
        return self.current.greedy_set_cover().select("node")

    def do_vector_ann_search(self, r: list) -> DataFrame:
        """(vector-ann-search domain attr (vector) k metric)"""
        self.domain = str(r[0])
        return V.top_k(self.catalog.domain(self.domain).nodes, [self.ev(x) for x in r[2]], int(r[3]), str(r[4]) if len(r) > 4 else "cosine", "node", str(r[1])).withColumnRenamed("score", "value")

    def do_vector_rerank_dot(self, r: list) -> DataFrame:
        """(vector-rerank-dot domain attr (vector))"""
        return V.rerank(self._set(r, 3), self.catalog.domain(str(r[0])).nodes, [self.ev(x) for x in r[2]], "dot", None, "node", str(r[1])).withColumnRenamed("score", "value")


def run(text: str, catalog: GraphCatalog, params: Mapping[str, Any] | None = None, seed: DataFrame | None = None, domain: str | None = None) -> DataFrame:
    e = Evaluator(catalog, seed, domain, params)
    out = None
    for form in read(text):
        out = e.ev(form)
    if isinstance(out, MultiLane):
        return out.to_traversal().nodes()
    if out is None or isinstance(out, DataFrame):
        if out is None:
            raise SchemeError("the program is empty")
        return out
    return catalog.spark.createDataFrame([(out,)], ["result"])
