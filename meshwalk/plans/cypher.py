"""The openCypher subset: one linear path, conditions joined by AND, one thing returned.

    MATCH (a:Domain)-[:R|S*2]->(b)<-[:T]-(c) WHERE a.id IN [1, 2] AND b.x > 3
    [WITH c, count(a) AS n WHERE n >= 2] RETURN c [ORDER BY vector_cosine(c.v, [..])] [LIMIT k]

Answers are sets. A variable's set holds the nodes of complete matches: what the
path reaches forward from its start, met with what reaches its end.

By default ``*a..b`` means b hops and ``*`` any number of hops including none;
``strict=True`` gives both their openCypher meaning. Conditions on any variable
count, a label must be the domain that the path is in, and LIMIT applies in the
order of ids.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.operators.lanes import MultiLane

from . import logical as L
from .catalog import GraphCatalog
from .compiler import Planner
from .traversal import reduce_vector


class CypherError(ValueError):
    pass


MAX_HOPS = 64


@dataclass
class Edge:
    relations: tuple[str, ...]
    direction: str
    low: int = 1
    high: int | None = 1  # None: any number


@dataclass
class Query:
    variables: list[str] = field(default_factory=list)
    labels: dict[str, str] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    where: dict[str, list[str]] = field(default_factory=dict)
    ids: dict[str, Any] = field(default_factory=dict)
    ann: tuple | None = None
    quorum: int | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    item: tuple[str, str, str | None] = ("", "", None)  # function, variable, attribute
    order: tuple | None = None
    limit: int | None = None


_TOKEN = re.compile(r"\s*(?:(?P<num>-?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\d+))(?!\w|\.\d)|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<param>\$\w+)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<op><-|->|<=|>=|<>|!=|\.\.|[-<>=()\[\]{}:,.|*]))")


class _Reader:
    def __init__(self, text: str, params: Mapping[str, Any]):
        self.params, self.toks, at = params, [], 0
        text = re.sub(r"//[^\n]*", "", text).strip().rstrip(";")
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"unexpected text at {at}: {text[at : at + 12]!r}")
            raw, kind = m[m.lastgroup], m.lastgroup
            if kind == "num" and raw[0] == "-" and self.toks and self.toks[-1][1] in (")", "]"):
                raise CypherError(f"unexpected {raw}")
            self.toks.append((kind, raw.strip("`") if kind == "name" else raw))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.toks[self.at + ahead] if self.at + ahead < len(self.toks) else ("end", "")

    def word(self, *names: str) -> bool:
        if all(self.peek(i)[0] == "name" and self.peek(i)[1].upper() == n for i, n in enumerate(names)):
            self.at += len(names)
            return True
        return False

    def op(self, *ops: str) -> str | None:
        if self.peek()[0] == "op" and self.peek()[1] in ops:
            self.at += 1
            return self.toks[self.at - 1][1]
        return None

    def need(self, *ops: str) -> str:
        got = self.op(*ops)
        if not got:
            raise CypherError(f"expected {' or '.join(ops)}, found {self.peek()[1]!r}")
        return got

    def name(self) -> str:
        kind, v = self.peek()
        if kind != "name":
            raise CypherError(f"expected a name, found {v!r}")
        self.at += 1
        return v

    def value(self) -> Any:
        kind, v = self.peek()
        self.at += 1
        if kind == "num":
            return float(v) if "." in v else int(v)
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", v[1:-1])
        if kind == "param":
            if v[1:] not in self.params:
                raise CypherError(f"no value for parameter {v}")
            return self.params[v[1:]]
        if kind == "name" and v.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[v.lower()]
        if v == "[":
            out = []
            while not self.op("]"):
                out.append(self.value())
                self.op(",")
            return out
        raise CypherError(f"expected a value, found {v!r}")


def parse(text: str, params: Mapping[str, Any] | None = None) -> Query:
    r, q = _Reader(text, params or {}), Query()
    if not r.word("MATCH"):
        raise CypherError("a query starts with MATCH")
    _node(r, q)
    while r.peek()[1] in ("-", "<-"):
        _edge(r, q)
        _node(r, q)
    if r.word("WHERE"):
        _conditions(r, q)
    if r.word("WITH"):
        while True:
            if r.word("COUNT"):
                r.need("(")
                counted = r.name()
                r.need(")")
                if not r.word("AS"):
                    raise CypherError("count needs a name")
                q.aliases[r.name()] = counted
            else:
                r.name()
            if not r.op(","):
                break
        if r.word("WHERE"):
            _conditions(r, q)
    if not r.word("RETURN"):
        raise CypherError("RETURN is missing")
    r.word("DISTINCT")
    first = r.name()
    if r.op("("):
        r.word("DISTINCT")
        v = r.name()
        q.item = (first.lower(), v, r.name() if r.op(".") else None)
        r.need(")")
        if q.item[0] not in ("count", "sum", "min", "max", "avg", "argmin", "argmax"):
            raise CypherError(f"unknown function {first}")
    else:
        q.item = ("", first, r.name() if r.op(".") else None)
    if q.item[1] not in q.variables:
        raise CypherError(f"unknown variable {q.item[1]}")
    if r.word("ORDER", "BY"):
        what = r.name()
        if r.op("("):
            v = r.name()
            r.need(".")
            attr = r.name()
            r.need(",")
            q.order = ("vector", v, attr, what.lower().removeprefix("vector_"), r.value())
            r.need(")")
        else:
            q.order = ("attr", what, r.name() if r.op(".") else "id")
        down = r.word("DESC")
        q.order = (*q.order, down or (q.order[0] == "vector" and not r.word("ASC")))
        r.word("ASC")
    if r.word("LIMIT"):
        q.limit = int(r.value())
    if r.peek()[0] != "end":
        raise CypherError(f"unexpected {r.peek()[1]!r}")
    return q


def _node(r: _Reader, q: Query) -> None:
    r.need("(")
    v = r.name() if r.peek()[0] == "name" else f"_{len(q.variables)}"
    if v in q.variables:
        raise CypherError(f"{v} stands twice: only linear paths can be matched")
    q.variables.append(v)
    if r.op(":"):
        q.labels[v] = r.name()
    r.need(")")


def _edge(r: _Reader, q: Query) -> None:
    start = r.need("-", "<-")
    r.need("[")
    if r.peek()[0] == "name":
        r.name()
    if not r.op(":"):
        raise CypherError("an edge needs a type")
    names = [r.name()]
    while r.op("|"):
        r.op(":")
        names.append(r.name())
    e = Edge(tuple(names), "out")
    if r.op("*"):
        e.low, e.high = 1, None
        if r.peek()[0] == "num":
            e.low = e.high = int(r.value())
        if r.op(".."):
            e.low = e.low if e.high is not None else 1
            e.high = int(r.value()) if r.peek()[0] == "num" else None
        if e.high is not None and not 0 <= e.low <= e.high <= MAX_HOPS:
            raise CypherError(f"{MAX_HOPS} hops are the most, in rising order")
    r.need("]")
    end = r.need("-", "->")
    if (start, end) == ("<-", "->"):
        raise CypherError("an edge points one way")
    e.direction = "in" if start == "<-" else "out" if end == "->" else "both"
    q.edges.append(e)


def _conditions(r: _Reader, q: Query) -> None:
    while True:
        if r.peek()[1].lower() == "vector_ann" and r.peek(1)[1] == "(":
            r.at += 2
            v = r.name()
            r.need(".")
            attr = r.name()
            r.need(",")
            vec = r.value()
            r.need(",")
            q.ann = (v, attr, vec, int(r.value()))
            r.need(")")
        elif r.peek()[1].lower() == "count" and r.peek(1)[1] == "(":
            r.at += 2
            r.name()
            r.need(")")
            _quorum(r, q)
        elif r.peek()[1].lower() == "quorum" or r.peek()[1] in q.aliases and r.peek(1)[1] != ".":
            r.at += 1
            _quorum(r, q)
        else:
            _condition(r, q)
        if not r.word("AND"):
            if r.peek()[1].upper() in ("OR", "NOT", "XOR"):
                raise CypherError("conditions are joined by AND alone")
            return


def _quorum(r: _Reader, q: Query) -> None:
    r.need(">=")
    q.quorum = int(r.value())


def _condition(r: _Reader, q: Query) -> None:
    v = r.name()
    if v not in q.variables:
        raise CypherError(f"unknown variable {v}")
    r.need(".")
    attr = r.name()
    key = "node" if attr == "id" else attr
    out = q.where.setdefault(v, [])
    if r.word("IN"):
        values = r.value()
        if attr == "id":
            q.ids[v] = list(values)
        out.append(f"{key} in [{', '.join(map(_text, values))}]")
    elif r.word("STARTS", "WITH"):
        out.append(f"startsWith({key}, {_text(r.value())})")
    elif r.word("ENDS", "WITH"):
        out.append(f"endsWith({key}, {_text(r.value())})")
    elif r.word("CONTAINS"):
        out.append(f"contains({key}, {_text(r.value())})")
    elif r.word("IS", "NULL"):
        out.append(f"is_null({key})")
    elif r.word("IS", "NOT", "NULL"):
        out.append(f"is_not_null({key})")
    else:
        op = {"=": "==", "<>": "!="}.get(o := r.need("=", "<>", "!=", "<", "<=", ">", ">="), o)
        value = r.value()
        if attr == "id" and op == "==":
            q.ids[v] = [value]
        out.append(f"{key} {op} {_text(value)}")


def _text(v: Any) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else repr(v)


class Runner:
    def __init__(self, catalog: GraphCatalog, params: Mapping[str, Any] | None = None, strict: bool = False):
        self.catalog, self.params, self.strict = catalog, params or {}, strict
        self.planner = Planner(catalog, self.params)

    def domains(self, q: Query) -> list[str]:
        """The domain of each variable; a label that disagrees is an error."""
        if not q.edges:
            label = q.labels.get(q.variables[0])
            if label is None:
                raise CypherError("a lone node needs a label")
            return [self.catalog.domain(label).name]
        first = self.catalog.relation(q.edges[0].relations[0])
        out = [first.dst_domain if q.edges[0].direction == "in" else first.src_domain]
        for e in q.edges:
            rel = self.catalog.relation(e.relations[0])
            here, there = (rel.src_domain, rel.dst_domain) if e.direction != "in" else (rel.dst_domain, rel.src_domain)
            if out[-1] != here:
                if e.direction == "both" and out[-1] == there:
                    here, there = there, here
                else:
                    raise CypherError(f"{e.relations[0]} doesn't start in {out[-1]}")
            out.append(there)
        for v, d in zip(q.variables, out, strict=True):
            if v in q.labels and q.labels[v].lower() != d.lower():
                raise CypherError(f"{v} is of {d}, not {q.labels[v]}")
        return out

    def _walk(self, plan: L.Plan, e: Edge, backward: bool) -> L.Plan:
        direction = e.direction if not backward else {"out": "in", "in": "out", "both": "both"}[e.direction]
        if e.high is None:
            return L.Fixpoint(plan, e.relations, 1024, direction, e.low if self.strict else 0)

        def times(n: int) -> L.Plan:
            out = plan
            for _ in range(n):
                out = L.Hop(out, e.relations, direction)
            return out

        if not self.strict:
            return times(e.high)
        out = times(e.low)
        for n in range(e.low + 1, e.high + 1):
            out = L.Union(out, times(n))
        return out

    def _own(self, q: Query, i: int, domain: str, plan: L.Plan | None) -> L.Plan:
        v = q.variables[i]
        out = plan if plan is not None else L.Seed(domain)
        for c in q.where.get(v, ()):
            out = L.Filter(out, c)
        if q.ann and q.ann[0] == v:
            out = L.Within(out, L.Frame(domain, self._ann(q, domain)))
        return out

    def _ann(self, q: Query, domain: str) -> DataFrame:
        from meshwalk.operators.vectors import top_k

        _, attr, vec, k = q.ann
        return top_k(self.catalog.domain(domain).nodes, vec, k, "cosine", "node", attr).select("node")

    def matched(self, q: Query, target: str) -> L.Plan:
        domains, at = self.domains(q), q.variables.index(target)
        plan = self._own(q, 0, domains[0], None)
        for i in range(at):
            plan = self._own(q, i + 1, domains[i + 1], self._walk(plan, q.edges[i], False))
        if at == len(q.edges):
            return plan
        back = self._own(q, len(q.edges), domains[-1], None)
        for i in range(len(q.edges) - 1, at - 1, -1):
            back = self._own(q, i, domains[i], self._walk(back, q.edges[i], True))
        return L.Within(plan, back)

    def _lanes(self, q: Query, target: str) -> DataFrame:
        """Nodes of the target that paths from so many of the start's ids reach."""
        domains, start = self.domains(q), q.variables[0]
        if q.variables.index(target) != len(q.edges):
            raise CypherError("a quorum is over the end of the path")
        ids = q.ids.get(start)
        seeds = self.planner.run(self._own(q, 0, domains[0], None))
        if ids is not None:
            order = {k: i for i, k in enumerate(ids)}
            lanes = self.catalog.spark.createDataFrame([(i, k) for k, i in order.items()], "lane long, node long").join(seeds, "node", "left_semi")
        else:
            lanes = seeds.select(F.col("node").alias("lane"), "node")
        m = MultiLane(self.catalog, lanes, domains[0])
        for i, e in enumerate(q.edges):
            if e.high is None:
                m = m.repeat_until_stable(e.relations[0], direction=e.direction)
            for _ in range(e.high or 0):
                m = {"out": m.out, "in": m.in_, "both": m.both}[e.direction](*e.relations)
            v = q.variables[i + 1]
            for c in q.where.get(v, ()):
                m = m.filter(c)
        return m.nodes_with_quorum(q.quorum)

    def run(self, q: Query) -> DataFrame:
        """One column ``result`` (and ``score`` when vectors are ranked)."""
        how, v, attr = q.item
        domain = self.domains(q)[q.variables.index(v)]
        found = self._lanes(q, v) if q.quorum is not None else self.planner.run(self.matched(q, v))
        nodes = self.catalog.domain(domain).nodes.dropDuplicates(["node"])
        if how == "count":
            return found.agg(F.count("*").alias("result"))
        if how:
            if attr is None:
                raise CypherError(f"{how} needs an attribute")
            return reduce_vector(found.join(nodes.select("node", F.col(attr).alias("value")), "node", "left"), how.upper())
        met = found.join(nodes, "node", "left") if attr or q.order and q.order[0] == "vector" or q.order and q.order[2] != "id" else found
        out = met.select("node", F.col(attr if attr and attr != "id" else "node").alias("result"), *self._rank(q))
        if q.order:
            down = q.order[-1]
            out = out.orderBy(F.desc_nulls_last("score") if down else F.asc_nulls_last("score"), "node")
        elif q.limit is not None:
            out = out.orderBy("node")
        if q.limit is not None:
            out = out.limit(q.limit)
        if q.order and q.order[0] == "vector":
            return out.select("result", "score")
        return out.select("result") if not attr or q.limit is not None or q.order else out.select("result").distinct()

    def _rank(self, q: Query) -> list:
        if not q.order:
            return []
        if q.order[0] == "attr":
            return [F.col("node" if q.order[2] == "id" else q.order[2]).alias("score")]
        from meshwalk.operators.vectors import similarity

        return [similarity(F.col(q.order[2]), list(q.order[4]), q.order[3]).alias("score")]


def run(text: str, catalog: GraphCatalog, params: Mapping[str, Any] | None = None, strict: bool = False) -> DataFrame:
    return Runner(catalog, params, strict).run(parse(text, params))
