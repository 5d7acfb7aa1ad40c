"""Datalog over the catalog: stratified negation, recursion by semi-naive rounds.

Relations are binary predicates and domains unary ones. ``^p(X, Y)`` and ``~p(X, Y)``
read a relation backwards. Rules join their atoms on shared variables; every round of
a recursive stratum joins with the new rows alone and is cut.

    reach(X, Y) :- follows(X, Y).
    reach(X, Y) :- reach(X, Z), follows(Z, Y).
    ?- reach(5, Y).
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import GraphCatalog
from .compiler import closure
from .durable import cut


class DatalogError(ValueError):
    pass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Atom:
    pred: str
    args: tuple
    negated: bool = False
    reverse: bool = False


@dataclass(frozen=True)
class Test:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple


_TOKEN = re.compile(r"\s*(?:(?P<str>\"[^\"]*\"|'[^']*')|(?P<num>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>:-|\?-|!=|<=|>=|==|[(),.!^~<>=]))")


def _tokens(text: str) -> list[tuple[str, str]]:
    text = re.sub(r"(?m)(//|%|#)[^\n]*$", "", text)
    text = re.sub(r"(?m)^\s*\.\w+[^\n]*$", "", text)  # declarations
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise DatalogError(f"unexpected text: {text[at : at + 12]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str) -> tuple[list[Rule], list[Atom]]:
    """Rules (facts have an empty body) and goals."""
    toks, at = _tokens(text), 0

    def peek(k: int = 0) -> tuple[str, str]:
        return toks[at + k] if at + k < len(toks) else ("end", "")

    def need(v: str) -> None:
        nonlocal at
        if peek()[1] != v:
            raise DatalogError(f"expected {v!r}, found {peek()[1]!r}")
        at += 1

    def term() -> Any:
        nonlocal at
        kind, v = peek()
        at += 1
        if kind == "num":
            return float(v) if "." in v else int(v)
        if kind == "str":
            return v[1:-1]
        if kind == "name":
            return Var(f"_any{at}") if v == "_" else Var(v) if v[0].isupper() or v[0] == "_" else v
        raise DatalogError(f"expected a term, found {v!r}")

    def literal() -> Atom | Test:
        nonlocal at
        negated = reverse = False
        while peek()[1] in ("!", "^", "~") or peek()[1] == "not" and peek(1)[0] == "name":
            mark = peek()[1]
            negated, reverse, at = negated or mark in ("!", "not"), reverse or mark in ("^", "~"), at + 1
        if peek()[0] == "name" and peek(1)[1] == "(":
            name, args = peek()[1], []
            at += 2
            while peek()[1] != ")":
                args.append(term())
                if peek()[1] == ",":
                    at += 1
            at += 1
            return Atom(name, tuple(args), negated, reverse)
        left = term()
        op = peek()[1]
        if op not in ("=", "==", "!=", "<", "<=", ">", ">="):
            raise DatalogError(f"unexpected {op!r}")
        at += 1
        return Test(op, left, term())

    rules, goals = [], []
    while at < len(toks):
        if peek()[1] == "?-":
            at += 1
            goals.append(literal())
            need(".")
            continue
        head, body = literal(), []
        if peek()[1] == ":-":
            at += 1
            body.append(literal())
            while peek()[1] == ",":
                at += 1
                body.append(literal())
        need(".")
        rules.append(Rule(head, tuple(body)))
    for r in rules:
        _check(r)
    return rules, goals


def _check(r: Rule) -> None:
    bound = {a.name for b in r.body if isinstance(b, Atom) and not b.negated for a in b.args if isinstance(a, Var)}
    used = [a for a in r.head.args if isinstance(a, Var)]
    used += [a for b in r.body if isinstance(b, Test) for a in (b.left, b.right) if isinstance(a, Var)]
    used += [a for b in r.body if isinstance(b, Atom) and b.negated for a in b.args if isinstance(a, Var) and not a.name.startswith("_any")]
    for a in used:
        if a.name not in bound:
            raise DatalogError(f"{a.name} isn't bound by a positive atom of the rule for {r.head.pred}")


def strata(rules: list[Rule]) -> list[list[str]]:
    """Groups of mutually recursive predicates in the order of evaluation; a negative cycle is an error."""
    heads = {r.head.pred for r in rules}
    needs: dict[str, set[str]] = {h: set() for h in heads}
    negative: set[tuple[str, str]] = set()
    for r in rules:
        for b in r.body:
            if isinstance(b, Atom) and b.pred in heads:
                needs[r.head.pred].add(b.pred)
                if b.negated:
                    negative.add((r.head.pred, b.pred))
    reach = {h: set(n) for h, n in needs.items()}
    for k in heads:
        for i in heads:
            if k in reach[i]:
                reach[i] |= reach[k]
    groups, placed = [], set()
    for h in sorted(heads):
        if h not in placed:
            g = sorted({h} | {x for x in reach[h] if h in reach[x]})
            groups.append(g)
            placed |= set(g)
    for a, b in negative:
        if b == a or a in reach[b]:
            raise DatalogError(f"{a} depends on its own negation")
    out: list[list[str]] = []
    while groups:
        for g in groups:
            if all(x in g or any(x in o for o in out) for p in g for x in reach[p]):
                out.append(g)
                groups.remove(g)
                break
    return out


class Evaluator:
    def __init__(self, catalog: GraphCatalog, rules: list[Rule], max_iter: int = 1000):
        self.catalog, self.rules, self.max_iter = catalog, rules, max_iter
        self.known: dict[str, DataFrame] = {}
        self.order = strata(rules)
        self.arity = {r.head.pred: len(r.head.args) for r in rules}

    def base(self, a: Atom) -> DataFrame:
        """Columns c0, c1, ... of a predicate."""
        if a.pred in self.known:
            return self.known[a.pred]
        if a.pred in self.catalog.relations:
            return self.catalog.relation(a.pred).edges.select(F.col("src").alias("c0"), F.col("dst").alias("c1"))
        if a.pred in self.catalog.domains:
            return self.catalog.domain(a.pred).nodes.select(F.col("node").alias("c0"))
        raise DatalogError(f"unknown predicate {a.pred}")

    def bind(self, a: Atom, df: DataFrame) -> DataFrame:
        """Columns named by the atom's variables; constants and repeated variables filter."""
        if len(df.columns) != len(a.args):
            raise DatalogError(f"{a.pred} has {len(df.columns)} arguments")
        args = a.args[::-1] if a.reverse else a.args
        seen: dict[str, str] = {}
        for i, x in enumerate(args):
            if not isinstance(x, Var):
                df = df.where(F.col(f"c{i}") == F.lit(x))
            elif x.name in seen:
                df = df.where(F.col(f"c{i}") == F.col(seen[x.name]))
            else:
                seen[x.name] = f"c{i}"
        return df.select(*(F.col(c).alias(v) for v, c in seen.items())) if seen else df.limit(1).select(F.lit(1).alias("_true"))

    def evaluate(self, r: Rule, delta: DataFrame | None = None, at: int = -1) -> DataFrame:
        """Head rows of the rule; body atom ``at`` reads the new rows only."""
        out: DataFrame | None = None
        positive = [(i, b) for i, b in enumerate(r.body) if isinstance(b, Atom) and not b.negated]
        for i, b in sorted(positive, key=lambda x: x[0] != at):  # the new rows first
            df = self.bind(b, delta if i == at else self.base(b))
            shared = [] if out is None else [c for c in df.columns if c in out.columns]
            out = df if out is None else out.join(df, shared) if shared else out.join(F.broadcast(df.distinct()) if df.columns == ["_true"] else df)
        if out is None:
            out = self.catalog.spark.range(1).select(F.lit(1).alias("_true"))
        value = lambda x: F.col(x.name) if isinstance(x, Var) else F.lit(x)
        for b in r.body:
            if isinstance(b, Test):
                a, c = value(b.left), value(b.right)
                out = out.where({"=": a == c, "==": a == c, "!=": a != c, "<": a < c, "<=": a <= c, ">": a > c, ">=": a >= c}[b.op])
            elif b.negated:
                df = self.bind(b, self.base(b))
                shared = [c for c in df.columns if c in out.columns]
                if shared:
                    out = out.join(df.select(*shared).distinct(), shared, "left_anti")
                elif not df.isEmpty():
                    out = out.where(F.lit(False))
        return out.select(*(value(x).alias(f"c{i}") for i, x in enumerate(r.head.args)))

    def solve(self) -> dict[str, DataFrame]:
        for group in self.order:
            own = [r for r in self.rules if r.head.pred in group]
            loops = [r for r in own if any(isinstance(b, Atom) and b.pred in group for b in r.body)]
            start: dict[str, DataFrame] = {}
            for p in group:
                parts = [self.evaluate(r) for r in own if r.head.pred == p and r not in loops]
                df = parts[0] if parts else self._empty(p)
                for x in parts[1:]:
                    df = df.unionByName(x)
                start[p] = df.distinct()
            if not loops:
                self.known.update(start)
                continue
            new = {p: cut(df) for p, df in start.items()}
            self.known.update(new)
            for a in (b for r in loops for b in r.body if isinstance(b, Atom) and b.pred in self.catalog.relations and b.pred not in self.known):
                self.known[a.pred] = cut(self.base(a).distinct())  # once, not in every round
            for _ in range(self.max_iter):
                step: dict[str, DataFrame] = {}
                for r in loops:
                    for i, b in enumerate(r.body):
                        if isinstance(b, Atom) and b.pred in group and not b.negated:
                            got = self.evaluate(r, new[b.pred], i)
                            step[r.head.pred] = step[r.head.pred].unionByName(got) if r.head.pred in step else got
                new = {p: cut(step[p].distinct().join(self.known[p], self.known[p].columns, "left_anti")) if p in step else self.known[p].limit(0) for p in group}
                if all(d.isEmpty() for d in new.values()):
                    break
                for p in group:
                    self.known[p] = cut(self.known[p].unionByName(new[p]))
            else:
                raise DatalogError(f"{', '.join(group)} did not settle in {self.max_iter} rounds")
        return self.known

    def _empty(self, pred: str) -> DataFrame:
        return self.catalog.spark.createDataFrame([], ", ".join(f"c{i} long" for i in range(self.arity[pred])))


def _closure_of(rules: list[Rule], goal: Atom) -> tuple[str, str] | None:
    """(relation, direction) if the goal is the plain transitive closure of a relation with one end given."""
    own = [r for r in rules if r.head.pred == goal.pred]
    if len(own) != 2 or len(goal.args) != 2 or isinstance(goal.args[0], Var) == isinstance(goal.args[1], Var):
        return None
    own.sort(key=lambda r: len(r.body))
    base, step = own
    if len(base.body) != 1 or len(step.body) != 2 or not all(isinstance(b, Atom) and not b.negated and not b.reverse and len(b.args) == 2 for r in own for b in r.body):
        return None
    b, (x, y) = base.body[0], base.head.args
    h, (p, q) = step.head.args, step.body
    chain = p.args[0] == h[0] and p.args[1] == q.args[0] and q.args[1] == h[1] and len({*h, p.args[1]}) == 3
    if b.args != (x, y) or x == y or not chain or {p.pred, q.pred} != {goal.pred, b.pred}:
        return None
    return b.pred, "in" if isinstance(goal.args[0], Var) else "out"


def run(text: str, catalog: GraphCatalog, params: Mapping[str, Any] | None = None, include_seed: bool = True) -> DataFrame:
    """Rows of the last goal, a column for each of its variables; without a goal, those of the last rule's head.

    Where the goal is a recursive predicate with one end given, the given node is in
    the answer too (``include_seed``).
    """
    rules, goals = parse(text)
    for name, values in (params or {}).items():
        rows = values if isinstance(values, list | tuple) else [values]
        rules += [Rule(Atom(name, tuple(v) if isinstance(v, list | tuple) else (v,)), ()) for v in rows]
    if not goals:
        if not rules:
            raise DatalogError("nothing to answer")
        last = next((r.head for r in reversed(rules) if r.body), rules[-1].head)
        goals = [Atom(last.pred, tuple(a if isinstance(a, Var) else Var(f"V{i}") for i, a in enumerate(last.args)))]
    goal = goals[-1]
    strata(rules)
    plain = _closure_of(rules, goal)
    recursive = any(isinstance(b, Atom) and b.pred == r.head.pred for r in rules if r.head.pred == goal.pred for b in r.body)
    given = [a for a in goal.args if not isinstance(a, Var)]
    if plain and plain[0] in catalog.relations:
        seed = catalog.spark.createDataFrame([(given[0],)], ["node"])
        name = next(a.name for a in goal.args if isinstance(a, Var))
        return closure(seed, catalog.relation(plain[0]).edges, plain[1], 1000, include_seed, (catalog.relation(plain[0]).multiplicity or 9) <= 1).select(F.col("node").alias(name))
    ev = Evaluator(catalog, rules)
    ev.solve()
    out = ev.bind(goal, ev.base(goal)).distinct()
    if include_seed and recursive and len(given) == 1 and len(out.columns) == 1:
        out = out.unionByName(catalog.spark.createDataFrame([(given[0],)], out.schema)).distinct()
    return out
