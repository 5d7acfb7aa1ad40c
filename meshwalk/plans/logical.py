"""The logical plan that every front end lowers to, and its rewrites."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Plan:
    """A set of nodes of one domain."""


@dataclass(frozen=True)
class Seed(Plan):
    domain: str
    ids: tuple | None = None  # None: all nodes


@dataclass(frozen=True)
class Frame(Plan):
    """A frontier that is a DataFrame already, with column ``node``."""

    domain: str
    df: Any


@dataclass(frozen=True)
class Hop(Plan):
    child: Plan
    relations: tuple[str, ...]
    direction: str = "out"  # out, in or both
    edge_cel: str | None = None
    distinct: bool = True


@dataclass(frozen=True)
class Filter(Plan):
    child: Plan
    cel: str


@dataclass(frozen=True)
class Within(Plan):
    """Nodes that are (or, negated, aren't) in another set."""

    child: Plan
    other: Plan
    negated: bool = False


@dataclass(frozen=True)
class Union(Plan):
    left: Plan
    right: Plan


@dataclass(frozen=True)
class Repeat(Plan):
    child: Plan
    relation: str
    times: int
    direction: str = "out"


@dataclass(frozen=True)
class Fixpoint(Plan):
    """All nodes reached over any number of hops, the seeds included unless min_hops is 1."""

    child: Plan
    relations: tuple[str, ...]
    max_hops: int = 1024
    direction: str = "out"
    min_hops: int = 0


@dataclass(frozen=True)
class ValidAt(Plan):
    """Nodes whose [start, end) holds the instant; a missing bound is open."""

    child: Plan
    millis: int
    start: str
    end: str


@dataclass(frozen=True)
class KCore(Plan):
    child: Plan
    relation: str
    k: int


@dataclass(frozen=True)
class Sample(Plan):
    """Up to k neighbours of each node."""

    child: Plan
    relation: str
    k: int
    seed: int = 0


@dataclass(frozen=True)
class Walk(Plan):
    """Where random walks of so many steps end."""

    child: Plan
    relation: str
    steps: int
    seed: int = 0


FUSE_LIMIT = 2.0


def rewrite(plan: Plan, multiplicity: Callable[[str], float | None]) -> Plan:
    """Merge neighbouring filters; drop the distinct between two forward hops of low multiplicity; unnest repeats."""
    kids = {k: rewrite(v, multiplicity) for k, v in vars(plan).items() if isinstance(v, Plan)}
    plan = replace(plan, **kids) if kids else plan
    if isinstance(plan, Filter) and isinstance(plan.child, Filter):
        return Filter(plan.child.child, f"({plan.child.cel}) && ({plan.cel})")
    if isinstance(plan, Repeat):
        out = plan.child
        for _ in range(plan.times):
            out = Hop(out, (plan.relation,), plan.direction)
        return out
    if isinstance(plan, Hop) and isinstance(plan.child, Hop):
        first = plan.child
        plain = all(h.direction == "out" and h.edge_cel is None and len(h.relations) == 1 for h in (plan, first))
        low = plain and all((m := multiplicity(h.relations[0])) is not None and m <= FUSE_LIMIT for h in (plan, first))
        if low:
            return replace(plan, child=replace(first, distinct=False))
    return plan


def depth(plan: Plan) -> int:
    return 1 + max((depth(v) for v in vars(plan).values() if isinstance(v, Plan)), default=0)
