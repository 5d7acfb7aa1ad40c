"""Triangles by groups of nodes, with groups and steps so small that all borders are crossed."""

import itertools
import random

import pytest

from meshwalk.operators import algorithms as G
from meshwalk.operators import closing


def near(pairs):
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


@pytest.mark.parametrize("kind,of", [("long", lambda x: x * 10_000_000_019 - 7 * 10**10), ("int", lambda x: x - 20), ("string", lambda x: f"n{x:03}")])
@pytest.mark.parametrize("broadcast", [closing.BROADCAST_ROWS, 0])
def test_triangles_of_a_hub_and_far_ids(spark, monkeypatch, kind, of, broadcast):
    monkeypatch.setattr(closing, "GROUP_EDGES", 37)
    monkeypatch.setattr(closing, "BROADCAST_ROWS", broadcast)
    rng = random.Random(4)
    e = [(of(rng.randrange(45)), of(rng.randrange(45))) for _ in range(260)] + [(of(0), of(i)) for i in range(45)]
    n = near(e)
    want = {t for t in itertools.combinations(sorted(n), 3) if t[1] in n[t[0]] and t[2] in n[t[0]] and t[2] in n[t[1]]}
    got = [tuple(r) for r in G.triangles(spark.createDataFrame(e, f"src {kind}, dst {kind}")).collect()]
    assert len(got) == len(want) > 50 and set(got) == want
    assert dict(G.triangles(spark.createDataFrame(e, f"src {kind}, dst {kind}")).dtypes)["a"] == {"long": "bigint"}.get(kind, kind)


def test_groups_in_small_steps(monkeypatch):
    import numpy as np

    monkeypatch.setattr(closing, "STEP", 3)
    whole = closing.Group(np.array([5, 9]), np.array([3, 2]), np.array([9, 11, 12, 11, 12]))
    found = [tuple(map(int, t)) for part in whole.closed(np.array([9, 11]), np.array([2, 1]), np.array([11, 12, 12])) for t in zip(*part)]
    assert sorted(found) == [(5, 9, 11), (5, 9, 12), (5, 11, 12), (9, 11, 12)]


def test_paths_are_not_shuffled(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    plan = G.triangles(e)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan.splitlines()[1] or "MapInArrow" in plan.splitlines()[0]
    assert G.triangles(e.limit(0)).count() == 0


def test_triangles_are_counted_where_they_are_found(spark, monkeypatch):
    monkeypatch.setattr(closing, "GROUP_EDGES", 37)
    rng = random.Random(9)
    e = [(rng.randrange(40) * 10**12 - 7, rng.randrange(40) * 10**12 - 7) for _ in range(230)]
    n = near(e)
    want = [t for t in itertools.combinations(sorted(n), 3) if t[1] in n[t[0]] and t[2] in n[t[0]] and t[2] in n[t[1]]]
    edges = spark.createDataFrame(e, "src long, dst long")
    counts = G.triangle_counts(edges)
    assert {r["node"]: r["triangles"] for r in counts.collect()} == {x: k for x in n if (k := sum(x in t for t in want))} and len(want) > 50
    motifs = G.motifs3(edges)
    assert [tuple(r) for r in motifs.collect()] == [(sum(len(x) * (len(x) - 1) // 2 for x in n.values()) - 3 * len(want), len(want))]
    for found in (counts, motifs):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "close_counted" in plan and "Generate explode(array(a" not in plan  # no row for a triangle
    assert G.triangle_counts(edges.limit(0)).count() == 0 and [tuple(r) for r in G.motifs3(edges.limit(0)).collect()] == [(0, 0)]
