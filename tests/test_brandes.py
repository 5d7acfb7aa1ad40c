"""Betweenness by arrays, with runs, lanes and steps so small that all borders are crossed."""

import random

import pytest

from meshwalk.operators import algorithms as G
from meshwalk.operators import brandes


def test_arrays_and_joins_give_the_same_scores(spark, monkeypatch):
    for name, n in (("WIDTH", 3), ("LANES", 4), ("NUMBERS", 70)):
        monkeypatch.setattr(brandes, name, n)
    rng = random.Random(8)
    of = lambda x: x * 10**12 - 5
    e = [(of(rng.randrange(30) + at), of(rng.randrange(30) + at)) for at in (0, 100) for _ in range(70)] + [(of(0), of(i)) for i in range(25)] + [(of(i), of(i + 1)) for i in range(29, 40)]
    edges = spark.createDataFrame(e + e[:9], "src long, dst long")
    sources = spark.createDataFrame([(of(x),) for x in (*range(20), *range(100, 112), 999)] + [(None,)], "node long")
    by = {}
    for step in (1, 7, 4_000_000):
        monkeypatch.setattr(brandes, "STEP", step)
        by[step] = {r["node"]: r["score"] for r in G.betweenness(edges, sources, 4).collect()}
    monkeypatch.setattr(G, "ARRAY_LINKS", 0)
    slow = {r["node"]: r["score"] for r in G.betweenness(edges, sources, 4).collect()}
    assert all(x == pytest.approx(slow) for x in by.values()) and max(slow.values()) > 5


def test_parts_arrays_and_blocks_give_what_one_array_gives(spark, monkeypatch):
    rng = random.Random(3)
    e = [(at + rng.randrange(12), at + rng.randrange(12)) for at in (0, 100, 200, 300) for _ in range(25)] + [(100 + i, 101 + i) for i in range(20)]
    edges = spark.createDataFrame([x for x in e if x[0] != x[1]], "src long, dst long")
    sources = spark.createDataFrame([(x,) for x in (0, 1, 2, 101, 102, 103, 104, 301, 302, 7777)], "node long")
    ways = edges.unionByName(edges.selectExpr("dst AS src", "src AS dst"))
    one = {both: {r["node"]: r["score"] for r in G.betweenness(e, sources).collect()} for both, e in ((False, edges), (True, ways))}
    used = []
    for f in ("_in_array", "_in_blocks"):
        monkeypatch.setattr(brandes, f, lambda *a, f=f, go=getattr(brandes, f): used.append(f) or go(*a))
    monkeypatch.setattr(brandes, "PART", 30)
    monkeypatch.setattr(G, "ARRAY_LINKS", 40)
    monkeypatch.setattr(G, "nodes_of", None)  # the joins are not taken
    for both in (False, True):
        found = {r["node"]: r["score"] for r in G.betweenness(edges, sources, both=both).collect()}
        assert found == pytest.approx(one[both]) and max(found.values()) > 5
    assert set(used) == {"_in_array", "_in_blocks"} and used.count("_in_array") >= 2


def test_no_links_and_links_in_one_array(spark, monkeypatch):
    monkeypatch.setattr(G, "nodes_of", None)  # the joins are not taken
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    found = G.betweenness(e, e.select(e["src"].alias("node")))
    assert dict(found.dtypes)["node"] == "int" and {tuple(r) for r in found.collect()} == {(1, 0.0), (2, 2.0), (3, 2.0), (4, 0.0)}
    assert G.betweenness(e.limit(0), e.select(e["src"].alias("node"))).count() == 0
