"""Loops against plain Python on small random graphs."""

import itertools
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from meshwalk.operators import algorithms as G
from meshwalk.operators import sampling as S
from meshwalk.operators import vectors as V
from meshwalk.operators.components import connected_components
from meshwalk.plans.compiler import closure


def graph(seed, n=25, m=50):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def frame(spark, edges, weight=False):
    return spark.createDataFrame([(a, b, float((a * 7 + b * 3) % 11 + 1)) for a, b in edges] if weight else list(edges), "src long, dst long, weight double" if weight else "src long, dst long")


def neighbours(edges, both=False):
    out = defaultdict(set)
    for a, b in edges:
        if both and a != b:
            out[b].add(a)
        if not both or a != b:
            out[a].add(b)
    return out


def levels(edges, seed):
    n, d, q = neighbours(edges), {seed: 0}, deque([seed])
    while q:
        x = q.popleft()
        for y in n[x]:
            if y not in d:
                d[y] = d[x] + 1
                q.append(y)
    return d


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    e = graph(seed, 60, 45)
    parent = {x: x for p in e for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert {r["node"]: r["component"] for r in connected_components(frame(spark, e)).collect()} == {x: find(x) for x in parent}


def test_components_of_a_long_chain_and_nothing(spark):
    chain = [(i, i + 1) for i in range(300)]
    random.Random(1).shuffle(chain)
    assert {r["component"] for r in connected_components(frame(spark, chain)).collect()} == {0}
    assert connected_components(frame(spark, chain).limit(0)).count() == 0


def test_bfs_and_closure(spark):
    e = graph(3)
    want = levels(e, 0)
    seed = spark.createDataFrame([(0,)], "node long")
    assert {r["node"]: r["level"] for r in G.bfs_levels(frame(spark, e), seed).collect()} == want
    assert {r["node"] for r in closure(seed, frame(spark, e)).collect()} == set(want)
    ring = frame(spark, [(i, (i + 1) % 9) for i in range(9)])
    assert closure(seed, ring, functional=True).count() == 9


def test_shortest_paths(spark):
    e = graph(4)
    w = {(a, b): float((a * 7 + b * 3) % 11 + 1) for a, b in e}
    d = {0: 0.0}
    for _ in range(40):
        for (a, b), x in w.items():
            if a in d and d[a] + x < d.get(b, 1e9):
                d[b] = d[a] + x
    seed = spark.createDataFrame([(0,)], "node long")
    assert {r["node"]: r["distance"] for r in G.shortest_paths(frame(spark, e, True), seed).collect()} == d
    with pytest.raises(ValueError):
        G.shortest_paths(frame(spark, e, True).withColumn("weight", F.lit(-1.0)), seed)


def test_triangles_cores_trusses(spark):
    e = graph(5, 20, 90)
    n = neighbours(e, True)
    tri = {t for t in itertools.combinations(range(20), 3) if t[1] in n[t[0]] and t[2] in n[t[0]] and t[2] in n[t[1]]}
    assert {tuple(r) for r in G.triangles(frame(spark, e)).collect()} == tri
    core, left, k = {}, {x: set(y) for x, y in n.items() if y}, 0
    while left:
        x = min(left, key=lambda v: len(left[v]))
        k = max(k, len(left[x]))
        core[x] = k
        for y in left.pop(x):
            left[y].discard(x)
    assert {r["node"]: r["core"] for r in G.core_numbers(frame(spark, e)).collect()} == core
    pairs = {tuple(sorted(p)) for p in e if p[0] != p[1]}
    while True:
        near = neighbours(pairs, True)
        bad = {p for p in pairs if len(near[p[0]] & near[p[1]]) < 2}
        if not bad:
            break
        pairs -= bad
    assert {tuple(r) for r in G.k_truss(frame(spark, e), 4).collect()} == pairs


def test_betweenness(spark):
    e = graph(6, 15, 40)
    n, nodes, want = neighbours(e), sorted({x for p in e for x in p}), defaultdict(float)
    for s in nodes:
        dist, sigma, order, q = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for x in n[v]:
                if x not in dist:
                    dist[x] = dist[v] + 1
                    q.append(x)
                if dist[x] == dist[v] + 1:
                    sigma[x] += sigma[v]
        delta = defaultdict(float)
        for x in reversed(order):
            for v in nodes:
                if x in n[v] and v in dist and dist[x] == dist[v] + 1:
                    delta[v] += sigma[v] / sigma[x] * (1 + delta[x])
            if x != s:
                want[x] += delta[x]
    got = {r["node"]: r["score"] for r in G.betweenness(frame(spark, e), spark.createDataFrame([(x,) for x in nodes], "node long")).collect()}
    assert got == pytest.approx({x: want[x] for x in nodes})


def test_spanning_forest_has_least_weight(spark):
    e = graph(7)
    best = {}
    for a, b in e:
        if a != b:
            k = (min(a, b), max(a, b))
            best[k] = min(best.get(k, 99.0), float((a * 7 + b * 3) % 11 + 1))
    parent, total = {}, 0.0
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    count = 0
    for (a, b), w in sorted(best.items(), key=lambda x: (x[1], x[0])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total, count = total + w, count + 1
    rows = G.minimum_spanning_forest(frame(spark, e, True)).collect()
    assert len(rows) == count and sum(r["weight"] for r in rows) == total


def test_power_iterations(spark):
    import numpy as np

    e = graph(8)
    nodes = sorted({x for p in e for x in p})
    a = np.zeros((len(nodes), len(nodes)))
    for x, y in e:
        a[nodes.index(x), nodes.index(y)] = 1
    h = u = np.full(len(nodes), len(nodes) ** -0.5)
    v = h.copy()
    for _ in range(6):
        u = a.T @ h
        u = u / np.linalg.norm(u)
        h = a @ u
        h = h / np.linalg.norm(h)
        v = a.T @ v
        v = v / np.linalg.norm(v)
    got = {r["node"]: r for r in G.hits(frame(spark, e), max_iter=6).collect()}
    assert [got[x]["hub"] for x in nodes] == pytest.approx(list(h)) and [got[x]["authority"] for x in nodes] == pytest.approx(list(u))
    eig = {r["node"]: r["score"] for r in G.eigenvector(frame(spark, e), max_iter=6).collect()}
    assert [eig[x] for x in nodes] == pytest.approx(list(v))


def test_communities_beat_chance(spark):
    blocks = [(a + 10 * g, b + 10 * g) for g in range(3) for a in range(10) for b in range(10) if a < b] + [(9, 10), (19, 20)]
    e = frame(spark, blocks)
    label = G.communities(e, 12)
    assert G.modularity(e, label).first()[0] > 0.5


def test_order_of_a_dag_and_a_cycle(spark):
    e = [(a, b) for a, b in graph(9) if a < b]
    lev = {r["node"]: r["level"] for r in G.topological_levels(frame(spark, e)).collect()}
    assert all(lev[a] < lev[b] for a, b in e)
    with pytest.raises(ValueError):
        G.topological_levels(frame(spark, [(1, 2), (2, 1)]))


def test_islands_and_isomorphism(spark):
    ring = spark.createDataFrame([(i, i, (i + 1) % 4) for i in range(4)], "edge_id long, src long, dst long")
    assert {tuple(r) for r in G.island_pairs(ring, ring.select("edge_id")).collect()} == set(itertools.combinations(range(4), 2))
    a, b, c = frame(spark, [(0, 1), (1, 2)]), frame(spark, [(7, 5), (5, 9)]), frame(spark, [(0, 1), (0, 2)])
    assert G.isomorphic(a, b) and not G.isomorphic(a, c)


def test_samples_and_walks(spark):
    e = graph(10, 10, 60)
    f, n = frame(spark, e), neighbours(e)
    seeds = spark.createDataFrame([(x,) for x in range(10)], "node long")
    one = [tuple(r) for r in S.sample_neighbors(seeds, f, 2).collect()]
    assert sorted(one) == sorted(tuple(r) for r in S.sample_neighbors(seeds, f.repartition(7), 2).collect())
    assert all(d in n[s] for s, d in one) and all(sum(s == x for s, _ in one) == min(2, len(n[x])) for x in range(10))
    drawn = S.sample_neighbors(seeds, f, 3, replace=True).collect()
    assert all(sum(r["src"] == x for r in drawn) == (3 if len(n[x]) > 3 else len(n[x])) for x in range(10))
    walks = defaultdict(dict)
    for r in S.random_walks(seeds, f, 4).collect():
        walks[r["start"]][r["step"]] = r["node"]
    assert all(w[k + 1] in n[w[k]] for w in walks.values() for k in range(len(w) - 1))


def test_vector_quality(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(80)], "vec_id long, embedding array<double>")
    q = v.where("vec_id < 5").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    exact = V.batch_top_k(v, q, 5, block=2)
    assert exact.where("rank = 1 AND query <> node").isEmpty()
    assert list(V.quality(exact, exact, 5).first()) == pytest.approx([1.0] * 4)
    worse = exact.where("rank > 1").withColumn("rank", F.col("rank") - 1)
    r = V.quality(worse, exact, 5).first()
    assert r["recall_at_1"] == 0 and r["recall_at_k"] == pytest.approx(0.8) and r["mrr"] == 0
