"""The index of cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwalk.operators import vector_index as I

KIND = "vec_id long, embedding array<double>"


def scores(x, q, metric):
    if metric == "dot":
        return x @ q
    if metric == "l2":
        return -((x - q) ** 2).sum(axis=1)
    if metric == "hamming":
        return -((x > 0) != (q > 0)).sum(axis=1).astype(float)
    return x @ q / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(q), 1e-12)


def brute(x, q, metric, k):
    s = scores(x, q, metric)
    return sorted(range(len(x)), key=lambda i: (-s[i], i))[:k]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    return rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 2 + rng.normal(size=(3000, 16))


@pytest.fixture(scope="module")
def table(spark, points):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(points)], KIND).cache()


@pytest.mark.parametrize("metric", I.METRICS)
def test_recall_and_scores(table, points, metric):
    cells = I.fit(table, metric)
    found = I.search(I.build(table, cells), table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 10).collect()
    got = {}
    for r in found:
        got.setdefault(r["query"], {})[r["node"]] = r["score"]
    asked = range(0, len(points), 20)
    assert set(got) == set(asked) and all(len(v) == 10 for v in got.values())
    worst = {q: sorted(scores(points, points[q], metric))[-10] for q in asked}
    # By score, as many rows may tie for the last place.
    assert np.mean([[s >= worst[q] - 1e-9 for s in got[q].values()] for q in asked]) >= 0.9
    for q in list(asked)[:20]:
        assert np.allclose(list(got[q].values()), scores(points[list(got[q])], points[q], metric))


def test_all_cells_give_the_exact_answer(table, points):
    index = I.build(table, I.fit(table, "l2", cells=30))
    ask = table.where("vec_id IN (7, 8, 2999)").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = I.search(index, ask, 10, probes=30).orderBy("query", "rank").collect()
    for q in (7, 8, 2999):
        assert [r["node"] for r in found if r["query"] == q] == brute(points, points[q], "l2", 10)


def test_every_row_is_in_a_tile(table):
    index = I.build(table, I.fit(table, fit_rows=200))
    nodes = index.tiles.select(F.explode("nodes").alias("n"))
    assert len(index.cells.centres) == 25 and nodes.count() == nodes.distinct().count() == 3000


def test_equal_rows_tie_by_id(spark):
    t = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)], KIND)
    index = I.build(t, I.fit(t))
    found = I.search(index, spark.createDataFrame([(1, [2.0, 0.0])], "query long, vector array<double>"), 5)
    assert [(r["node"], r["rank"]) for r in found.orderBy("rank").collect()] == [(i, i + 1) for i in range(5)]


def test_odd_rows(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0])], KIND)
    for metric in I.METRICS:
        index = I.build(t, I.fit(t, metric))
        ask = spark.createDataFrame([("a", [1.0, 0.5]), ("b", None), ("c", [1.0]), ("d", [0.0, 0.0])], "query string, vector array<double>")
        assert {(r["query"], r["node"]) for r in I.search(index, ask, 9).collect()} == {("a", 1), ("a", 5), ("d", 1), ("d", 5)}
    none = t.limit(0)
    assert I.search(I.build(none, I.fit(none)), ask, 3).collect() == []
    with pytest.raises(ValueError):
        I.fit(t, "other")


def test_settings_stay(spark, table):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    I.search(I.build(table, I.fit(table)), table.limit(3).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 3).count()
    assert spark.conf.get(name) == before


def test_codes():
    x = np.random.default_rng(1).normal(size=(50, 8))
    x[0] = 0
    codes, step = I.scalar_codes(x)
    assert np.abs(codes * step[:, None] - x).max() <= step.max() / 2 + 1e-6
    assert ((np.unpackbits(I.sign_codes(x), axis=1) == 1) == (x > 0)).all()
