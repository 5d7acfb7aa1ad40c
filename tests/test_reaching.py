"""Sizes of what lanes reach, with groups, steps and rounds so small that all borders are crossed."""

import random

import pytest

from meshwalk import registry
from meshwalk.operators import reaching


@pytest.mark.parametrize("far_apart", [3, 10**12])
def test_lanes_in_groups_and_rounds(spark, monkeypatch, far_apart):
    for name, n in (("GROUP_ROWS", 25), ("STEP", 9), ("ROUND", 40)):
        monkeypatch.setattr(reaching, name, n)
    rng = random.Random(2)
    near = [(rng.randrange(30) - 4, rng.randrange(25)) for _ in range(120)] + [(3, s) for s in range(25)]
    far = [(rng.randrange(22), rng.randrange(-20, 20) * far_apart) for _ in range(150)] + [(5, n * far_apart) for n in range(40)]
    want = {}
    for lane, stop in near:
        want.setdefault(lane, set()).update(n for s, n in far if s == stop)
    found = reaching.reach_sizes(spark.createDataFrame(near, "lane int, stop long"), spark.createDataFrame(far, "stop long, node long"))
    assert dict(found.dtypes) == {"lane": "int", "n": "bigint"}
    assert sorted(tuple(r) for r in found.collect()) == sorted((lane, len(n)) for lane, n in want.items() if n)


def test_nothing_is_reached(spark):
    e = spark.createDataFrame([(1, 2)], "lane long, stop long")
    assert reaching.reach_sizes(e, e.select("stop", e["lane"].alias("node")).where("stop > 2")).count() == 0
    assert reaching.reach_sizes(e.limit(0), e.select("stop", e["lane"].alias("node"))).count() == 0


def test_flagship_has_no_row_for_a_lane_and_a_node(spark):
    found = registry.QUERIES["flagship_all_seeds"](spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in found._jdf.queryExecution().sparkPlan().toString()
