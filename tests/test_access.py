"""Access by classes of users with the same groups."""

import random

from meshwalk.operators import access


def test_pairs_are_neither_shuffled_nor_made_twice(spark, monkeypatch):
    rng = random.Random(3)
    member = [(u, rng.randrange(6)) for u in range(40) for _ in range(3)] * 2
    grants = [(rng.randrange(6), 100 + rng.randrange(15)) for _ in range(30)] * 2
    denied = grants[:4]
    want = {(u, r) for u, g in member for h, r in grants if g == h} - {(u, r) for u, g in member for h, r in denied if g == h}
    args = [spark.createDataFrame(member, "src long, dst long"), None, spark.createDataFrame(grants, "src long, dst long"), spark.createDataFrame(denied, "src long, dst long")]
    users = spark.createDataFrame([(u,) for u in range(45)], "node long")
    for limit in (access.BROADCAST_ROWS, 0):
        monkeypatch.setattr(access, "BROADCAST_ROWS", limit)
        found = access.permitted(users, *args)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "Aggregate" not in plan  # a distinct of pairs shuffles them all
