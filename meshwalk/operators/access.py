"""Relationship-based access: who reaches what through groups, less what is denied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.plans.durable import cut

from .lanes import lane_closure, lane_hop

#: Counted tables of at most so many rows of two numbers (64 MB) are broadcast.
BROADCAST_ROWS = 1_000_000


def permitted(users: DataFrame, member_of: DataFrame, parents: DataFrame | None, grants: DataFrame, denied: DataFrame | None = None, max_hops: int = 1024) -> DataFrame:
    """(user, resource): resources granted to any group that the user is in, directly or
    through parent groups, without pairs reached the same way by denials.

    All relations are (src, dst): user to group, group to parent, group to resource;
    users with the same groups are one class: pairs are made and denied once for each class, and
    the join that deals them out to the users comes last, without a shuffle of the pairs.
    """
    lanes = lane_hop(users.select(F.col("node").alias("lane"), "node"), member_of)
    if parents is not None:
        lanes = lane_closure(lanes, parents, "out", max_hops)
    # The groups of one user are a short list; its text is the class, so none are mixed up.
    member = cut(lanes.groupBy("lane").agg(F.collect_set("node").alias("_groups")).select("lane", F.to_json(F.sort_array("_groups")).alias("_class"), "_groups"))
    named = member.groupBy("_class").agg(F.first("_groups").alias("_groups"))
    named = cut(named.select(F.col("_class"), F.monotonically_increasing_id().alias("lane"), "_groups"))
    classes = named.select("lane", F.explode("_groups").alias("node"))
    allowed = lane_hop(classes, grants)
    if denied is not None:
        allowed = allowed.join(lane_hop(classes, denied), ["lane", "node"], "left_anti")
    allowed = cut(allowed.select(F.col("lane").alias("_id"), F.col("node").alias("resource")))
    names, rows = named.select("_class", F.col("lane").alias("_id")), allowed.count()
    names = F.broadcast(names) if named.count() <= BROADCAST_ROWS else names
    users = cut(member.select(F.col("lane").alias("user"), "_class").join(names, "_class").select("user", "_id"), [member])
    # Rows of many pairs each are dealt over all cores.
    users = users.repartition(4 * users.sparkSession.sparkContext.defaultParallelism) if rows <= BROADCAST_ROWS else users
    return users.join(F.broadcast(allowed) if rows <= BROADCAST_ROWS else allowed, "_id").select("user", "resource")


def check(users: DataFrame, resource, *relations: DataFrame | None) -> DataFrame:
    """The users (node) that may use one resource."""
    return permitted(users, *relations).where(F.col("resource") == resource).select(F.col("user").alias("node"))
