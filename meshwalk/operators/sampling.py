"""Neighbour samples and random walks, seeded by hashes so that reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwalk.plans.durable import cut


def sample_neighbors(frontier: DataFrame, edges: DataFrame, k: int, seed: int = 0, replace: bool = False) -> DataFrame:
    """(src, dst[, draw]): up to k neighbours of each node; k < 0 means all.

    Without replacement the k smallest hashes win. With replacement there are k draws
    when a node has more than k neighbours, each the smallest hash of its own seed.
    """
    links = frontier.select(F.col("node").alias("src")).distinct().join(edges.select("src", "dst").distinct(), "src")
    if k < 0:
        return links
    if not replace:
        by = Window.partitionBy("src").orderBy(F.xxhash64("src", "dst", F.lit(seed)), "dst")
        return links.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k).drop("_r")
    degree = links.groupBy("src").agg(F.count("*").alias("_d"))
    few = links.join(degree.where(F.col("_d") <= k), "src", "left_semi").withColumn("draw", F.lit(0))
    many = links.join(degree.where(F.col("_d") > k), "src", "left_semi").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    drawn = many.groupBy("src", "draw").agg(F.min(F.struct(F.xxhash64("src", "dst", "draw", F.lit(seed)).alias("h"), "dst")).alias("b"))
    return few.unionByName(drawn.select("src", F.col("b.dst").alias("dst"), "draw"))


def random_walks(seeds: DataFrame, edges: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """(start, step, node) with step 0 at the seeds; a walk ends where there is no edge."""
    links = cut(edges.select("src", "dst").distinct())
    at = cut(seeds.select(F.col("node").alias("start"), "node").distinct())
    out = at.select("start", F.lit(0).alias("step"), "node")
    for step in range(1, steps + 1):
        pick = F.min(F.struct(F.xxhash64("start", "node", "dst", F.lit(seed), F.lit(step)).alias("h"), "dst"))
        at = cut(at.join(links, F.col("node") == F.col("src")).groupBy("start", "node").agg(pick.alias("b")).select("start", F.col("b.dst").alias("node")))
        out = out.unionByName(at.select("start", F.lit(step).alias("step"), "node"))
    return out
