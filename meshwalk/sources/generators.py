"""Synthetic graphs, made in parallel from row numbers and hashes: the same arguments, the same graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / float(1 << 40)


def _below(n: int, *keys: Column) -> Column:
    return F.floor(unit(*keys) * n).cast("long")


def graph500(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = 0, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> DataFrame:
    """Recursive-matrix edges over 2 ** scale nodes; parallel edges and loops stay."""
    e = spark.range((1 << scale) * edge_factor)
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in range(scale):
        u = unit(F.col("id"), F.lit(level), F.lit(seed))
        src = src + F.when(u >= a + b, F.lit(1 << level)).otherwise(0)
        dst = dst + F.when(((u >= a) & (u < a + b)) | (u >= a + b + c), F.lit(1 << level)).otherwise(0)
    return e.select(src.alias("src"), dst.alias("dst"))


def erdos_renyi(spark: SparkSession, nodes: int, edges: int, seed: int = 0) -> DataFrame:
    """So many draws of a pair; repeats and loops go."""
    e = spark.range(edges).select(_below(nodes, F.col("id"), F.lit(seed), F.lit(1)).alias("src"), _below(nodes, F.col("id"), F.lit(seed), F.lit(2)).alias("dst"))
    return e.where("src <> dst").distinct()


def stochastic_block(spark: SparkSession, sizes: list[int], inside: float, between: float, seed: int = 0) -> DataFrame:
    """Directed pairs drawn by the blocks of their ends. Each block pair draws its expected number of edges, so no pair is listed."""
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    out = None
    for i, n in enumerate(sizes):
        for j, m in enumerate(sizes):
            draws = round(n * m * (inside if i == j else between))
            e = spark.range(draws).select(
                (_below(n, F.col("id"), F.lit(seed), F.lit(i), F.lit(j), F.lit(1)) + starts[i]).alias("src"),
                (_below(m, F.col("id"), F.lit(seed), F.lit(i), F.lit(j), F.lit(2)) + starts[j]).alias("dst"))
            out = e if out is None else out.unionByName(e)
    return out.where("src <> dst").distinct()


def grid(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """Right and down edges of a grid numbered row by row."""
    n = spark.range(rows * columns)
    right = n.where(F.col("id") % columns < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = n.where(F.col("id") < (rows - 1) * columns).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    return right.unionByName(down)


def tree(spark: SparkSession, nodes: int, branching: int) -> DataFrame:
    """Parent to child edges of a complete tree."""
    return spark.range(1, nodes).select(F.floor((F.col("id") - 1) / branching).cast("long").alias("src"), F.col("id").alias("dst"))


def bipartite(spark: SparkSession, left: int, right: int, edges: int, seed: int = 0) -> DataFrame:
    """Edges from 0..left-1 to 0..right-1 of another domain."""
    e = spark.range(edges).select(_below(left, F.col("id"), F.lit(seed), F.lit(1)).alias("src"), _below(right, F.col("id"), F.lit(seed), F.lit(2)).alias("dst"))
    return e.distinct()


def barabasi_albert(spark: SparkSession, nodes: int, m: int, seed: int = 0, rounds: int = 64) -> DataFrame:
    """Preferential attachment by the copy model: edge k of node v takes the end of a random
    earlier edge slot, or its node; chains of copies are followed in parallel rounds."""
    slots = spark.range(m, nodes).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("k"))
    slots = slots.select("v", ((F.col("v") - m) * m + F.col("k")).alias("slot"))
    slots = slots.withColumn("pick", F.floor(unit(F.col("slot"), F.lit(seed)) * (2 * (F.col("v") - m) * m + m)).cast("long"))
    # Below m: one of the first nodes. Then even: the source of an earlier slot; odd: its end.
    parts = slots.select("slot", "v", F.when(F.col("pick") < m, F.col("pick")).when((F.col("pick") - m) % 2 == 0, F.floor((F.col("pick") - m) / 2 / m).cast("long") + m).alias("dst"), F.when((F.col("pick") >= m) & ((F.col("pick") - m) % 2 == 1), F.floor((F.col("pick") - m) / 2).cast("long")).alias("copy"))
    from meshwalk.plans.durable import cut

    state = cut(parts)
    for _ in range(rounds):
        if state.where("dst IS NULL").isEmpty():
            break
        known = state.select(F.col("slot").alias("copy"), F.col("dst").alias("_d"), F.col("copy").alias("_c"))
        state = cut(state.join(known, "copy", "left").select("slot", "v", F.coalesce("dst", "_d").alias("dst"), F.when(F.col("dst").isNull(), F.when(F.col("_d").isNull(), F.col("_c"))).alias("copy")))
    return state.select(F.col("v").alias("src"), "dst").where("src <> dst").distinct()
