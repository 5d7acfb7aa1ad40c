"""Semiring products, element-wise operations, masks and vector arithmetic.

A vector is a DataFrame (node, value), a matrix one of (src, dst[, weight]), a set
one of (node). Rows that a product doesn't reach have the semiring's empty value
when the node universe is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwalk.functions import math_catalog as M

#: name -> (aggregate over x and w, value of an empty row)
SEMIRINGS = {
    "plus_times": (lambda x, w: F.sum(x), 0.0),
    "plus_times_weighted": (lambda x, w: F.sum(x * w), 0.0),
    "min_plus": (lambda x, w: F.min(x + w), float("inf")),
    "max_min": (lambda x, w: F.max(F.least(x, F.lit(1.0))), 0.0),
    "bool": (lambda x, w: F.max((x != 0).cast("double")), 0.0),
}


def value() -> Column:
    return F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))


def _product(matrix: DataFrame, x: DataFrame, near: str, far: str, semiring: str, weight: str | None, mask: DataFrame | None, universe: DataFrame | None) -> DataFrame:
    if semiring not in SEMIRINGS:
        raise ValueError(f"unknown semiring {semiring}")
    add, empty = SEMIRINGS[semiring]
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    edges = matrix.select(F.col(far).alias("_far"), F.col(near).alias("_near"), w.alias("_w"))
    met = edges.join(x.select(F.col("node").alias("_far"), value().alias("_x")), "_far")
    out = met.groupBy(F.col("_near").alias("node")).agg(add(F.col("_x"), F.col("_w")).alias("value"))
    if mask is not None:
        out = out.join(mask.select("node").distinct(), "node", "left_semi")
    if universe is None:
        return out
    full = universe.select("node").distinct().join(out, "node", "left")
    held = F.coalesce("value", F.lit(empty))
    if mask is not None:  # what the mask leaves out is 0
        full = full.join(mask.select("node").distinct().withColumn("_in", F.lit(True)), "node", "left")
        held = F.when(F.col("_in"), held).otherwise(0.0)
    return full.select("node", held.alias("value"))


def mxv(matrix: DataFrame, x: DataFrame, semiring: str = "plus_times", weight: str | None = None, mask: DataFrame | None = None, universe: DataFrame | None = None) -> DataFrame:
    """y[u] = sum over out-neighbours v of A[u, v] * x[v] in the semiring."""
    return _product(matrix, x, "src", "dst", semiring, weight, mask, universe)


def vxm(matrix: DataFrame, x: DataFrame, semiring: str = "plus_times", weight: str | None = None, mask: DataFrame | None = None, universe: DataFrame | None = None) -> DataFrame:
    """y[v] = sum over in-neighbours u of x[u] * A[u, v] in the semiring."""
    return _product(matrix, x, "dst", "src", semiring, weight, mask, universe)


_EWISE = {"ADD": lambda a, b: a + b, "MUL": lambda a, b: a * b, "MIN": F.least, "MAX": F.greatest, "SUB": lambda a, b: a - b, "DIV": F.try_divide}


def ewise(a: DataFrame, b: DataFrame, op: str = "ADD", outer: bool = False) -> DataFrame:
    """Element by element, over nodes in both; ``outer`` takes nodes of either, the other side counting as absent."""
    x, y = a.select("node", value().alias("_a")), b.select("node", value().alias("_b"))
    f = _EWISE[op.upper()]
    if not outer:
        return x.join(y, "node").select("node", f(F.col("_a"), F.col("_b")).alias("value"))
    both = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(f(F.col("_a"), F.col("_b")))
    return x.join(y, "node", "full").select("node", both.alias("value"))


def compare(vec: DataFrame, op: str, other: DataFrame | float, high: float | None = None) -> DataFrame:
    """Nodes where the vector compares with a number or another vector: EQ, GT, LT or BETWEEN."""
    x = value()
    if op == "BETWEEN":
        return vec.where(x.between(other, high)).select("node")
    test = {"EQ": lambda a, b: a == b, "GT": lambda a, b: a > b, "LT": lambda a, b: a < b}[op]
    if isinstance(other, DataFrame):
        met = vec.select("node", x.alias("_a")).join(other.select("node", value().alias("_b")), "node")
        return met.where(test(F.col("_a"), F.col("_b"))).select("node")
    return vec.where(test(x, F.lit(other))).select("node")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node").unionByName(b.select("node")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node").distinct().join(b.select("node"), "node", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node").distinct().join(b.select("node"), "node", "left_anti")


def complement(universe: DataFrame, a: DataFrame) -> DataFrame:
    return difference(universe, a)


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    """The convergence test of a loop."""
    return difference(a, b).isEmpty()


def blend(mask: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """a where the node is in the mask, else b."""
    m = mask.select("node").distinct().withColumn("_m", F.lit(True))
    met = a.select("node", value().alias("_a")).join(b.select("node", value().alias("_b")), "node", "full").join(m, "node", "left")
    return met.select("node", F.when(F.col("_m"), F.col("_a")).otherwise(F.col("_b")).alias("value"))


def unary(vec: DataFrame, name: str, bits: int = 64) -> DataFrame:
    return vec.select("node", M.apply(name, F.col("value"), bits=bits).cast("double").alias("value"))


def binary(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    met = a.select("node", F.col("value").alias("_a")).join(b.select("node", F.col("value").alias("_b")), "node")
    return met.select("node", M.apply(name, F.col("_a"), F.col("_b")).alias("value"))


def ternary(a: DataFrame, b: DataFrame, c: DataFrame, name: str) -> DataFrame:
    met = a.select("node", F.col("value").alias("_a")).join(b.select("node", F.col("value").alias("_b")), "node").join(c.select("node", F.col("value").alias("_c")), "node")
    return met.select("node", M.apply(name, F.col("_a"), F.col("_b"), F.col("_c")).alias("value"))


def scale(vec: DataFrame, factor: float) -> DataFrame:
    return vec.select("node", (value() * factor).alias("value"))


def coalesce(a: DataFrame, b: DataFrame | float) -> DataFrame:
    """a, or where it is missing the fallback."""
    if not isinstance(b, DataFrame):
        return a.select("node", F.coalesce(value(), F.lit(float(b))).alias("value"))
    met = a.select("node", value().alias("_a")).join(b.select("node", value().alias("_b")), "node", "left")
    return met.select("node", F.coalesce("_a", "_b").alias("value"))


def valid(vec: DataFrame) -> DataFrame:
    return vec.where(value().isNotNull()).select("node")


def assert_finite(vec: DataFrame) -> DataFrame:
    """The vector, whose evaluation fails at a NaN or an infinity, naming the node."""
    x = F.col("value").cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.select("node", F.when(bad, F.raise_error(F.concat(F.lit("not finite at node "), F.col("node").cast("string")))).otherwise(x).alias("value"))


def concat_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two string vectors end to end: (ordinal, value). Each has a dense ordinal from 0."""
    n = a.agg(F.count("*").alias("_n"))
    return a.select("ordinal", "value").unionByName(b.join(F.broadcast(n)).select((F.col("ordinal") + F.col("_n")).alias("ordinal"), "value"))


def l1_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of absolute differences; a node that one side lacks counts as 0 there."""
    met = a.select("node", value().alias("_a")).join(b.select("node", value().alias("_b")), "node", "full")
    return met.agg(F.coalesce(F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))), F.lit(0.0)).alias("result"))


def walk_reduce(edges: DataFrame, x: DataFrame, how: str = "MIN") -> DataFrame:
    """Push source values to targets: MIN, MAX, SUM, COUNT, or LAST by source id."""
    met = edges.select("src", "dst").join(x.select(F.col("node").alias("src"), value().alias("_x")), "src")
    agg = {"MIN": F.min("_x"), "MAX": F.max("_x"), "SUM": F.sum("_x"), "COUNT": F.count("*").cast("double"), "LAST": F.max_by("_x", "src")}[how.upper()]
    return met.groupBy(F.col("dst").alias("node")).agg(agg.alias("value"))


def scatter_reduce(old: DataFrame, new: DataFrame, how: str = "SUM") -> DataFrame:
    """Reduce (node, value) contributions into an existing vector."""
    agg = {"SUM": F.sum, "MAX": F.max, "MIN": F.min}[how.upper()]
    return old.select("node", value().alias("value")).unionByName(new.select("node", value().alias("value"))).groupBy("node").agg(agg("value").alias("value"))


def edge_weight(edges: DataFrame, u, v, weight: str) -> DataFrame:
    """The weight of edge (u, v), of the first in attribute order where it is parallel."""
    return edges.where((F.col("src") == u) & (F.col("dst") == v)).agg(F.min(weight).alias("weight"))


def adjacent(edges: DataFrame, u, v) -> bool:
    """Whether the edge (u, v) exists."""
    return not edges.where((F.col("src") == u) & (F.col("dst") == v)).isEmpty()


def scatter_gather(edges: DataFrame, features: DataFrame, how: str = "avg") -> DataFrame:
    """(node, value): element by element, the sum, mean or maximum of the in-neighbours' feature arrays.

    ``features`` is (node, value array). Sums combine before the shuffle.
    """
    agg = {"sum": F.sum, "avg": F.avg, "max": F.max}[how]
    each = edges.select("src", "dst").join(features.select(F.col("node").alias("src"), F.posexplode("value").alias("i", "x")), "src")
    by = each.groupBy(F.col("dst").alias("node"), "i").agg(agg(F.col("x").cast("double")).alias("x"))
    rows = by.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return rows.select("node", F.transform("v", lambda p: p["x"]).alias("value"))
