"""Statistics of relations and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame, nodes: DataFrame, end: str = "src") -> DataFrame:
    """(node, degree) with zero for nodes without an edge."""
    d = edges.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("degree"))
    return nodes.select("node").distinct().join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def relation_statistics(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: counts, degree moments, the sorted[floor(n p)] percentiles, sparsity and multiplicity.

    Degrees are counted by value first, so percentiles need no sort of the nodes.
    """
    d = degrees(edges, sources)
    hist = d.groupBy("degree").agg(F.count("*").alias("k"))
    spread = hist.agg(F.array_sort(F.collect_list(F.struct("degree", "k"))).alias("h"), F.sum("k").alias("nodes"), F.sum(F.col("k") * F.col("degree")).alias("edges"), F.max("degree").alias("max_degree"),
                      F.sum(F.when(F.col("degree") > 0, F.col("k"))).alias("with_edge"), F.sum((F.col("degree") * F.col("degree") * F.col("k")).cast("double")).alias("sq"))
    at = lambda p: F.expr(f"aggregate(h, named_struct('n', 0L, 'v', CAST(NULL AS BIGINT)), (a, x) -> named_struct('n', a.n + x.k, 'v', IF(a.v IS NULL AND a.n + x.k > floor(nodes * {p}D), x.degree, a.v)), a -> a.v)")
    most_in = edges.groupBy("dst").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("max_in"))
    n_targets = targets.select("node").distinct().agg(F.count("*").alias("targets"))
    one = spread.join(F.broadcast(most_in)).join(F.broadcast(n_targets))
    avg = F.try_divide(F.col("edges").cast("double"), F.col("nodes"))
    kind = F.when((F.col("max_degree") <= 1) & (F.col("max_in") <= 1), "1:1").when(F.col("max_degree") <= 1, "M:1").when(F.col("max_in") <= 1, "1:M").otherwise("M:N")
    return one.select(
        F.col("nodes").alias("n_sources"), F.col("targets").alias("n_targets"), F.coalesce("edges", F.lit(0)).alias("n_edges"), F.coalesce("with_edge", F.lit(0)).alias("n_with_edge"), F.col("max_degree"), avg.alias("avg_degree"),
        F.sqrt(F.greatest(F.try_divide(F.col("sq"), F.col("nodes")) - avg * avg, F.lit(0.0))).alias("stddev_degree"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"),
        F.try_divide(F.coalesce("with_edge", F.lit(0)).cast("double"), F.col("nodes")).alias("sparsity"), kind.alias("multiplicity"))


def supernodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree) of at least max(10, mean + 3 standard deviations)."""
    d = degrees(edges, nodes)
    bound = d.agg(F.greatest(F.lit(10.0), F.avg("degree") + 3 * F.stddev_pop("degree")).alias("bound"))
    return d.join(F.broadcast(bound)).where("degree >= bound").select("node", "degree")


def attribute_statistics(nodes: DataFrame, attr: str, order: str = "node") -> DataFrame:
    """One row: least, largest, nulls, distinct values and whether values rise or fall with the key.

    Monotonicity is decided in ranges of keys and between the ranges' ends.
    """
    x = F.col(attr)
    base = nodes.agg(F.min(x).cast("string").alias("least"), F.max(x).cast("string").alias("largest"), F.count(F.when(x.isNull(), 1)).alias("nulls"), F.count_distinct(x).alias("n_distinct"))
    some = nodes.where(x.isNotNull()).select(F.col(order).alias("o"), x.alias("x"))
    from pyspark.sql import Window

    parts = some.repartitionByRange("o", "x").withColumn("p", F.spark_partition_id())
    lag = parts.withColumn("b", F.lag("x").over(Window.partitionBy("p").orderBy("o", "x")))
    own = lag.groupBy("p").agg(F.coalesce(F.bool_and(F.col("b") <= F.col("x")), F.lit(True)).alias("up"), F.coalesce(F.bool_and(F.col("b") >= F.col("x")), F.lit(True)).alias("down"), F.min_by("x", F.struct("o", "x")).alias("first"), F.max_by("x", F.struct("o", "x")).alias("last"))
    seam = own.withColumn("b", F.lag("last").over(Window.orderBy("p")))  # one row a partition
    both = seam.agg(F.coalesce(F.bool_and(F.col("up") & F.coalesce(F.col("b") <= F.col("first"), F.lit(True))), F.lit(True)).alias("rises"), F.coalesce(F.bool_and(F.col("down") & F.coalesce(F.col("b") >= F.col("first"), F.lit(True))), F.lit(True)).alias("falls"))
    return base.join(F.broadcast(both))


def approx_distinct(df: DataFrame, attr: str, rsd: float = 0.02) -> DataFrame:
    return df.agg(F.approx_count_distinct(attr, rsd).alias("n_distinct"))


def equi_depth_histogram(df: DataFrame, attr: str, buckets: int = 16, accuracy: int = 10_000) -> DataFrame:
    """(bucket, bound): bounds that split the values in parts of about one size."""
    q = [i / buckets for i in range(buckets + 1)]
    found = df.agg(F.percentile_approx(attr, q, accuracy).alias("b"))
    return found.select(F.posexplode("b").alias("bucket", "bound"))


def heavy_hitters(df: DataFrame, attr: str, k: int = 10) -> DataFrame:
    """(value, count) of the k most frequent values, exactly; ties by value."""
    return df.where(F.col(attr).isNotNull()).groupBy(F.col(attr).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(k)


def degree_sketch(edges: DataFrame, nodes: DataFrame, buckets: int = 10) -> DataFrame:
    return equi_depth_histogram(degrees(edges, nodes), "degree", buckets)
