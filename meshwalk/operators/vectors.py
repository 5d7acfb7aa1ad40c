"""Vector similarity, exact top-k and reranking, and measures of approximate results.

The approximate search itself is in ``vector_index``.

Larger is nearer for every metric: dot, cosine, l2 (minus the squared distance),
hamming (minus the number of different signs). Missing vectors or dimensions that
differ have no score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def similarity(a: Column, b: Column | Sequence[float], metric: str = "cosine") -> Column:
    b = b if isinstance(b, Column) else F.array(*(F.lit(float(x)) for x in b))
    pair = lambda f: F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    dot = _sum(pair(lambda x, y: x * y))
    if metric == "dot":
        out = dot
    elif metric == "l2":
        out = -_sum(pair(lambda x, y: (x - y) * (x - y)))
    elif metric == "hamming":
        out = -_sum(pair(lambda x, y: ((x > 0) != (y > 0)).cast("double")))
    elif metric == "cosine":
        norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
        by = norm(a) * norm(b)
        out = F.when(by <= 1e-12, F.lit(0.0)).otherwise(F.try_divide(dot, by))
    else:
        raise ValueError(f"unknown metric {metric}")
    return F.when(F.size(a) == F.size(b), F.nanvl(out, F.lit(None)))


def normalise(v: Column) -> Column:
    """To unit Euclidean length; a zero vector stays."""
    n = F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(node, score): the k nearest, ties by least id. Each task keeps k rows, so nothing but those moves."""
    scored = vectors.select(F.col(id_col).alias("node"), similarity(F.col(vec_col), query, metric).alias("score")).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), "node").limit(k)


def rerank(candidates: DataFrame, vectors: DataFrame, query: Sequence[float], metric: str = "cosine", k: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(node, score) of the candidates, missing vectors last and without a score."""
    met = candidates.select("node").distinct().join(vectors.select(F.col(id_col).alias("node"), F.col(vec_col).alias("_v")), "node", "left")
    out = met.select("node", similarity(F.col("_v"), query, metric).alias("score")).orderBy(F.desc_nulls_last("score"), "node")
    return out if k is None else out.limit(k)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", block: int = 64) -> DataFrame:
    """(query, node, score, rank) for a stated, bounded query set (query, vector).

    Queries are broadcast in blocks against the scan; every block keeps k rows a query.
    """
    rows = queries.select("query", "vector").collect()
    out = None
    for at in range(0, len(rows), block):
        part = [(r["query"], similarity(F.col(vec_col), list(r["vector"]), metric)) for r in rows[at : at + block]]
        each = F.explode(F.array(*(F.struct(F.lit(q).alias("query"), s.alias("score")) for q, s in part)))
        scored = vectors.select(F.col(id_col).alias("node"), each.alias("x")).select("x.query", "node", "x.score").where("score IS NOT NULL")
        by = Window.partitionBy("query").orderBy(F.desc("score"), "node")
        best = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query long, node long, score double, rank int")


def hyperplane_codes(v: Column, planes: Sequence[Sequence[float]]) -> Column:
    """Sign bits of the projections on the planes, as a long."""
    code = F.lit(0).cast("long")
    for i, p in enumerate(planes):
        bit = similarity(v, p, "dot") > 0
        code = code + F.when(bit, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return code


def quality(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """recall_at_1, recall_at_k, ndcg_at_k and mrr of (query, node, rank) against the exact ranks."""
    e = exact.where(F.col("rank") <= k).select("query", "node", F.col("rank").alias("true_rank"))
    n = exact.where(F.col("rank") <= k).groupBy("query").agg(F.count("*").alias("n"))
    hit = e.join(found.where(F.col("rank") <= k).select("query", "node", "rank"), ["query", "node"])
    gain = hit.groupBy("query").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.max(F.when((F.col("rank") == 1) & (F.col("true_rank") == 1), 1).otherwise(0)).alias("first"), F.max(F.when(F.col("true_rank") == 1, 1 / F.col("rank"))).alias("rr"))
    ideal = F.expr("aggregate(sequence(1, n), 0D, (a, i) -> a + 1 / log2(i + 1))")
    full = n.join(gain, "query", "left").withColumn("ideal", ideal)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return full.agg(F.avg(z(F.col("first").cast("double"))).alias("recall_at_1"), F.avg(z(F.col("hits") / F.col("n"))).alias("recall_at_k"), F.avg(z(F.col("dcg") / F.col("ideal"))).alias("ndcg_at_k"), F.avg(z(F.col("rr"))).alias("mrr"))
