"""Approximate vector search by cells: an index of quantised rows, probed and reranked.

``fit`` finds the centres of the cells by k-means on a bounded sample, the ``FIT_ROWS``
rows whose ids have the least hashes, and measures there how many cells a query must
probe to meet a share ``AIM`` of its nearest neighbours. ``build`` puts every row of the
table in its nearest cell, as one byte a dimension, in tiles of about ``TILE`` rows.
``search`` sends each query to its nearest cells, compares tiles with blocks of queries
by matrix products, keeps ``OVER`` times k rows a query and scores those by the
original vectors.

Cells are joined by tile, so a hot cell is many rows and no group is held whole by
a task. What is broadcast are the centres and the rows of each cell, at most
``FIT_ROWS / 8`` of them.

Every metric of the exact search has a space in which the nearest by Euclidean distance
are those of the largest score: unit vectors for cosine, signs for hamming, and for dot
a further dimension that gives all rows the same length.

Defined results: rows and queries without a vector, with a missing or infinite
element or of another dimension than most of the sample have no score and aren't found;
ids are taken to be unique; ties go to the least id; an empty table finds nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwalk.operators.vectors import similarity
from meshwalk.plans.durable import cut
from meshwalk.plans.shipping import ship

ship(__name__)

FIT_ROWS, ROUNDS, ASKED = 20_000, 10, 512
AIM, NEIGHBOURS = 0.97, 10
TILE, QUERY_BLOCK, OVER = 1024, 256, 4
#: Rows of an Arrow batch of pairs of a tile and a block.
PAIRS = 64
METRICS = ("cosine", "l2", "dot", "hamming")


def scalar_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as signed bytes and the step of each row."""
    step = np.abs(x).max(axis=1, initial=0.0) / 127
    return np.rint(x / np.where(step > 0, step, 1)[:, None]).astype(np.int8), step.astype(np.float32)


def sign_codes(x: np.ndarray) -> np.ndarray:
    """Sign bits of rows, eight to a byte."""
    return np.packbits(x > 0, axis=1)


def prepared(x: np.ndarray, metric: str, longest: float, query: bool = False) -> np.ndarray:
    """Rows in the space of the metric; ``longest`` is the largest norm of the table."""
    x = x.astype(np.float32)
    if metric == "cosine":
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)
    if metric == "hamming":
        return np.where(x > 0, 1, -1).astype(np.float32)
    if metric == "dot":
        rest = np.zeros(len(x)) if query else longest**2 - (x.astype(float) ** 2).sum(axis=1)
        return np.column_stack([x, np.sqrt(np.maximum(rest, 0))]).astype(np.float32)
    return x


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared, less the squared length of x's rows, which ranks alike."""
    return (to * to).sum(axis=1)[None, :] - 2 * (x @ to.T)


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centres of each row."""
    blocks = [np.argsort(distances(x[i : i + 1024], centres), axis=1, kind="stable")[:, :n] for i in range(0, len(x), 1024)]
    return np.concatenate(blocks) if blocks else np.zeros((0, n), int)


def k_means(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres, from the first rows on; a cell without rows keeps its centre."""
    centres = x[:cells].copy()
    for _ in range(rounds):
        home = nearest(x, centres, 1)[:, 0]
        count = np.bincount(home, minlength=cells)
        sums = np.zeros((cells, x.shape[1]))
        np.add.at(sums, home, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres).astype(np.float32)
    return centres


def probes_needed(x: np.ndarray, asked: np.ndarray, centres: np.ndarray, k: int, aim: float) -> int:
    """Cells that the first rows must probe to meet a share ``aim`` of their k nearest other rows."""
    if len(x) < 2:
        return 1
    d = distances(asked, x)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    order = nearest(asked, centres, len(centres))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centres))[None, :], axis=1)
    found = np.take_along_axis(rank, nearest(x, centres, 1)[:, 0][near], axis=1)
    return int(np.sort(found, axis=None)[math.ceil(aim * found.size) - 1]) + 1


@dataclass
class Cells:
    """A fitted partition of the space."""

    metric: str
    dim: int
    longest: float
    centres: np.ndarray
    probes: int


@dataclass
class VectorIndex:
    """``tiles``: cell, nodes and their codes. ``rows``: node and the original vector."""

    cells: Cells
    tiles: DataFrame
    rows: DataFrame


def _usable(df: DataFrame, id_col: str, vec_col: str, as_id: str) -> DataFrame:
    finite = F.forall("v", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    return df.select(F.col(id_col).alias(as_id), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col(as_id).isNotNull()).where(finite)


def _square(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, e: a + e * e)


def fit(vectors: DataFrame, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, fit_rows: int = FIT_ROWS, aim: float = AIM, k: int = NEIGHBOURS) -> Cells:
    """Cells of a table; as many as the root of its rows unless ``cells`` says, an eighth of the sample at most."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    rows = _usable(vectors, id_col, vec_col, "node")
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("node"), "node").limit(fit_rows).collect()]  # bounded by fit_rows
    if not sample:
        return Cells(metric, 0, 0.0, np.zeros((0, 0), np.float32), 0)
    sizes = Counter(map(len, sample))
    dim = min(sizes, key=lambda n: (-sizes[n], n))
    total, longest = rows.where(F.size("v") == dim).agg(F.count("*"), F.sqrt(F.max(_square("v")))).first()
    kept = np.array([v for v in sample if len(v) == dim])
    x = prepared(kept, metric, longest)
    most = max(1, len(x) // 8)
    centres = k_means(x, min(most, cells or max(1, round(math.sqrt(total)))))
    return Cells(metric, dim, longest, centres, probes_needed(x, prepared(kept[:ASKED], metric, longest, True), centres, k, aim))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _code_rows(c: Cells):
    """node, v -> node, cell, code (step and bytes)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = prepared(_matrix(b.column(1), c.dim), c.metric, c.longest)
            codes, step = scalar_codes(x)
            raw = [s.tobytes() + q.tobytes() for s, q in zip(step, codes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest(x, c.centres, 1)[:, 0], pa.int32()), pa.array(raw, pa.binary())], names=["node", "cell", "code"])

    return of


def _probe(c: Cells, probes: int):
    """query, v -> query, cell, point: a row of each cell to probe."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = prepared(_matrix(b.column(1), c.dim), c.metric, c.longest, True)
            to = nearest(x, c.centres, probes)
            again = np.repeat(np.arange(len(x)), to.shape[1])
            raw = [p.tobytes() for p in x]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(again)), pa.array(to.ravel(), pa.int32()), pa.array([raw[i] for i in again], pa.binary())], names=["query", "cell", "point"])

    return of


def _dealt(rows: DataFrame, key: str, size: int, values: list[str]) -> DataFrame:
    """Rows of each cell in lists of about ``size``; the cells' counts are a row of each cell."""
    counts = F.broadcast(rows.groupBy("cell").count())
    part = F.pmod(F.xxhash64(key), F.ceil(F.col("count") / size))
    lists = rows.join(counts, "cell").withColumn("part", part).groupBy("cell", "part").agg(F.collect_list(F.struct(*values)).alias("all"))
    return lists.select("cell", *(F.col("all")[v].alias(f"{v}s") for v in values))


def build(vectors: DataFrame, cells: Cells, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
    """The index of every row that has a score, written to the shared folder."""
    rows = _usable(vectors, id_col, vec_col, "node").where(F.size("v") == cells.dim)
    kind = rows.schema["node"].dataType.simpleString()
    coded = cut(rows.mapInArrow(_code_rows(cells), f"node {kind}, cell int, code binary"))
    return VectorIndex(cells, cut(_dealt(coded, "node", TILE, ["node", "code"])), rows)


def _compare(dim: int, keep: int):
    """nodes, codes, querys, points -> query, node, far: the nearest rows of a tile for each query of a block."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                nodes, codes, queries, points = (b.column(j)[i].values for j in range(4))
                raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(nodes), dim + 4)
                step = raw[:, :4].copy().view(np.float32)
                x = raw[:, 4:].view(np.int8).astype(np.float32) * step
                far = distances(np.frombuffer(b"".join(points.to_pylist()), np.float32).reshape(len(queries), dim), x)
                # All that are as near as the last one kept stay, so ties are settled by id and not here.
                last = np.partition(far, min(keep, far.shape[1]) - 1, axis=1)[:, min(keep, far.shape[1]) - 1 : min(keep, far.shape[1])]
                q, n = np.nonzero(far <= last)
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), nodes.take(pa.array(n)), pa.array(far[q, n], pa.float32())], names=["query", "node", "far"])

    return of


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, over: int = OVER) -> DataFrame:
    """(query, node, score, rank) of the k nearest found for each row (query, vector).

    ``probes`` cells are looked into, those measured by ``fit`` if none are given.
    """
    c = index.cells
    asked = _usable(queries, "query", "vector", "query").where(F.size("v") == c.dim)
    ids = (asked.schema["query"].dataType.simpleString(), index.rows.schema["node"].dataType.simpleString())
    spark, name = queries.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not len(c.centres):
        return spark.createDataFrame([], f"query {ids[0]}, node {ids[1]}, score double, rank int")
    probes = min(len(c.centres), probes or c.probes)
    blocks = cut(_dealt(cut(asked.mapInArrow(_probe(c, probes), f"query {ids[0]}, cell int, point binary")), "query", QUERY_BLOCK, ["query", "point"]))
    pairs = index.tiles.join(blocks, "cell").select("nodes", "codes", "querys", "points")
    by = lambda *order: F.row_number().over(Window.partitionBy("query").orderBy(*order))
    before = spark.conf.get(name)
    spark.conf.set(name, str(PAIRS))
    try:
        met = pairs.mapInArrow(_compare(c.centres.shape[1], over * k), f"query {ids[0]}, node {ids[1]}, far float")
        near = cut(met.withColumn("at", by("far", "node")).where(F.col("at") <= over * k).select("query", "node"))
    finally:
        spark.conf.set(name, before)
    exact = near.join(asked.withColumnRenamed("v", "q"), "query").join(index.rows, "node").select("query", "node", similarity(F.col("q"), F.col("v"), c.metric).alias("score"))
    return exact.withColumn("rank", by(F.desc("score"), "node")).where(F.col("rank") <= k)
