"""Toxicity by a factorization machine over hashed terms (operator 5).

A term is a normalised word or the first ``PREFIX`` letters of a longer one,
hashed into 2 ** BITS cells. A document is the set of its cells. The machine scores

    b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)

over the cells present, so a pair such as insult and group mention has a weight of
its own through its factors, which additive weights can't give.

It is fitted on the driver on at most ``MAX_FIT`` labelled rows, those with the
smallest hashes of doc_id and one of each doc_id, which is the documented bound. All
cells that stand in ``LEAST_DOCS`` of them take part, whether they tell the classes
apart on their own or not, as a pair may where neither of its terms does. Rows are
sparse; weights and factors that the data don't hold up are drawn to 0 (proximal
steps, a cell's factors as a group), and only others are kept. Weights come first,
then the factors beside them. Every whole text is then scored where it is read,
without a shuffle; the model is a few hundred kilobytes.

Defined results: a null or empty text, or one without known terms, has the score
of the bias alone; null labels are not learned from; with one class or no labels
at all, the score is the share of label 1 (a half without labels); a text of any length
is read as a whole; repeated rows are scored each on its own, and of rows that share a
labelled doc_id the one of the least cells is learned from; an empty table gives an
empty table. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, small_batches

ship(__name__)

BITS, PREFIX, FACTORS = 20, 5, 6
MAX_FIT, LEAST_DOCS = 12_000, 3
#: Rounds of weights alone, all rounds, batches a round, steps of weights and of factors, pulls to 0 of both (over the root of the rows),
#: spread of the factors at first (over the root of a row's cells), the squared slope that they begin to count from,
#: and the most that a row of a rare label 1 weighs.
FIRST, ROUNDS, BATCHES, RATE, RATE_FACTORS, PULL, PULL_FACTORS, SPREAD, CALM, RARE = 20, 40, 12, 0.7, 0.1, 0.02, 0.4, 0.18, 1e-5, 3.0
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def cells(text: bytes | None) -> np.ndarray:
    """Sorted distinct cells of a text."""
    from xxhash import xxh32_intdigest

    words = set(WORD.findall((text or b"").lower()))
    terms = words | {w[:PREFIX] + b"*" for w in words if len(w) > PREFIX}
    return np.unique(np.fromiter((xxh32_intdigest(t) & ((1 << BITS) - 1) for t in terms), np.int32, len(terms)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _emit_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(0).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array([cells(t).tobytes() for t in texts], pa.binary()), b.column(2)], names=["lid", "cells", "y"])


class Machine:
    """Weights by cell: ids (sorted), w, v, b."""

    def __init__(self, ids: np.ndarray, w: np.ndarray, v: np.ndarray, b: float):
        self.ids, self.w, self.v, self.b = ids, w, v, b

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.ids, found)
        at = at[at < len(self.ids)] if not len(self.ids) else np.minimum(at, len(self.ids) - 1)
        at = at[self.ids[at] == found] if len(self.ids) else at
        v = self.v[at]
        s = v.sum(axis=0)
        z = self.b + self.w[at].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Rows:
    """Sparse rows over the given cells: for each, a run of places in ``ids``."""

    def __init__(self, rows: list[np.ndarray], ids: np.ndarray):
        every = np.concatenate([np.empty(0, np.int32), *rows])
        at = np.minimum(np.searchsorted(ids, every), len(ids) - 1)
        known = ids[at] == every
        self.flat = at[known]
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[known]
        self.count = np.bincount(row, minlength=len(rows))
        self.start = np.cumsum(self.count) - self.count

    def of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of some rows' cells, which of the rows each belongs to, and where its run starts."""
        n = self.count[some]
        begin = np.cumsum(n) - n
        return self.flat[np.repeat(self.start[some] - begin, n) + np.arange(n.sum())], np.repeat(np.arange(len(some)), n), begin


def frequent(rows: list[np.ndarray]) -> np.ndarray:
    """Cells of LEAST_DOCS rows or more."""
    return np.flatnonzero(np.bincount(np.concatenate([np.empty(0, np.int32), *rows]), minlength=1 << BITS) >= LEAST_DOCS)


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Machine:
    """Proximal AdaGrad on the logistic loss; the same rows give the same machine."""
    share = float(y.mean()) if len(y) else 0.5
    b = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    ids = frequent(rows) if 0 < share < 1 else np.empty(0, np.int64)
    if not len(ids):
        return Machine(ids, np.zeros(0), np.zeros((0, FACTORS)), b)
    x, rng = Rows(rows, ids), np.random.default_rng(seed)
    pull, pull_factors = PULL / np.sqrt(len(y)), PULL_FACTORS / np.sqrt(len(y))
    w, v = np.zeros(len(ids)), np.zeros((len(ids), FACTORS))
    seen_w, seen_v, seen_b = np.full(len(ids), 1e-8), np.full(len(ids), CALM), 1e-8
    size = max(64, -(-len(y) // BATCHES))
    weight = np.where(y > 0, min(RARE, max(1.0, (1 - share) / share)), 1.0)
    for turn in range(ROUNDS):
        pairs = turn >= FIRST
        if turn == FIRST:
            v = rng.normal(0, SPREAD / np.sqrt(max(1.0, x.count.mean())), v.shape)
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            some = order[at : at + size]
            cell, row, begin = x.of(some)
            add = lambda values, n=len(some), row=row: np.bincount(row, values, n)
            z = b + add(w[cell])
            if pairs:
                vc = v[cell]
                s1 = np.stack([add(vc[:, f]) for f in range(FACTORS)], axis=1)
                z = z + 0.5 * ((s1 * s1).sum(axis=1) - add((vc * vc).sum(axis=1)))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * weight[some] / len(some)
            gw = np.bincount(cell, e[row], len(ids))
            seen_w += gw * gw
            step = RATE / np.sqrt(seen_w)
            w = w - step * gw
            w = np.sign(w) * np.maximum(np.abs(w) - step * pull, 0)
            if pairs:
                gv = np.stack([np.bincount(cell, e[row] * s1[row, f], len(ids)) for f in range(FACTORS)], axis=1) - gw[:, None] * v
                seen_v += (gv * gv).mean(axis=1)
                step = RATE_FACTORS / np.sqrt(seen_v)
                v = v - step[:, None] * gv
                v *= np.maximum(1 - step * pull_factors / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-12), 0)[:, None]
            seen_b += e.sum() ** 2
            b -= RATE * e.sum() / np.sqrt(seen_b)
    held = (w != 0) | v.any(axis=1)
    return Machine(ids[held], w[held], v[held], float(b))


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Machine:
    """Fit on labelled rows that aren't held out, at most ``max_fit`` of them."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.select(F.col("doc_id").alias("lid"), F.col("toxic").cast("int").alias("y")).orderBy(F.xxhash64("lid"), "lid", "y").limit(max_fit)
    texts = docs.select(F.col("doc_id").alias("lid"), F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(sample), "lid").select("text", "lid", "y")
    schema = f"lid {met.schema['lid'].dataType.simpleString()}, cells binary, y int"
    got = [r["one"] for r in met.mapInArrow(_emit_cells, schema).groupBy("lid").agg(F.min(F.struct("cells", "y")).alias("one")).collect()]  # at most max_fit
    got.sort(key=lambda r: (bytes(r["cells"]), r["y"]))  # whatever the order of tasks
    return fit([np.frombuffer(r["cells"], np.int32) for r in got], np.array([r["y"] for r in got], np.float64))


def _emit_scores(machine: Machine):
    ids, w, v, b0 = machine.ids, machine.w, machine.v, machine.b

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Machine(ids, w, v, b0)
        for b in batches:
            scores = [model.score(cells(t)) for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc", "score"])

    return of


def score(docs: DataFrame, machine: Machine, carry: list[str] | None = None) -> DataFrame:
    """doc (carried columns) and score of every row."""
    small_batches(docs.sparkSession)
    carry = [c for c in docs.columns if c.lower() != "text"] if carry is None else carry
    rows = docs.select(F.struct(*carry).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_emit_scores(machine), rows.select("doc").schema.add("score", "double"))


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
