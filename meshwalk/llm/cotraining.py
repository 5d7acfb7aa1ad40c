"""Quality by co-training two views (operator 2).

View one sees the text: its words, hashed, and their shape and repetition. View two
sees the page's metadata alone: language, source and stated length. Each has a logistic
classifier, fitted first on labelled rows. Then, over ``ROUNDS`` rounds, every
unlabelled document is scored by both views, and those that one view is sure of are
labelled so for the other (if the view is right about labelled rows that it is as sure of), which takes a Newton step on labelled and pseudo-labelled
rows together. Each view is then calibrated (Platt) on labelled rows that no round has
seen, and the calibrated log-odds are added, less the log-odds of the labels' share
that both hold, for the score of every document.

Labelled rows are bounded, ``MAX_FIT`` of them, those with the smallest hashes of
doc_id, one of each. The pool isn't: all documents without such a label that aren't
held out are in it, in every round. A round gathers no rows, only the sums of the
Newton step, added up in a tree of tasks; a pseudo-labelled row weighs at most as much as
a labelled one, and those of a class together at most as much as the labelled ones of it. Whole texts are read once, for
a table of features, which the rounds and the scoring read.

Defined results: null or empty texts have features of value 0; null metadata is a
value of its own, unlike any string; missing metadata columns count as null; null
labels aren't learned from; with one class or none the score is that class's share (a
half without labels); a text of any length is read as a whole; repeated rows are scored
each on its own, and of rows that share a labelled doc_id the one of the least features
is learned from; an empty table gives an empty table; other columns, whatever their
names, come along or aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, small_batches

ship(__name__)

MAX_FIT, ROUNDS, SURE, STRIDE = 8_000, 4, 4.0, 2.0  # log-odds from which a view is sure; the longest step of a weight
PRECISE = 0.97  # share of right ones, counted with two wrong ones added, among labelled rows that a view is as sure of
TERMS, MARKS = 128, 64  # cells of hashed words and of hashed metadata
CALIBRATION_SHARE = 4  # every fourth labelled row calibrates
SHAPE, SIZES = 10, 3
WIDTHS = (SHAPE + TERMS, SIZES + MARKS)


def content_view(text: bytes | None) -> np.ndarray:
    """Shape and repetition of the words, and the share of them in each cell, rooted."""
    from xxhash import xxh32_intdigest

    out = np.zeros(WIDTHS[0], np.float32)
    words = (text or b"").split()
    n = len(words)
    if not n:
        return out
    low = [w.lower() for w in words]
    pairs = len(set(zip(low, low[1:], strict=False)))
    triples = len(set(zip(low, low[1:], low[2:], strict=False)))
    marks = sum(map(text.count, (b"!", b"?")))
    out[:SHAPE] = (
        math.log1p(n), sum(map(len, words)) / n, len(set(low)) / n, pairs / max(1, n - 1), triples / max(1, n - 2),
        sum(map(bytes.isupper, words)) / n, sum(map(bytes.istitle, words)) / n, math.log1p(100 * marks / n),
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, sum(map(bytes.isalpha, words)) / n,
    )
    out[SHAPE:] = np.sqrt(np.bincount(np.fromiter((xxh32_intdigest(w) % TERMS for w in low), np.int64, n), minlength=TERMS) / n)
    return out


def page_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Metadata of the page; nothing of its text."""
    from xxhash import xxh32_intdigest

    out = np.zeros(WIDTHS[1], np.float32)
    size = math.log1p(max(0, n_chars or 0))
    out[:SIZES] = size, size * size / 10, n_chars is None
    name = lambda x: "-" if x is None else f"+{x}"
    for mark in (f"l{name(lang)}", f"s{name(source)}", f"b{name(lang)}{name(source)}"):
        out[SIZES + xxh32_intdigest(mark.encode()) % MARKS] = 1.0
    return out


class Logistic:
    """Standardised features, ridge-penalised logistic regression by Newton steps."""

    ridge = 1.0
    trust = (False, False)

    def start(self, x: np.ndarray) -> Logistic:
        spread = x.std(axis=0)
        self.mean, self.scale = x.mean(axis=0), np.where(spread > 1e-3, spread, 1.0)
        self.w = np.zeros(x.shape[1] + 1)
        return self

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.w

    def check(self, x: np.ndarray, y: np.ndarray) -> None:
        """Which of the two labels this view may teach: those that it is right about where labels are known."""
        odds = self.odds(x)
        right = [y[odds < -SURE] == 0, y[odds > SURE] == 1]
        self.trust = tuple(bool(r.sum() >= PRECISE * (len(r) + 2)) for r in right)

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Curvature and slope of the rows at the present weights."""
        z = self.design(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        return (z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p)

    def step(self, curve: np.ndarray, slope: np.ndarray) -> float:
        hold = np.r_[1e-6, np.full(len(self.w) - 1, self.ridge)]
        move = np.linalg.solve(curve + np.diag(hold), slope - hold * self.w)
        move *= min(1.0, STRIDE / max(np.abs(move).max(), 1e-12))
        self.w = self.w + move
        return float(np.abs(move).max())

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.start(x)
        for _ in range(25):
            if self.step(*self.sums(x, y)) < 1e-6:
                break
        return self


def platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset. A view whose odds fall as labels rise has nothing to say but the share."""
    m = Logistic()
    m.ridge = 0.1
    m.fit(np.clip(odds, -12, 12)[:, None], y)
    if m.w[1] <= 0:
        return 0.0, float(math.log(y.mean() / (1 - y.mean())))
    return float(m.w[1] / m.scale[0]), float(m.w[0] - m.w[1] * m.mean[0] / m.scale[0])


class CoTrained:
    """Two fitted views, their calibrations, or a constant share where nothing could be learned."""

    def __init__(self, share: float, views: list[Logistic] | None = None, calibrated: list[tuple[float, float]] | None = None):
        self.share, self.views, self.calibrated = share, views, calibrated

    def scores(self, views: list[np.ndarray]) -> np.ndarray:
        """Rows of (content, page, combined)."""
        if self.views is None:
            return np.full((len(views[0]), 3), self.share)
        odds = [np.clip(a * np.clip(v.odds(x), -12, 12) + b, -30, 30) for v, x, (a, b) in zip(self.views, views, self.calibrated, strict=True)]
        return 1 / (1 + np.exp(-np.stack([*odds, odds[0] + odds[1] - math.log(self.share / (1 - self.share))], axis=1)))


class Taught:
    """Sums over pool rows for each taught view and pseudo-label: how many, curvature, slope."""

    def __init__(self, widths):
        self.parts = [[np.zeros(1), np.zeros((k + 1, k + 1)), np.zeros(k + 1)] for k in widths for _ in (0, 1)]

    def add(self, models: list[Logistic], views: list[np.ndarray]) -> Taught:
        odds = [m.odds(x) for m, x in zip(models, views, strict=True)]
        for k in (0, 1):
            for label in (0, 1):
                sure = odds[1 - k] > SURE if label else odds[1 - k] < -SURE
                if models[1 - k].trust[label] and sure.any():
                    curve, slope = models[k].sums(views[k][sure], np.full(sure.sum(), float(label)))
                    for part, more in zip(self.parts[2 * k + label], (sure.sum(), curve, slope), strict=True):
                        part += more
        return self

    def dump(self) -> bytes:
        return np.concatenate([x.ravel() for part in self.parts for x in part]).tobytes()

    def load(self, raw: bytes) -> Taught:
        flat, at = np.frombuffer(raw), 0
        for part in self.parts:
            for x in part:
                x += flat[at : at + x.size].reshape(x.shape)
                at += x.size
        return self


def co_train(views: list[np.ndarray], y: np.ndarray, teach, rounds: int = ROUNDS) -> CoTrained:
    """views and y: labelled rows. teach(models): the Taught of all pool rows."""
    share = float(y.mean()) if len(y) else 0.5
    later = np.arange(len(y)) % CALIBRATION_SHARE == CALIBRATION_SHARE - 1
    if min((y[part] == c).sum() for part in (later, ~later) for c in (0, 1)) < 2:
        return CoTrained(share)
    base, t = [v[~later] for v in views], y[~later]
    models = [Logistic().fit(b, t) for b in base]
    for _ in range(rounds):
        for m, b in zip(models, base, strict=True):
            m.check(b, t)
        taught = teach(models)
        for k, m in enumerate(models):
            curve, slope = m.sums(base[k], t)
            for label in (0, 1):
                n, more_curve, more_slope = taught.parts[2 * k + label]
                if n[0]:
                    weight = min(1.0, (t == label).sum() / n[0])
                    curve, slope = curve + weight * more_curve, slope + weight * more_slope
            m.step(curve, slope)
    return CoTrained(share, models, [platt(m.odds(v[later]), y[later]) for m, v in zip(models, views, strict=True)])


COLUMNS = ("text", "lang", "source", "n_chars")


def _emit_views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, lid, text, lang, source, n_chars -> doc, lid and the two views as bytes of floats."""
    for b in batches:
        texts = b.column(2).cast(pa.large_binary()).to_pylist()
        meta = zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([content_view(x).tobytes() for x in texts], pa.binary()), pa.array([page_view(*m).tobytes() for m in meta], pa.binary())], names=["doc", "lid", "a", "b"])


def features(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc (carried columns), lid (doc_id) and the views a and b of every row, written once."""
    small_batches(docs.sparkSession)
    carry = [c for c in docs.columns if c.lower() != "text"] if carry is None else carry
    have = {c.lower() for c in docs.columns}
    inputs: list[Column] = [(F.col(c).cast(k) if c in have else F.lit(None).cast(k)).alias(c) for c, k in zip(COLUMNS, ("string", "string", "string", "long"), strict=True)]
    rows = docs.select(F.struct(*carry).alias("doc"), F.col("doc_id").alias("lid"), *inputs)
    return cut(rows.mapInArrow(_emit_views, rows.select("doc", "lid").schema.add("a", "binary").add("b", "binary")), codec="zstd")


def _matrices(b: pa.RecordBatch, first: int) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(b.column(first + k).to_pylist()), np.float32).reshape(b.num_rows, WIDTHS[k]).astype(float) for k in (0, 1)]


def _teach(models: list[Logistic]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Taught(WIDTHS)
        for b in batches:
            if b.num_rows:
                out.add(models, _matrices(b, 0))
        yield pa.RecordBatch.from_arrays([pa.array([out.dump()], pa.binary())], names=["sums"])

    return of


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Taught(WIDTHS)
    for b in batches:
        for raw in b.column(0).to_pylist():
            out.load(raw)
    yield pa.RecordBatch.from_arrays([pa.array([out.dump()], pa.binary())], names=["sums"])


def taught_by(pool: DataFrame, models: list[Logistic]) -> Taught:
    """Sums over all rows of the pool; in a tree, so that the driver gets few whatever the number of tasks."""
    sums, parts = pool.select("a", "b").mapInArrow(_teach(models), "sums binary"), pool.rdd.getNumPartitions()
    while parts > 16:
        parts = math.ceil(parts**0.5)
        sums = sums.repartition(parts).mapInArrow(_add_up, "sums binary")
    out = Taught(WIDTHS)
    for r in sums.collect():
        out.load(bytes(r["sums"]))
    return out


def train(table: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, held_out=None) -> CoTrained:
    """Fit on ``features`` of labelled rows that aren't held out, at most ``max_fit`` of them; the pool is all others."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    ids = table.where(F.col("lid").isNotNull())
    if held_out is not None:
        usable, ids = usable.where(~held_out(F.col("doc_id"))), ids.where(~held_out(F.col("lid")))
    lean = cut(usable.select(F.col("doc_id").alias("lid"), F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("lid"), "lid", "y").limit(max_fit))
    met = ids.join(F.broadcast(lean), "lid").groupBy("lid").agg(F.min(F.struct("a", "b", "y")).alias("one"))
    got = sorted((bytes(r["one"]["a"]), bytes(r["one"]["b"]), r["one"]["y"]) for r in met.collect())  # at most max_fit
    # Sorted rows are shuffled with a fixed seed, so that the calibration share is spread evenly.
    order = np.random.default_rng(11).permutation(len(got))
    view = lambda k: np.array([np.frombuffer(r[k], np.float32) for r in got], float).reshape(len(got), WIDTHS[k])[order]
    pool = ids.join(F.broadcast(lean.select("lid").distinct()), "lid", "left_anti")
    return co_train([view(0), view(1)], np.array([r[2] for r in got], float)[order], lambda models: taught_by(pool, models))


def _emit_scores(model: CoTrained):
    state = (model.share, model.views, model.calibrated)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = CoTrained(*state)
        for b in batches:
            if b.num_rows:
                s = m.scores(_matrices(b, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(s[:, k])) for k in range(3))], names=["doc", "content_score", "page_score", "score"])

    return of


def score(table: DataFrame, model: CoTrained) -> DataFrame:
    """doc (carried columns), content_score, page_score and score of every row of ``features``."""
    schema = table.select("doc").schema
    for c in ("content_score", "page_score", "score"):
        schema = schema.add(c, "double")
    return table.select("doc", "a", "b").mapInArrow(_emit_scores(model), schema)


def digest(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "content_score", "page_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))
