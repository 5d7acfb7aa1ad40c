"""Repeated token spans by de Bruijn compaction (operator 4).

Every window of 20 words is an edge of the de Bruijn graph of the corpus, between
its first and its last 19 words. Most edges lie on paths without branches, which
occur as a whole or not at all. So each document is cut where the least hashed
6-word run of its window changes: consecutive windows that hold the same
occurrence of that run, the path's anchor, travel as one row of (anchor, digest of
the path, coordinates, windows), about one row in eight words. All windows of
a path are different, as each holds its anchor elsewhere.

Joins then compact: paths whose anchor occurs once in the corpus can't repeat and
are dropped; equal paths are one class with its first source coordinates; an
anchor with several classes is where the graph branches, and only there are single
windows compared, one class at a time whatever its number of occurrences. A window
is repeated if its source coordinates aren't the first of its class.

The 64-bit hashes of words and anchors only find candidates. A span is removed only if
its words are those at the source coordinates: classes are formed by the BLAKE2b digest
of the words that are read at each of their coordinates, which has nothing in common
with the hashes; inside one document the words themselves are compared. Spans that are
hashed alike and have other words stay.

Coordinates are a row's own number and the word, so rows that share a doc_id, or have
none, are documents of their own; doc_id is for the order of occurrences alone, and
rows of equal doc_id come in the order of their numbers. The numbers are written with
the texts once, so that all passes and tasks that run again agree on them.

No key's rows are collected: counts and minima combine before each shuffle, and
the joins on hot classes are ones that adaptive execution splits. What is sought in
or removed from a document is a list of longs; such a table is sent to the texts
while it is within ``BROADCAST_BYTES``, which is counted first, and beyond that the
texts are joined by a shuffle. Texts are read in four passes, as paths take more room
than the texts that they are made from: anchors, paths of shared anchors, windows at
branches, removal.

Defined results: null or empty texts have no words; a text of under 20 words loses
none; texts may have up to 2 ** 28 words, beyond which an error is raised; a null
doc_id comes before all others; of repeated rows the first keeps its words; an empty
table gives an empty table; carried columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, cut, ship, small_batches

ship(__name__)

WINDOW, ANCHOR = 20, 6
SPAN = WINDOW - ANCHOR + 1  # windows that can hold one occurrence of an anchor
BASE = 0x9E3779B97F4A7C15
INDEX_BITS = 28
BROADCAST_BYTES = 64 << 20
NO_ID = -(1 << 63)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 15)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))


def digests(words: list[bytes], start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64-bit digests of the words of spans; a span has count words."""
    raw = b"".join(blake2b(b" ".join(words[s : s + n]), digest_size=8).digest() for s, n in zip(start.tolist(), count.tolist(), strict=True))
    return np.frombuffer(raw, "<i8")


class Paths:
    """The paths of one document: arrays anchor, path, start, windows, and which are its first of a kind."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        if n >> INDEX_BITS:
            raise ValueError(f"a text of {n} words; 2 ** {INDEX_BITS} are too many")
        up, self.down = powers(n + 1)
        x = word_hashes(words)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(x * up[:n], out=self.prefix[1:])
        grams = mix(self.hashes(np.arange(n - ANCHOR + 1), ANCHOR))
        place = np.arange(len(grams), dtype=np.uint64)
        low = (grams >> np.uint64(INDEX_BITS) << np.uint64(INDEX_BITS)) | place
        width = 1
        while width * 2 <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
        at = (low & np.uint64((1 << INDEX_BITS) - 1)).astype(np.int64)
        self.start = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        self.windows = np.diff(np.append(self.start, len(at)))
        self.anchor = grams[at[self.start]]
        self.path = mix(self.hashes(self.start, self.windows + WINDOW - 1) + self.windows.astype(np.uint64))
        kind = mix(self.anchor) + self.path
        _, first, own = np.unique(kind, return_index=True, return_inverse=True)
        self.origin = first[own]
        self.first = np.zeros(len(kind), bool)
        self.first[first] = True
        # A path that is hashed like an earlier one of the document but has other words is one of its own.
        for k in np.flatnonzero(~self.first).tolist():
            a, b, size = self.start[k], self.start[self.origin[k]], self.windows[k] + WINDOW - 1
            self.first[k] = words[a : a + size] != words[b : b + size]

    def hashes(self, start: np.ndarray, width) -> np.ndarray:
        return (self.prefix[start + width] - self.prefix[start]) * self.down[start]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _long(x) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _columns(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_long(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> anchor of each document's paths, each path once."""
    for b in batches:
        parts = []
        for text in _texts(b.column(0)):
            words = words_of(text)
            if len(words) >= WINDOW:
                p = Paths(words)
                parts.append((p.anchor[p.first],))
        if parts:
            yield _columns(parts, ["anchor"])


def _emit_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, r, text -> anchor, path (digest of its words), d, r, s, n: each document's first occurrence of each path."""
    for b in batches:
        parts = []
        for d, r, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2)), strict=True):
            words = words_of(text)
            if len(words) >= WINDOW:
                p = Paths(words)
                s, n = p.start[p.first], p.windows[p.first]
                full = lambda x: np.full(len(s), x, np.int64)  # noqa: B023, E731
                parts.append((p.anchor[p.first], digests(words, s, n + WINDOW - 1), full(d), full(r), s, n))
        if parts:
            yield _columns(parts, ["anchor", "path", "d", "r", "s", "n"])


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, r, text, starts of paths -> a row for each window of those paths."""
    for b in batches:
        parts = []
        for d, r, text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2)), b.column(3).to_pylist(), strict=True):
            words = words_of(text)
            if len(words) < WINDOW:
                continue
            p = Paths(words)
            k = np.flatnonzero(np.isin(p.start, want))
            n = p.windows[k]
            if not len(k):
                continue
            bit = np.concatenate([np.arange(x) for x in n])
            at = np.repeat(p.start[k], n) + bit
            full = lambda x: np.full(len(at), x, np.int64)  # noqa: B023, E731
            parts.append((np.repeat(p.anchor[k], n), np.repeat(digests(words, p.start[k], n + WINDOW - 1), n), full(d), full(r), at, bit, digests(words, at, np.full(len(at), WINDOW))))
        if parts:
            yield _columns(parts, ["anchor", "path", "d", "r", "at", "bit", "h"])


def kept_words(words: list[bytes], marks: list[int] | None) -> list[bytes]:
    """The words outside repeated windows. marks: of the paths found elsewhere, the start s and, in the
    low SPAN bits, which of the windows from s on are repeated."""
    if len(words) < WINDOW:
        return words
    p = Paths(words)
    step = np.zeros(len(words) + 1, np.int64)
    again = ~p.first
    np.add.at(step, p.start[again], 1)
    np.add.at(step, p.start[again] + p.windows[again] + WINDOW - 1, -1)
    if marks:
        s, mask = np.array(marks) >> SPAN, np.array(marks) & ((1 << SPAN) - 1)
        row, bit = np.nonzero(mask[:, None] >> np.arange(SPAN) & 1)
        at = s[row] + bit
        at = at[at + WINDOW <= len(words)]
        np.add.at(step, at, 1)
        np.add.at(step, at + WINDOW, -1)
    gone = np.cumsum(step[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words


def _emit_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text, marks -> doc, n_words, n_removed, kept."""
    for b in batches:
        n, gone, kept = [], [], []
        for text, marks in zip(_texts(b.column(1)), b.column(2).to_pylist(), strict=True):
            words = words_of(text)
            left = kept_words(words, marks)
            n.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc", "n_words", "n_removed", "kept"])


def numbered(docs: DataFrame, carry: list[str], id_col: str) -> DataFrame:
    """doc, d (doc_id for the order), t and r, a number of each row that all passes read."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*carry).alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.col("text").cast("string").alias("t"))
    return cut(rows.withColumn("r", F.monotonically_increasing_id()))


def repeats(rows: DataFrame) -> DataFrame:
    """Repeated paths of numbered rows: r, s, mask (windows from word s on that occurred before), source_r, source_s (where its first repeated window stands first)."""
    shared = cut(rows.select("t").mapInArrow(_emit_anchors, "anchor long").groupBy("anchor").count().where("count > 1").select("anchor"))
    texts = rows.select("d", "r", "t")
    paths = texts.mapInArrow(_emit_paths, "anchor long, path long, d long, r long, s long, n long")
    found = cut(paths.join(shared, "anchor", "left_semi"))
    classes = cut(found.groupBy("anchor", "path").agg(F.min(F.struct("d", "r", "s")).alias("first"), F.max("n").alias("n"), F.count("*").alias("times")))
    branching = classes.groupBy("anchor").count().where("count > 1").select("anchor")
    border = classes.join(branching, "anchor", "left_semi").select("first.r", "first.s")
    want = cut(border.groupBy("r").agg(F.collect_list("s").alias("want")))
    single = cut(texts.join(checked(want, "want", BROADCAST_BYTES), "r").select("d", "r", "t", "want").mapInArrow(_emit_windows, "anchor long, path long, d long, r long, at long, bit long, h long"))
    first = single.groupBy("anchor", "h").agg(F.min(F.struct("d", "r", "at")).alias("one"))
    masks = single.join(first, ["anchor", "h"]).where(F.col("one") < F.struct("d", "r", "at")).groupBy("anchor", "path").agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS INT))")).alias("part"), F.min_by("one", "bit").alias("origin"))
    full = F.expr("shiftleft(1L, CAST(n AS INT)) - 1")
    known = cut(classes.select("anchor", "path", "first", "times").join(masks, ["anchor", "path"], "left").where("times > 1 OR part IS NOT NULL"))
    met = found.join(known, ["anchor", "path"])
    own_class = (F.col("first.r") == F.col("r")) & (F.col("first.s") == F.col("s"))
    source = F.when(own_class, F.struct(F.col("origin.r").alias("r"), F.col("origin.at").alias("s"))).otherwise(F.struct("first.r", "first.s"))
    mask = F.when(own_class, F.coalesce("part", F.lit(0))).otherwise(full)
    return met.select("r", "s", mask.alias("mask"), source["r"].alias("source_r"), source["s"].alias("source_s")).where("mask <> 0")


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Per row: doc (carried columns), n_words, n_removed and kept, the words left, joined by blanks."""
    rows = numbered(docs, docs.columns if carry is None else carry, id_col)
    marks = cut(repeats(rows).groupBy("r").agg(F.collect_list(F.expr(f"shiftleft(s, {SPAN}) | mask")).alias("marks")))
    joined = rows.join(checked(marks, "marks", BROADCAST_BYTES), "r", "left").select("doc", "t", "marks")
    schema = joined.select("doc").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return joined.mapInArrow(_emit_kept, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc.*", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
