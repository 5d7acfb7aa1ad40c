"""SimHash near-duplicates by tiled exact comparison (operator 7).

Every text gets a 64-bit fingerprint of its 4-word shingles. Equal fingerprints
collapse first, so a group of exact copies is one row from there on. Distinct
fingerprints are dealt into tiles and compared exactly within them, by numpy
exclusive-or and bit counts.

Tiles: of ``blocks`` runs of bits, two fingerprints within ``radius`` agree on
``blocks - radius`` at least, so a tile holds the fingerprints that agree on one
such choice and no link is missed. More blocks make more, smaller tiles, so their
number is chosen from the counted distinct fingerprints: the least for which a tile
of random ones holds ``GOAL`` rows at most (5 blocks, 13 shared bits and 5 choices up
to some seven million, 6, 21 and 15 up to some billions, 7, 27 and 35 beyond). A tile with over ``tile`` rows is split by population count and then by a
hash into sub-tiles, and only pairs of sub-tiles whose population counts differ by
``radius`` at most are compared, each pair in a task's run of its own: the work
per run is bounded whatever the skew.

A run reports a spanning forest, at most one link a row, never all pairs; the
components of those links are the classes.

Defined results: null or empty texts have fingerprint 0; repeated rows are one
class; equal doc_ids are allowed, a null doc_id is larger than any other; a text of
any length is read as a whole, in bounded runs of shingles; other columns, whatever
their names, come along; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwalk.operators.components import connected_components

from .common import cut, ship, sized, small_batches

ship(__name__)

SHINGLE, SEED, RADIUS, TILE, GOAL = 4, 42, 4, 4096, 1024
_PART = 65_536


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text; bytes.lower and bytes.split know ASCII alone."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = len(words) - SHINGLE + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, count, _PART):
        pairs = zip(starts[at : min(at + _PART, count)].tolist(), ends[at + SHINGLE - 1 : min(at + _PART, count) + SHINGLE - 1].tolist(), strict=True)
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the fingerprint in the place of the last column, the text."""
    for b in batches:
        texts = b.column(b.num_columns - 1).cast(pa.large_binary()).to_pylist()
        fp = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(rid, carried columns in the struct doc, fp). rid numbers the rows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*carry).alias("doc"), F.col("text").cast("string").alias("t"))
    schema = rows.select("doc").schema.add("fp", "long")
    return cut(rows.mapInArrow(_fingerprints, schema).withColumn("rid", F.monotonically_increasing_id()), codec="zstd")


def choices(radius: int, blocks: int) -> list[int]:
    """Bit masks, one for each choice of blocks that must agree."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << bounds[i + 1]) - (1 << bounds[i]) for i in range(blocks)]
    return [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def blocks_for(count: int, radius: int, goal: int = GOAL) -> int:
    """The least number of blocks for which count / 2 ** (shared bits) is within the goal."""
    return next(b for b in range(radius + 1, 65) if b == 64 or count <= goal * 2 ** (64 * (b - radius) // b))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def runs(fps: DataFrame, radius: int, blocks: int, tile: int) -> DataFrame:
    """Rows (choice, key, a, b, side, fp) of every run; a = b: all pairs, else side 0 against side 1."""
    masks = choices(radius, blocks)
    dealt = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks))).alias("choice", "key")).withColumn("pc", F.bit_count("fp"))
    cells = dealt.groupBy("choice", "key", "pc").count()
    # At most 65 cells a key: which keys overflow, and into how many sub-tiles each cell goes.
    sized = cells.groupBy("choice", "key").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("pc", F.ceil(F.col("count") / tile).cast("int")))).alias("parts")).where(f"n > 1 AND n > {tile}")
    hot = cut(sized.select("choice", "key", "parts"))
    met = dealt.join(hot, ["choice", "key"], "left")
    plain = met.where("parts IS NULL").select("choice", "key", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "fp")
    own = F.col("pc") * 1_000_000 + F.pmod(F.xxhash64("fp"), F.element_at("parts", F.col("pc").cast("int"))).cast("int")
    others = F.flatten(F.transform(
        F.filter(F.map_keys("parts"), lambda p: F.abs(p - F.col("pc")) <= radius),
        lambda p: F.transform(F.sequence(F.lit(0), F.element_at("parts", p) - 1), lambda c: (p * 1_000_000 + c).cast("int"))))
    split = met.where("parts IS NOT NULL").select("choice", "key", "fp", own.cast("int").alias("own"), F.explode(others).alias("other"))
    split = split.select("choice", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    return plain.unionByName(split)


def _close(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x[:, None] ^ y[None, :]) <= radius


def forest(x: np.ndarray, y: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links (from, to) that connect whatever pairs of x (or of x and y) within the radius connect.

    First the rows with any partner are found, block by block, sorted by population
    count so that only a band of rows is compared. Then a search from row to row
    over those reaches each of them once.
    """
    pool = np.unique(x) if y is None else np.concatenate([np.unique(x), np.unique(y)])
    side = np.zeros(len(pool), bool)
    if y is not None:
        side[len(np.unique(x)) :] = True
    order = np.argsort(np.bitwise_count(pool), kind="stable")
    pool, side = pool[order], side[order]
    count = np.bitwise_count(pool).astype(np.int16)
    partner = np.zeros(len(pool), bool)
    for at in range(0, len(pool), 256):
        part = slice(at, at + 256)
        low, high = np.searchsorted(count, count[part][0] - radius), np.searchsorted(count, count[part][-1] + radius, side="right")
        near = _close(pool[part], pool[low:high], radius)
        if y is None:
            mine = np.arange(at, min(at + 256, len(pool)))
            near[mine - at, mine - low] = False
        else:
            near &= side[part][:, None] != side[None, low:high]
        partner[part] |= near.any(axis=1)
    rest, rest_side = pool[partner], side[partner]
    links = []
    while len(rest):
        front, front_side, rest, rest_side = rest[:1], rest_side[:1], rest[1:], rest_side[1:]
        while len(front) and len(rest):
            part, part_side, front, front_side = front[:256], front_side[:256], front[256:], front_side[256:]
            near = _close(part, rest, radius)
            if y is not None:
                near &= part_side[:, None] != rest_side[None, :]
            hit = near.any(axis=0)
            if hit.any():
                via = part[near[:, hit].argmax(axis=0)]
                links += zip(via.tolist(), rest[hit].tolist(), strict=True)
                front, front_side = np.concatenate([front, rest[hit]]), np.concatenate([front_side, rest_side[hit]])
                rest, rest_side = rest[~hit], rest_side[~hit]
    return links


def _compare(radius: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by run; a run may reach over batches and holds two tiles at most."""
        held: list[np.ndarray] = []

        def flush(run: np.ndarray) -> list[tuple[int, int]]:
            # columns: choice, key, a, b, side, fp
            fp, side = run[:, 5].view(np.uint64), run[:, 4]
            if run[0, 2] == run[0, 3]:
                return forest(fp, None, radius) if len(fp) > 1 else []
            return forest(fp[side == 0], fp[side == 1], radius) if side.any() and not side.all() else []

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["src", "dst"])

        for b in batches:
            if not b.num_rows:
                continue
            m = np.stack([np.asarray(c.cast(pa.int64())) for c in b.columns], axis=1)
            edge = np.flatnonzero((m[1:, :4] != m[:-1, :4]).any(axis=1)) + 1
            pieces = np.split(m, edge)
            links: list[tuple[int, int]] = []
            if held and (held[-1][-1, :4] != m[0, :4]).any():
                links += flush(np.concatenate(held))
                held = []
            for p in pieces[:-1]:
                held.append(p)
                links += flush(np.concatenate(held))
                held = []
            held.append(pieces[-1])
            yield out(links)
        if held:
            yield out(flush(np.concatenate(held)))

    return of


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Links (src, dst) between distinct fingerprints ``fp`` that connect all that lie within the radius."""
    fps.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")
    each = runs(fps, radius, blocks_for(fps.count(), radius) if blocks is None else blocks, tile)
    keys = ["choice", "key", "a", "b"]
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_compare(radius), "src long, dst long")


def classes(rows: DataFrame, id_col: str, radius: int, blocks: int | None, tile: int) -> DataFrame:
    """(fp, best): for each fingerprint, the struct (no, id, rid) of its class's first row."""
    first = F.min(F.struct(F.col("doc")[id_col].isNull().alias("no"), F.col("doc")[id_col].alias("id"), F.col("rid").alias("rid")))
    fps = cut(rows.groupBy("fp").agg(first.alias("first")))
    linked = cut(links(fps.select("fp"), radius, blocks, tile).distinct())
    small_batches(rows.sparkSession)  # links takes larger batches of its short rows
    comp = connected_components(linked)
    joined = comp.join(fps, F.col("node") == F.col("fp")).select("fp", "first", "component")
    best = joined.groupBy("component").agg(F.min("first").alias("best"))
    found = joined.select("fp", "component").join(best, "component").select("fp", "best")
    return fps.join(found, "fp", "left").select("fp", F.coalesce("best", "first").alias("best"))


def near_duplicates(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Per row: rid, doc (carried columns), fp, component_id and keeper (rid of the one row to keep)."""
    rows = fingerprints(docs, docs.columns if carry is None else carry)
    every = classes(rows, id_col, radius, blocks, tile)
    return rows.join(sized(every, 48), "fp").select("rid", "doc", "fp", F.col("best.id").alias("component_id"), F.col("best.rid").alias("keeper"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """docs with one row of each class, that of the smallest id. Texts are dealt by row number, so copies don't meet in a task."""
    rows = fingerprints(docs, docs.columns)
    kept = classes(rows, id_col, radius, blocks, tile).select(F.col("best.rid").alias("rid")).distinct()
    left = rows.join(kept, "rid", "left_semi")
    return left.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc.*", hex16(F.col("fp")).alias("fingerprint"), "component_id")
