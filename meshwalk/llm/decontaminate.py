"""Benchmark decontamination against a broadcast hash set of n-grams (operator 6).

The benchmark's windows (``n`` consecutive normalised words; a shorter item is one
window) are hashed. While their number is within ``MAX_SET`` the hashes are a set
in the scan itself: each document's windows are tested where they are read, and
only the hits leave the row. Larger sets are a table that the windows' hashes are
joined with: broadcast while its counted rows are within the bound in bytes, so that
the windows are still tested where they are read, else by a shuffle. Every way a hit
is verified by the words themselves, so a hash collision never counts, and the result
is the same.

Defined results: null or empty texts have no words and no hits; an item without
words has no window; equal windows of several items count for each of them;
repeated rows are judged each on their own; a benchmark without windows leaves
every document clean; a text of any length is scanned as a whole, in time linear in
it but for sorting its hits; other columns, whatever their names, come along; empty
tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words_of, checked, cut, let, sized, text_of

N = 10
#: Most benchmark windows that travel inside the plan (8 bytes each).
MAX_SET = 100_000
HIT = "array<struct<at:int,len:int,gram:string>>"


def grams_at(words: Column, length: int) -> Column:
    """Hashes of all windows of so many words, by position from 0."""
    count = F.size(words) - (length - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(words, i, F.lit(length)))))


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct (item_id, len, gram, h)."""
    w = benchmark.select("item_id", alnum_words_of(text_of()).alias("w")).where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(n)))
    each = F.explode(F.transform(F.sequence(F.lit(1), F.expr("size(w) - len + 1")), lambda i: F.slice("w", i, F.col("len"))))
    return w.select("item_id", "len", each.alias("g")).select("item_id", "len", F.array_join("g", " ").alias("gram"), F.xxhash64("g").alias("h")).distinct()


def hits_in_scan(words: Column, lengths: dict[int, list[int]]) -> Column:
    """Windows of ``words`` whose hash is in the set of its length."""

    def of(length: int, hashes: list[int]) -> Column:
        placed = F.transform(grams_at(words, length), lambda h, i: F.when(h.isin(hashes), i))
        kept = F.filter(placed, lambda i: i.isNotNull())
        out = F.transform(kept, lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), F.array_join(F.slice(words, i + 1, F.lit(length)), " ").alias("gram")))
        return F.coalesce(out, F.expr(f"CAST(array() AS {HIT})"))

    return F.concat(F.expr(f"CAST(array() AS {HIT})"), *(of(k, v) for k, v in sorted(lengths.items())))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, carry: list[str] | None = None, max_set: int = MAX_SET, with_words: bool = False) -> DataFrame:
    """Per row: struct ``doc``, n_words, spans (at, len; verified) and items (sorted strings).

    ``with_words`` keeps the text in ``doc`` for cutting the spans out.
    """
    carry = [c for c in docs.columns if with_words or c.lower() != "text"] if carry is None else carry
    grams = cut(benchmark_windows(benchmark, n))
    few = grams.select("len", "h").distinct().limit(max_set + 1).collect()
    lengths: dict[int, list[int]] = {}
    for r in few:
        lengths.setdefault(r["len"], []).append(r["h"])
    base = docs.select(F.struct(*carry).alias("doc"), text_of().alias("t"))
    if len(few) <= max_set:
        seen = base.select("doc", let(alnum_words_of(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), hits_in_scan(w, lengths).alias("hits"))).alias("x"))
        seen = cut(seen.select(F.monotonically_increasing_id().alias("rid"), "doc", "x.n_words", "x.hits"), codec="zstd")
    else:
        seen = _hits_by_join(base, grams, n)
    verified = (
        seen.where(F.size("hits") > 0).select("rid", F.explode("hits").alias("hit")).select("rid", "hit.*")
        .join(grams.select("item_id", "gram"), "gram")
        .groupBy("rid").agg(F.collect_set(F.struct("at", "len")).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    return seen.select("rid", "doc", "n_words").join(verified, "rid", "left").select(
        "doc", "n_words", F.coalesce("spans", F.expr("CAST(array() AS array<struct<at:int,len:int>>)")).alias("spans"), F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))


def _hits_by_join(base: DataFrame, grams: DataFrame, n: int) -> DataFrame:
    """For benchmarks of any size: hashes of all windows meet the benchmark's in a join; only the hits' texts are read again."""
    rows = cut(base.select(F.monotonically_increasing_id().alias("rid"), "doc", "t", F.size(alnum_words_of(F.col("t"))).cast("long").alias("n_words")), codec="zstd")
    lens = [r["len"] for r in grams.select("len").distinct().collect()]  # n values at most
    keys = sized(grams.select("len", "h").distinct())
    none = F.expr("CAST(array() AS array<struct<h:bigint,len:int,at:int>>)")
    placed = lambda w, k: F.transform(grams_at(w, k), lambda h, i: F.struct(h.alias("h"), F.lit(k).alias("len"), i.alias("at")))
    each = let(alnum_words_of(F.col("t")), lambda w: F.concat(none, *(F.coalesce(placed(w, k), none) for k in sorted(lens))))
    met = rows.select("rid", F.explode(each).alias("g")).select("rid", "g.*").join(keys, ["len", "h"], "left_semi")
    at = cut(met.groupBy("rid").agg(F.collect_list(F.struct("at", "len")).alias("found")))
    text = lambda w, x: F.array_join(F.slice(w, x["at"] + 1, x["len"]), " ")
    hits = let(alnum_words_of(F.col("t")), lambda w: F.transform("found", lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), text(w, x).alias("gram"))))
    hit = cut(rows.join(checked(at, "found"), "rid").select("rid", hits.alias("hits")))
    return rows.select("rid", "doc", "n_words").join(hit, "rid", "left").withColumn("hits", F.coalesce("hits", F.expr(f"CAST(array() AS {HIT})")))


def covered(spans: Column) -> Column:
    """Distinct word positions inside the spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1))))


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.size(covered(F.col("spans"))).cast("long")
    return found.select("doc.*", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def remove_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words at the covered positions; what separates words stays."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same runs, before lower-casing
    found, gaps = F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.split(text, word, -1)

    def rebuilt(w: Column, g: Column) -> Column:
        gone = covered(spans)
        flag = lambda at, on: F.transform(at, lambda i: F.struct(i.cast("int").alias("i"), F.lit(on).alias("kept")))
        # By position: whether each word stays.
        flags = let(gone, lambda c: F.array_sort(F.concat(flag(c, False), flag(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), c), True))))
        return F.concat(F.array_join(F.zip_with(F.zip_with(F.slice(g, F.lit(1), F.size(w)), w, lambda a, b: F.struct(a.alias("gap"), b.alias("word"))), flags, lambda x, f: F.concat(x["gap"], F.when(f["kept"], x["word"]).otherwise(""))), ""), F.get(g, F.size(w)))

    return F.when(F.size(spans) == 0, text).otherwise(let(found, lambda w: let(gaps, lambda g: rebuilt(w, g))))
