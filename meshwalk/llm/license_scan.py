"""License scan: phrase places and an exact set-similarity join (operator 10).

Base: the places where a label's phrase stands in the normalised words. Method: a
template is found in a text block that holds at least ``threshold`` of the template's
distinct words (containment). Blocks are windows of words, whatever the lines, so a
notice that is wrapped over lines is found too: for templates of up to c words, c a
power of two, a block is 2 c words from every c-th word on, so any run of c words lies
within a block.

The join is the exact prefix-filter kind. Words of templates are ordered by the number
of documents that hold them, rarest first, over the whole corpus. A block that meets
the threshold shares ``need`` words with the template, so it holds one of the first
``size - need + 1`` (prefix filter; blocks without any such word aren't made at all); it
has ``need`` template words or more (length filter, and the classes of c are one of
both sides); and from a pair's first shared word on, both have enough words left for
the rest (positional filter). Only what passes is counted, and every pair that meets
the threshold passes.

Templates are a table of any size: its words are joined with those of the texts while
they are read, broadcast if the counted words are within a bound, and the prefix words,
while there are ``MAX_SET`` at most, are a set in the scan that makes the blocks; beyond,
blocks are found by a join. Texts are read twice (frequencies, then blocks) and aren't
shuffled unless the prefix words are too many for the scan and the places too many to send.

Defined results: null is the empty text; without words all counts are 0, places
null, labels empty and the score 0; a text of any length is scanned as a whole; repeated
rows are scanned each on their own; templates without words and null labels aren't
sought; other columns, whatever their names, come along; an empty table gives an empty
table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words_of, checked, cut, let, sized, text_of

#: Phrase and label.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Label and words of a template.
TEMPLATES = {
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "all-rights": "copyright all rights reserved",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "apache-2-grant": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike license",
}
THRESHOLD, LEAST_BLOCK = 0.75, 4
#: Most prefix words that travel inside the plan.
MAX_SET = 20_000
FILTERS = ("prefix", "length", "position")
BLOCKS = "array<struct<c:int,k:int,ws:array<string>>>"


def size_class(n_words: int) -> int:
    """The power of two that a template of so many words fits in."""
    return max(LEAST_BLOCK, 1 << (n_words - 1).bit_length())


def needed(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def template_words(templates: DataFrame) -> DataFrame:
    """label, c, word: each template's distinct words."""
    w = templates.where("label IS NOT NULL").select("label", alnum_words_of(text_of()).alias("w")).where(F.size("w") > 0)
    c = F.greatest(F.lit(LEAST_BLOCK), F.pow(F.lit(2), F.ceil(F.log2(F.size("w").cast("double")))).cast("int"))
    return w.select("label", c.alias("c"), F.explode(F.array_distinct("w")).alias("word"))


def with_frequency(words: DataFrame, docs: DataFrame) -> DataFrame:
    """(word, freq) of all template words: in how many documents each stands."""
    vocabulary = sized(words.select("word").distinct(), 48)
    held = docs.select(F.explode(F.array_distinct(alnum_words_of(text_of()))).alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("freq"))
    return cut(vocabulary.join(held, "word", "left").select("word", F.coalesce("freq", F.lit(0)).alias("freq")))


def template_table(words: DataFrame, freq: DataFrame, threshold: float) -> DataFrame:
    """label, c, ws (words, rarest first), size, need. Lists are of one template's words."""
    order = F.array_sort(F.collect_list(F.struct("freq", "word")))
    t = words.join(freq, "word").groupBy("label", "c").agg(F.transform(order, lambda x: x["word"]).alias("ws"))
    return cut(t.withColumn("size", F.size("ws")).withColumn("need", F.ceil(threshold * F.col("size") - 1e-9).cast("int")))


def prefix_index(table: DataFrame, use: tuple[str, ...] = FILTERS) -> DataFrame:
    """label, c, size, need, pt, word: a row for each word by which a template is looked up."""
    words = F.expr("slice(ws, 1, size - need + 1)") if "prefix" in use else F.col("ws")
    return table.select("label", "c", "size", "need", F.posexplode(words).alias("pt", "word"))


def phrase_places(words: Column, joined: Column, phrase: str) -> Column:
    """Starts, in words, of the phrase; the words are walked only where the phrase's characters stand."""
    p = phrase.split()
    there = F.sequence(F.lit(0), F.size(words) - len(p))
    same = lambda i: [F.get(words, i + k) == w for k, w in enumerate(p)]

    def at(i: Column) -> Column:
        out = same(i)[0]
        for x in same(i)[1:]:
            out = out & x
        return out

    return F.when(F.contains(joined, F.lit(f" {phrase} ")), F.filter(there, at)).otherwise(F.expr("CAST(array() AS array<int>)"))


def with_label(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.cast("int").alias("start"), F.lit(label).alias("label")))


def base_places(words: Column) -> Column:
    none = F.expr("CAST(array() AS array<struct<start:int,label:string>>)")
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return let(joined, lambda j: F.concat(none, *(with_label(phrase_places(words, j, p), k) for p, k in PHRASES)))


def block_of(words: Column, c: Column, k: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), k.cast("int").alias("k"), F.array_distinct(F.slice(words, k * c + 1, c * 2)).alias("ws"))


def blocks_in_scan(words: Column, sought: dict[int, list[str]]) -> Column:
    """Blocks with a word of their class's set."""
    none = F.expr(f"CAST(array() AS {BLOCKS})")

    def of(c: int, some: list[str]) -> Column:
        at = F.filter(F.transform(words, lambda x, i: F.when(x.isin(some), i)), lambda i: i.isNotNull())
        ks = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.floor(i / c), F.greatest(F.floor(i / c) - 1, F.lit(0).cast("long"))))))
        return F.transform(ks, lambda k: block_of(words, F.lit(c), k.cast("int")))

    every = sorted({w for some in sought.values() for w in some})
    return F.when(F.exists(words, lambda x: x.isin(every)), F.concat(none, *(of(c, some) for c, some in sorted(sought.items())))).otherwise(none) if every else none


def blocks_by_join(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(rid, c, k, ws), for prefix words of any number. texts: rid, t."""
    keys = sized(index.select("c", "word").distinct(), 48)
    met = texts.select("rid", F.posexplode(alnum_words_of(F.col("t"))).alias("at", "word")).join(keys, "word")
    k = F.floor(F.col("at") / F.col("c")).cast("int")
    ks = met.select("rid", "c", F.explode(F.array(k, F.greatest(k - 1, F.lit(0)))).alias("k")).distinct()
    want = cut(ks.groupBy("rid").agg(F.collect_list(F.struct("c", "k")).alias("want")))
    found = texts.join(checked(want, "want"), "rid").select("rid", let(alnum_words_of(F.col("t")), lambda w: F.transform("want", lambda x: block_of(w, x["c"], x["k"]))).alias("blocks"))
    return found.select("rid", F.inline("blocks"))


def ordered_blocks(blocks: DataFrame, freq: DataFrame) -> DataFrame:
    """rid, c, k, bw: the template words of each block, rarest first."""
    held = blocks.select("rid", "c", "k", F.explode("ws").alias("word")).join(sized(freq, 56), "word")
    order = F.array_sort(F.collect_list(F.struct("freq", "word")))
    return cut(held.groupBy("rid", "c", "k").agg(F.transform(order, lambda x: x["word"]).alias("bw")))


def candidates(blocks: DataFrame, table: DataFrame, use: tuple[str, ...] = FILTERS) -> DataFrame:
    """(rid, c, k, label) pairs that the filters let pass; all that meet the threshold are among them."""
    probes = blocks.select("rid", "c", "k", F.size("bw").alias("m"), F.posexplode("bw").alias("pb", "word"))
    met = probes.join(sized(prefix_index(table, use), 80), ["c", "word"])
    if "length" in use:
        met = met.where("m >= need")
    if "position" in use:
        met = met.where("1 + least(size - 1 - pt, m - 1 - pb) >= need")
    return met.select("rid", "c", "k", "label").distinct()


def matches(blocks: DataFrame, table: DataFrame, use: tuple[str, ...] = FILTERS) -> DataFrame:
    """rid, label, score, c, k of every block and template that meet the threshold."""
    met = candidates(blocks, table, use).join(blocks, ["rid", "c", "k"]).join(table.select("label", "ws", "size", "need"), "label")
    met = met.withColumn("shared", F.size(F.array_intersect("bw", "ws"))).where("shared >= need")
    return met.select("rid", "label", (F.col("shared") / F.col("size")).alias("score"), "c", "k")


def template_frame(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    return docs.sparkSession.createDataFrame(sorted((TEMPLATES if templates is None else templates).items()), "label string, text string")


def license_scan(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, carry: list[str] | None = None, max_set: int = MAX_SET) -> DataFrame:
    """Per row: ``doc``, n_words, places (array of struct start, label) and found (array of label, score, c, k).

    ``templates``: a table of label and text; the labels are distinct.
    """
    carry = [c for c in docs.columns if c.lower() != "text"] if carry is None else carry
    words = cut(template_words(template_frame(docs) if templates is None else templates))
    freq = with_frequency(words, docs)
    table = template_table(words, freq, threshold)
    index = cut(prefix_index(table))
    few = index.select("c", "word").distinct().limit(max_set + 1).collect()
    sought: dict[int, list[str]] = {}
    for r in few if len(few) <= max_set else []:
        sought.setdefault(r["c"], []).append(r["word"])
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*carry).alias("doc"), text_of().alias("t"))
    of = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), base_places(w).alias("places"), blocks_in_scan(w, sought).alias("blocks"))
    if len(few) <= max_set:
        seen = cut(rows.select("rid", "doc", let(alnum_words_of(F.col("t")), of).alias("x")).select("rid", "doc", "x.*"))
        blocks = seen.select("rid", F.inline("blocks"))
    else:
        seen = cut(rows.select("rid", "doc", "t", let(alnum_words_of(F.col("t")), of).alias("x")).select("rid", "doc", "t", "x.*"), codec="zstd")
        blocks = blocks_by_join(seen.select("rid", "t"), index)
    found = matches(ordered_blocks(blocks, freq), table).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("label", "score", "c", "k"))).alias("found"))
    none = F.expr("CAST(array() AS array<struct<label:string,score:double,c:int,k:int>>)")
    return seen.select("rid", "doc", "n_words", "places").join(checked(cut(found), "found"), "rid", "left").select("doc", "n_words", "places", F.coalesce("found", none).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    starts = F.transform("places", lambda x: x["start"])
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    more = F.transform("found", lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    return scanned.select(
        "doc.*", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"))
