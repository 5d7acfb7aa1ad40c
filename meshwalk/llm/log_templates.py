"""Recurring line templates by a fixed-depth tree (operator 9).

Every line is parsed into words; words with a digit are variable fields. Texts that
hold the same line, variable fields aside, in ``MIN_DOCS`` of them make it a template
of its own. All other lines go down a tree of fixed depth: the number of words, then
``LEAD`` leading words, each of which has a branch if ``MIN_DOCS`` lines take it, or
else the wildcard branch. In a leaf, a line is ``PARTS`` runs of words (single words,
up to that many); runs that many lines of the leaf have in the same place are
constant, the others generalised. Lines with the same constants are one group, that
is one template, if ``SAME`` of the places are constant. Groups are sought in rounds:
first with all runs that ``MIN_DOCS`` lines share, and what is left with those that
a share of the leaf's lines have (``SHARES``), so fields of few values are found too.

A template recurs if it stands in ``MIN_DOCS`` texts or more (``SHORT_TIMES`` as many
for one of under ``FEW_WORDS`` words) and in different surroundings: the lines before it,
and also those after it, are different in ``VARIED`` of them or more; an end of a text
differs from all else. The surroundings are those of the block, the maximal run of
lines with templates, so boilerplate of several lines goes as one. Lines inside copied
passages stand between the same lines and don't recur.

A text with over ``MOST`` of its words in lines of a fixed sequence (with the line
before or after them that their template has in ``VARIED`` of its texts) is a near copy
of others, not a text with boilerplate in it: it neither counts nor loses lines, as
copies are for the near-duplicate stages and mustn't be emptied here. A text of
separate templates in no fixed order loses them, however many they are. Equal texts
count once, but for the branches and constants, which count lines.

Texts are read twice; hashes of lines are shuffled, not texts. Tables of keys are
broadcast only while their counted rows are within a bound, else joined by a shuffle.
Texts are told apart by two 64-bit hashes with different seeds, lines by one.

Defined results: null and empty texts have no lines with words and stay as they are
(null becomes empty); lines without words are kept; a text or line of any length
counts, in time linear in it; repeated rows and equal texts lose the same lines
whatever their doc_id; an empty table gives an empty table; other columns, whatever
their names, come along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, cut, let, sized, text_of, words_of

LEAD, PARTS, SHARES = 2, 8, (0.0, 0.25)
MIN_DOCS, VARIED, SAME, MOST = 8, 0.5, 0.6, 0.5
FEW_WORDS, SHORT_TIMES = 3, 4
FIELD = "<*>"
TEXT = ["th", "th2"]


def masked(line: Column) -> Column:
    """Words of the line, those with a digit generalised."""
    field = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
    return words_of(F.when(line.rlike("[0-9]"), F.regexp_replace(line, field, FIELD)).otherwise(line))


def text_key(t: str = "t") -> list[Column]:
    return [F.xxhash64(t).alias("th"), F.xxhash64(F.lit("second"), F.col(t)).alias("th2")]


def parts_of(words: Column) -> Column:
    """Hashes of PARTS runs of about equal length, or of each word of a shorter line."""
    n = F.greatest(F.size(words), F.lit(1))
    bound = lambda j, k: (j * n / k).cast("int")
    return let(F.least(n, F.lit(PARTS)), lambda k: F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.xxhash64(F.slice(words, bound(j, k) + 1, bound(j + 1, k) - bound(j, k)))))


def line_table(docs: DataFrame) -> DataFrame:
    """One row of every line with words: lid, TEXT, total (words of the text), pos, place (its number among these), n, template, lead, parts, before, after."""
    lead = lambda w: F.array(*(F.xxhash64(F.get(w, F.lit(k))) for k in range(LEAD)))
    lines = F.transform(F.split("t", "\n"), lambda x, i: let(masked(x), lambda w: F.struct(i.alias("pos"), F.size(w).alias("n"), F.xxhash64(w).alias("template"), lead(w).alias("lead"), parts_of(w).alias("parts"))))
    some = F.filter(lines, lambda x: x["n"] > 0)
    total = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    near = lambda s, i: F.coalesce(F.get(s, i)["template"], F.lit(0).cast("long"))
    each = let(some, lambda s: let(total(s), lambda k: F.transform(s, lambda x, i: F.struct(*(x[c].alias(c) for c in ("pos", "n", "template", "lead", "parts")), i.alias("place"), near(s, i - 1).alias("before"), near(s, i + 1).alias("after"), k.alias("total")))))
    rows = docs.select(text_of().alias("t")).select(*text_key(), F.inline(each))
    return rows.withColumn("lid", F.monotonically_increasing_id())


def needed(min_docs: int) -> Column:
    """In how many texts a template of n words must stand."""
    return F.when(F.col("n") < FEW_WORDS, SHORT_TIMES * min_docs).otherwise(min_docs)


def supported(lines: DataFrame, key: str, min_docs: int) -> DataFrame:
    """Keys that stand in enough texts."""
    found = lines.groupBy(key).agg(F.count_distinct(*TEXT).alias("docs"), F.max("n").alias("n"))
    return sized(found.where(F.col("docs") >= needed(min_docs)).select(key))


def leaves(lines: DataFrame, min_docs: int) -> DataFrame:
    """lines with ``leaf``: a level of the tree after the other, branches counted, the rest to the wildcard."""
    out = lines.withColumn("leaf", F.xxhash64("n"))
    for k in range(LEAD):
        out = out.withColumn("word", F.col("lead")[k])
        branch = sized(out.groupBy("leaf", "word").count().where(F.col("count") >= min_docs).select("leaf", "word", F.lit(True).alias("own")))
        out = out.join(branch, ["leaf", "word"], "left").withColumn("leaf", F.xxhash64("leaf", F.when(F.col("own"), F.col("word")).otherwise(0))).drop("word", "own")
    return out.drop("lead")


def grouped(lines: DataFrame, min_docs: int) -> DataFrame:
    """(lid, key) of the lines whose leaf has a template for them with enough texts."""
    left, found = cut(leaves(lines, min_docs)), None
    for share in SHARES:
        runs = left.select("lid", "leaf", F.posexplode("parts").alias("i", "h"))
        often = runs.groupBy("leaf", "i", "h").count().where(F.col("count") >= min_docs)
        if share:
            size = left.groupBy("leaf").agg(F.count("*").alias("lines"))
            often = often.join(sized(size.where(F.col("lines") >= min_docs)), "leaf").where(F.col("count") >= share * F.col("lines"))
        constant = runs.join(sized(often.select("leaf", "i", "h")), ["leaf", "i", "h"]).groupBy("lid").agg(F.count("*").alias("constants"), F.bit_xor(F.xxhash64("i", "h")).alias("mark"))
        near = left.drop("key").join(constant, "lid").where(F.col("constants") >= SAME * F.size("parts"))
        near = cut(near.withColumn("key", F.xxhash64("leaf", "constants", "mark")).drop("constants", "mark"), [left])
        keys = supported(near, "key", min_docs)
        got = near.join(keys, "key", "left_semi").select("lid", "key")
        found = got if found is None else found.unionByName(got)
        left = cut(near.join(keys, "key", "left_anti"))
        if left.isEmpty():
            break
    return found


def parsed(docs: DataFrame, min_docs: int) -> DataFrame:
    """Lines with a template of enough texts: TEXT, total, pos, n, key, above and below (the keys beside it), before and after (the lines around the block). One row per text and place."""
    lines = cut(line_table(docs))
    equal = supported(lines, "template", min_docs)
    same = lines.join(equal, "template", "left_semi").withColumn("key", F.col("template")).drop("lead", "parts")
    others = lines.join(equal, "template", "left_anti").select("lid", *TEXT, "n", "lead", "parts")
    groups = cut(grouped(others, min_docs))
    varied = lines.drop("lead", "parts").join(sized(groups, 32), "lid")
    met = same.unionByName(varied).drop("lid", "template").dropDuplicates([*TEXT, "pos"])
    ordered = Window.partitionBy(*TEXT).orderBy("place")
    beside = lambda f, step, else_: F.when(f("place").over(ordered) == F.col("place") + step, f("key").over(ordered)).otherwise(F.col(else_))
    met = met.select("*", beside(F.lag, -1, "before").alias("above"), beside(F.lead, 1, "after").alias("below"), (F.col("place") - F.row_number().over(ordered)).alias("run"))
    block = Window.partitionBy(*TEXT, "run").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # An end of a text differs from all else: the text's own hash stands for it.
    end = lambda c: F.when(F.col(c) == 0, F.col("th")).otherwise(F.col(c))
    met = met.withColumns({"before": F.first("before").over(block), "after": F.last("after").over(block)})
    return cut(met.withColumns({"before": end("before"), "after": end("after")}).drop("run", "place"), [lines, groups])


def recurring(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys that stand in enough texts and surroundings."""
    found = lines.groupBy("key").agg(F.count_distinct(*TEXT).alias("docs"), F.count_distinct("before").alias("before"), F.count_distinct("after").alias("after"), F.max("n").alias("n"))
    return sized(found.where((F.col("docs") >= needed(min_docs)) & (F.least("before", "after") >= VARIED * F.col("docs"))).select("key"))


def in_sequence(lines: DataFrame) -> DataFrame:
    """lines with ``fixed``: whether the line stands by a neighbour that its key has in VARIED of its texts or more."""
    docs = sized(lines.groupBy("key").agg(F.count_distinct(*TEXT).alias("docs")), 32)
    out = lines
    for side in ("above", "below"):
        pairs = lines.groupBy("key", side).agg(F.count_distinct(*TEXT).alias("beside"))
        usual = sized(pairs.join(docs, "key").where(F.col("beside") >= VARIED * F.col("docs")).select("key", side, F.lit(True).alias(f"fixed_{side}")), 32)
        out = out.join(usual, ["key", side], "left")
    return out.withColumn("fixed", F.coalesce("fixed_above", "fixed_below", F.lit(False)))


def settled(lines: DataFrame, min_docs: int) -> DataFrame:
    """Lines of recurring keys, near copies left out: texts mostly of such lines in a fixed sequence."""
    flagged = cut(in_sequence(cut(lines.join(recurring(lines, min_docs), "key", "left_semi"))))
    words = F.sum(F.when(F.col("fixed"), F.col("n")).otherwise(0))
    light = sized(flagged.groupBy(*TEXT).agg(words.alias("n"), F.max("total").alias("total")).where(F.col("n") <= MOST * F.col("total")).select(*TEXT), 32)
    left = cut(flagged.join(light, TEXT, "left_semi"))
    return left.join(recurring(left, min_docs), "key", "left_semi")


def drop_templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the recurring lines gone from ``text``, and n_lines and n_dropped in the struct ``lines_info``."""
    drops = cut(settled(parsed(docs, min_docs), min_docs).groupBy(*TEXT).agg(F.collect_set("pos").alias("drop")))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), text_of().alias("t")).select("doc", "t", *text_key())
    met = rows.join(checked(drops, "drop"), TEXT, "left")
    lines = F.split("t", "\n")
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("drop")), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col("drop").isNull(), F.col("t")).otherwise(left)
    info = F.struct(F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
    return met.select(*(text.alias(c) if c.lower() == "text" else F.col("doc")[c].alias(c) for c in docs.columns), info.alias("lines_info"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "lines_info.n_lines", "lines_info.n_dropped", F.sha2("text", 256).alias("kept_sha256"))
