"""Secret scan with multipart credential linking (operator 3).

Three strong kinds are reported wherever they stand: assignments of a password or
token, access identifiers, long hexadecimal runs. Three weak kinds (user names,
random-looking blobs, endpoints) are reported only when complementary parts lie
in the same scope, that is at most ``scope`` characters away and not overlapping, as
one token isn't its own complement: an interval join of the parts on (row, cell),
where each part is entered in the cells it touches.

The join is linear: a part has a least length, so a cell holds a bounded number
of parts whatever the document. Texts are read once and aren't shuffled; only
spans are. Offsets count code points, end exclusive.

Defined results: null is the empty text; a row without spans has empty strings; a
text of any length is scanned as a whole, in about n ** 1.5 steps for n spans;
repeated rows and repeated doc_ids are scanned each on their own; other columns,
whatever their names, aren't looked at; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, running, text_of

#: kind, pattern, group whose length is tested, its least length. Order is that of ties.
STRONG = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
WEAK = [
    ("user", r"""(?i)(user|username|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", 2, 3),
    ("blob", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
    ("endpoint", r"(?i)(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9@:/._?&=%-]{4,}", 0, 8),
]
KINDS = [x[0] for x in STRONG + WEAK]
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "user": "id", "blob": "secret", "endpoint": "endpoint"}
SCOPE, CELL = 200, 256


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kord, end) of one kind; leftmost, non-overlapping, failing matches dropped."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    empty = F.expr("CAST(array() AS array<struct<start:bigint,kord:int,end:bigint>>)")

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        ends = let(gaps, lambda g: running(F.transform(m, lambda x, i: (F.length(F.get(g, i)) + F.length(x)).cast("long"))))
        part = lambda x, end: F.struct((end - F.length(x)).alias("start"), F.lit(KINDS.index(kind)).alias("kord"), end.alias("end"))
        walked = F.zip_with(m, ends, part)
        ok = lambda x, t: F.length(t) >= least
        if kind == "blob":  # letters of both cases and a digit, or it is a plain word
            ok = lambda x, t: t.rlike("[0-9]") & t.rlike("[A-Z]") & t.rlike("[a-z]")
        paired = F.zip_with(walked, tested if group else m, lambda x, t: F.when(ok(x, t), x))
        return F.filter(paired, lambda x: x.isNotNull())

    return let(found, lambda m: F.when(F.size(m) == 0, empty).otherwise(placed(m)))


def named(parts: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.get(kinds, x["kord"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with their complements in scope: (rid, part). parts: rid, part."""
    role = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(ROLE[k]))])
    p = parts.withColumn("role", F.element_at(role, F.col("part.kord")))
    reach = lambda low, high: F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / CELL), F.floor(high / CELL)))
    weak = p.where(F.col("part.kord") >= len(STRONG)).select("rid", "part", "role", reach(F.col("part.start") - scope, F.col("part.end") + scope).alias("cell"))
    near = p.select(F.col("rid").alias("r2"), F.col("part").alias("part2"), F.col("role").alias("role2"), reach(F.col("part.start"), F.col("part.end")).alias("cell2"))
    gap = F.greatest(F.col("part.start") - F.col("part2.end"), F.col("part2.start") - F.col("part.end"))
    met = weak.join(near, (F.col("rid") == F.col("r2")) & (F.col("cell") == F.col("cell2")) & (F.col("role") != F.col("role2")) & gap.between(0, scope))
    by = met.groupBy("rid", "part", "role").agg(F.bool_or(F.col("role2") == "id").alias("has_id"), F.bool_or(F.col("role2") == "secret").alias("has_secret"))
    full = ((F.col("role") == "id") & F.col("has_secret")) | ((F.col("role") == "secret") & F.col("has_id")) | ((F.col("role") == "endpoint") & F.col("has_id") & F.col("has_secret"))
    return by.where(full).select("rid", "part")


def secret_scan(docs: DataFrame, scope: int = SCOPE, carry: list[str] | None = None) -> DataFrame:
    """Per row: struct ``doc`` of the carried columns, base and linked (arrays of start, kord, end)."""
    carry = [c for c in docs.columns if c.lower() != "text"] if carry is None else carry
    of = lambda kinds: F.array_sort(F.concat(*(spans(F.col("t"), *k) for k in kinds)))
    seen = docs.select(F.struct(*carry).alias("doc"), text_of().alias("t")).select("doc", of(STRONG).alias("base"), of(WEAK).alias("weak"))
    seen = cut(seen.withColumn("rid", F.monotonically_increasing_id()))
    parts = seen.where(F.size("weak") > 0).select("rid", F.explode(F.concat("base", "weak")).alias("part"))
    links = linked(parts, scope).groupBy("rid").agg(F.array_sort(F.collect_list("part")).alias("linked"))
    none = F.expr("CAST(array() AS array<struct<start:bigint,kord:int,end:bigint>>)")
    return seen.join(links, "rid", "left").select("doc", "base", F.coalesce("linked", none).alias("linked"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and strings of the result of secret_scan."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kord"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scanned.select("doc.*", n("assign"), n("access"), n("hex"), F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.array_sort(F.concat("base", "linked"))).alias("spans"))
