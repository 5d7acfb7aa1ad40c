"""Robust multivariate outliers by minimum covariance determinant (operator 1).

Every document gets five counts from its whole text. The counts become four
transformed statistics, and a minimum-covariance-determinant (MCD) estimate for
each language and source tells how far a document is from the bulk of its group.
Everything is DataFrame or SQL expressions: one pass over the texts makes a
narrow table, and all estimation runs on that.

An estimate starts from each of ``STARTS``, which are computed and not drawn:
the coordinates' medians in units of the floors, mean and covariance of all rows, and
the covariance of the rows' directions from the medians. From each, concentration
steps (mean and covariance of the ``COVERAGE`` nearest rows) go on until they no
longer change, or ``STEPS`` times; the one of the least determinant is taken.

The h-subsets come from counts on a fixed logarithmic grid of distances, not
from sorting a group, so a source with a third of all rows costs no task more
than any other: every aggregate combines before its shuffle.

Defined results: a null or empty text has no words and fails the base rules; a text
of any length is read as a whole, in n log n; other columns, whatever their names, come
along; a null language or source is a value of its own; repeated rows are judged each on
its own; groups under ``min_rows`` rows pool by language, then over everything,
and if even that is too small only the base rules decide. An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, text_of, words_of

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: Transformed statistics: log mean word length, log symbols and repeated lines in
#: 100 words, share of words in repeated windows.
STATS = [
    "ln(word_chars / CAST(n_words AS DOUBLE))",
    "ln(1 + 100.0 * n_symbols / CAST(n_words AS DOUBLE))",
    "ln(1 + 100.0 * n_dup_lines / CAST(n_words AS DOUBLE))",
    "n_repeat_words / CAST(n_words AS DOUBLE)",
]
#: Least standard deviation of each; a statistic that is constant in the bulk of a
#: group must not turn every other value into an outlier.
FLOORS = [0.10, 0.35, 0.35, 0.10]
P = range(1, 5)
PAIRS = [(i, j) for i in P for j in range(1, i + 1)]
CHI2_4_MEDIAN, CHI2_4_CUTOFF = 3.3566939800, 28.4732600000  # quantiles 0.5 and 0.99999
COVERAGE, STEPS, MIN_ROWS = 0.75, 8, 60
STARTS = (0, 1, 2)  # medians, all rows, directions
GRID_Z, GRID_D = 256.0, 32.0
#: Groups whose estimates are broadcast, at some 250 bytes each.
BROADCAST_GROUPS = 100_000


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at two places or more.

    The windows' hashes are sorted with their positions, so equal ones meet as
    neighbours: n log n for any text.
    """

    def covered(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        hits = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def of(w: Column) -> Column:
        h = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(h, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)))

    return of(words)


def counts(text: Column) -> Column:
    """A struct of COUNTS."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).cast("long").alias("n_repeat_words"),
    ))


def cholesky() -> list[str]:
    """Lower factor of the covariance s with the floors added, as lateral aliases."""
    out = []
    for i, j in PAIRS:
        rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
        s = f"s{i}{j}" + (f" + {FLOORS[i - 1] ** 2!r}" if i == j else "")
        out.append(f"sqrt({s}{rest}) AS l{i}{j}" if i == j else f"({s}{rest}) / l{j}{j} AS l{i}{j}")
    return out


def distance() -> list[str]:
    """Forward substitution: y = L^-1 (z - m), d2 = |y|^2."""
    ys = [f"(z{i} - m{i}{''.join(f' - l{i}{k} * y{k}' for k in range(1, i))}) / l{i}{i} AS y{i}" for i in P]
    return [*ys, f"{' + '.join(f'y{i} * y{i}' for i in P)} AS d2"]


def moments() -> list[str]:
    means = [f"avg(z{i}) AS m{i}" for i in P]
    return means + [f"avg(z{i} * z{j}) - avg(z{i}) * avg(z{j}) AS s{i}{j}" for i, j in PAIRS]


#: Columns of an estimate: centre and lower triangle of the covariance.
ESTIMATE = [f"m{i}" for i in P] + [f"s{i}{j}" for i, j in PAIRS]


def log_determinant() -> str:
    """Of the covariance with the floors added, rounded so that equal estimates tie."""
    return "round(" + " + ".join(f"ln(l{i}{i})" for i in P) + ", 6)"


def directions() -> list[str]:
    """Rows as directions from the medians c: of length 1 in units of the floors, 0 at the medians."""
    far = " + ".join(f"pow((z{i} - c{i}) / {FLOORS[i - 1]}, 2)" for i in P)
    return [f"sqrt({far}) AS far", *(f"(CASE WHEN far > 0 THEN (z{i} - c{i}) / far ELSE 0 END) AS u{i}" for i in P)]


def start_params() -> dict[int, list[str]]:
    """The estimate of each start, as aggregates or expressions over a group's sums."""
    return {
        0: [*(f"c{i} AS m{i}" for i in P), *(f"CAST(0 AS DOUBLE) AS s{i}{j}" for i, j in PAIRS)],
        1: [*(f"a{i} AS m{i}" for i in P), *(f"q{i}{j} - a{i} * a{j} AS s{i}{j}" for i, j in PAIRS)],
        2: [*(f"c{i} AS m{i}" for i in P), *(f"d{i}{j} AS s{i}{j}" for i, j in PAIRS)],
    }


def start_sums() -> list[str]:
    means = [f"avg(z{i}) AS a{i}" for i in P]
    return means + [f"avg(z{i} * z{j}) AS q{i}{j}" for i, j in PAIRS] + [f"avg(u{i} * u{j}) AS d{i}{j}" for i, j in PAIRS]


def starts(z: DataFrame, medians: DataFrame) -> DataFrame:
    """g, start and the estimate that each start begins with."""
    rows = z.join(medians, "g").selectExpr("g", *(f"z{i}" for i in P), *(f"c{i}" for i in P), *directions())
    sums = cut(rows.groupBy("g").agg(*(F.first(f"c{i}").alias(f"c{i}") for i in P), *map(F.expr, start_sums())))
    of = start_params()
    out = [sums.selectExpr("g", f"{k} AS start", *of[k]) for k in STARTS]
    return out[0].unionByName(out[1]).unionByName(out[2])


def grid_quantile(cells: DataFrame, keys: list[str], q: float, name: str) -> DataFrame:
    """Least grid cell at which a share ``q`` of each key's rows is reached. cells: keys, bin."""
    keyed = ", ".join(keys)
    return (
        cells.groupBy(*keys, "bin").count()
        .selectExpr(*keys, "bin", f"sum(count) OVER (PARTITION BY {keyed} ORDER BY bin) AS upto", f"sum(count) OVER (PARTITION BY {keyed}) AS n")
        .where(f"upto >= {q} * n").groupBy(*keys).agg(F.min("bin").alias(name))
    )


def dist_bin(expr: str = "d2") -> str:
    return f"CAST(floor({GRID_D} * ln({expr} + 1e-9)) AS BIGINT) AS bin"


def group_keys(stats: DataFrame, min_rows: int) -> DataFrame:
    """The estimation group of each language and source that has rows to estimate from."""
    sized = stats.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    sized = sized.selectExpr("lang", "source", "n", f"n >= {min_rows} AS own")
    sized = sized.selectExpr("*", "sum(CASE WHEN own THEN 0 ELSE n END) OVER (PARTITION BY lang) AS n_lang")
    sized = sized.selectExpr("lang", "source", f"CASE WHEN own THEN concat('s|', coalesce(lang, ''), '|', lang IS NULL, '|', coalesce(source, ''), '|', source IS NULL) WHEN n_lang >= {min_rows} THEN concat('l|', coalesce(lang, ''), '|', lang IS NULL) ELSE 'all' END AS g")
    return sized


def quality_rules(docs: DataFrame, carry: list[str] | None = None, min_rows: int = MIN_ROWS, steps: int = STEPS, cutoff: float = CHI2_4_CUTOFF) -> DataFrame:
    """Counts, base_failed, d2 (null where no estimate applies) and kept for every row.

    ``carry`` names the columns that come along, untouched, in the struct ``doc``.
    """
    carry = docs.columns if carry is None else carry
    by_name = {c.lower() for c in docs.columns}
    of = lambda c: F.col(c).cast("string") if c in by_name else F.lit(None).cast("string")
    rows = docs.select(F.struct(*carry).alias("doc"), of("lang").alias("lang"), of("source").alias("source"), counts(text_of()).alias("c"))
    stats = cut(rows.select("doc", "lang", "source", "c.*").withColumn("base_failed", F.expr(BASE_FAILED)), codec="zstd")
    keys = cut(group_keys(stats, min_rows))
    z = stats.where("NOT base_failed").select("lang", "source", *(F.expr(f"{e} AS z{i}") for i, e in zip(P, STATS)))
    z = cut(z.alias("z").join(keys.alias("k"), F.expr("z.lang <=> k.lang AND z.source <=> k.source")).select("g", *(f"z{i}" for i in P)))

    cells = z.selectExpr("g", "inline(array(" + ", ".join(f"struct({i} AS k, CAST(floor({GRID_Z} * z{i}) AS BIGINT) AS bin)" for i in P) + "))")
    medians = cut(grid_quantile(cells, ["g", "k"], 0.5, "b").groupBy("g").agg(*(F.max(F.expr(f"CASE WHEN k = {i} THEN b / {GRID_Z} END")).alias(f"c{i}") for i in P)))
    params = cut(starts(z, medians))
    for _ in range(steps):
        d = z.join(params.selectExpr("g", "start", *ESTIMATE, *cholesky()), "g").selectExpr("g", "start", *(f"z{i}" for i in P), *distance())
        # A table of known size, so that where groups are few the rows aren't shuffled for the join.
        bound = cut(grid_quantile(d.selectExpr("g", "start", dist_bin()), ["g", "start"], COVERAGE, "top"))
        inside = d.selectExpr("*", dist_bin()).join(bound, ["g", "start"]).where("bin <= top")
        old, params = params, cut(inside.groupBy("g", "start").agg(*map(F.expr, moments()), F.count("*").alias("h")))
        moved = " OR ".join(f"abs(n.{c} - o.{c}) > 1e-12" for c in ESTIMATE)
        if params.alias("n").join(old.alias("o"), ["g", "start"]).where(moved).isEmpty():
            break
    factors = params.selectExpr("g", "start", "h", *ESTIMATE, *cholesky()).selectExpr("*", f"{log_determinant()} AS size")
    least = factors.groupBy("g").agg(F.min(F.struct("size", "start")).alias("least"))
    factors = cut(factors.join(least, "g").where("start = least.start").drop("least", "start", "size"))
    # Distances are scaled so that the median one is that of a normal distribution.
    mid = grid_quantile(z.join(factors, "g").selectExpr("g", *distance()).selectExpr("g", dist_bin()), ["g"], 0.5, "mid")
    scaled = cut(factors.join(mid, "g").withColumn("scale", F.expr(f"greatest(exp((mid + 1) / {GRID_D}) / {CHI2_4_MEDIAN}, 1.0D)")))
    used = cut(keys.join(scaled, "g").where(f"g <> 'all' OR h >= {COVERAGE} * {min_rows}"))
    if used.count() <= BROADCAST_GROUPS:  # else rows are dealt by group, and adaptive execution splits hot ones
        used = F.broadcast(used)
    out = stats.alias("d").join(used.alias("u"), F.expr("d.lang <=> u.lang AND d.source <=> u.source AND NOT d.base_failed"), "left")
    out = out.select("doc", *COUNTS, "base_failed", "u.*").selectExpr("*", *(f"CASE WHEN base_failed THEN NULL ELSE {e} END AS z{i}" for i, e in zip(P, STATS)))
    out = out.selectExpr("doc", *COUNTS, "base_failed", "scale", *distance()).withColumn("d2", F.expr("d2 / scale"))
    return out.select("doc", *COUNTS, "base_failed", "d2", F.expr(f"NOT base_failed AND coalesce(d2 <= {cutoff}, true)").alias("kept"))
