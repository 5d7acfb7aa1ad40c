"""SQL for the operators that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from . import decontaminate as dc
from . import license_scan as ls
from . import log_templates as lt
from . import quality_rules as qr
from . import secret_scan as ss
from .common import LOWER, NOT_ALNUM, SPACE, UPPER

WORDS = f"list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '')"
ALNUM = f"list_filter(string_split_regex(translate(t, '{UPPER}', '{LOWER}'), '{NOT_ALNUM}'), lambda x: x <> '')"
ROWS = "d AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM documents)"


def _quantile(name: str, source: str, keys: str, q: float, out: str) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT {keys}, min(bin) AS {out} FROM (SELECT {keys}, bin, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total "
        f"FROM (SELECT {keys}, bin, count(*) AS n FROM {source} GROUP BY ALL)) WHERE upto >= {q} * total GROUP BY {keys})"
    )


def quality() -> str:
    P, pairs = qr.P, qr.PAIRS
    m, s = ", ".join(f"m{i}" for i in P), ", ".join(f"s{i}{j}" for i, j in pairs)
    z, chol, dist = ", ".join(f"z{i}" for i in P), ", ".join(qr.cholesky()), ", ".join(qr.distance())
    zs = ", ".join(f"CASE WHEN base_failed THEN NULL ELSE {e} END AS z{i}" for i, e in zip(P, qr.STATS, strict=True))
    parts = [
        ROWS,
        f"w AS MATERIALIZED (SELECT rid, doc_id, lang, source, t, {WORDS} AS w FROM d)",
        "tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)))",
        "rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE k > 1) GROUP BY 1)",
        "c AS MATERIALIZED (SELECT w.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, "
        "CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w) w LEFT JOIN rep ON rep.rid = w.rid)",
        f"st AS MATERIALIZED (SELECT *, {zs} FROM (SELECT *, {qr.BASE_FAILED} AS base_failed FROM c))",
        f"g0 AS (SELECT lang, source, count(*) AS n, count(*) >= {qr.MIN_ROWS} AS own FROM st WHERE NOT base_failed GROUP BY 1, 2)",
        f"g1 AS MATERIALIZED (SELECT lang, source, CASE WHEN own THEN concat_ws('|', 's', coalesce(lang, ''), lang IS NULL, coalesce(source, ''), source IS NULL) WHEN sum(CASE WHEN own THEN 0 ELSE n END) OVER (PARTITION BY lang) >= {qr.MIN_ROWS} THEN concat_ws('|', 'l', coalesce(lang, ''), lang IS NULL) ELSE 'all' END AS g FROM g0)",
        f"z AS MATERIALIZED (SELECT g, {z} FROM st JOIN g1 ON st.lang IS NOT DISTINCT FROM g1.lang AND st.source IS NOT DISTINCT FROM g1.source WHERE NOT base_failed)",
        "cells AS (" + " UNION ALL ".join(f"SELECT g, {i} AS k, CAST(floor({qr.GRID_Z} * z{i}) AS BIGINT) AS bin FROM z" for i in P) + ")",
        _quantile("med", "cells", "g, k", 0.5, "b"),
        "mc AS MATERIALIZED (SELECT g, " + ", ".join(f"max(CASE WHEN k = {i} THEN b / {qr.GRID_Z} END) AS c{i}" for i in P) + " FROM med GROUP BY g)",
        f"sm AS MATERIALIZED (SELECT g, {', '.join(f'any_value(c{i}) AS c{i}' for i in P)}, {', '.join(qr.start_sums())} FROM (SELECT z.g, {z}, {', '.join(f'c{i}' for i in P)}, {', '.join(qr.directions())} FROM z JOIN mc USING (g)) GROUP BY g)",
        "p0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT g, {k} AS start, {', '.join(e)} FROM sm" for k, e in qr.start_params().items()) + ")",
    ]
    for step in range(qr.STEPS):
        parts += [
            f"f{step} AS MATERIALIZED (SELECT g, start, {m}, {s}, {chol} FROM p{step})",
            f"e{step} AS MATERIALIZED (SELECT *, {qr.dist_bin()} FROM (SELECT g, start, {z}, {dist} FROM z JOIN f{step} USING (g)))",
            _quantile(f"b{step}", f"e{step}", "g, start", qr.COVERAGE, "top"),
            f"p{step + 1} AS MATERIALIZED (SELECT g, start, {', '.join(qr.moments())}, count(*) AS h FROM e{step} JOIN b{step} USING (g, start) WHERE bin <= top GROUP BY g, start)",
        ]
    n = qr.STEPS
    parts += [
        f"fa AS MATERIALIZED (SELECT g, start, h, {m}, {s}, {chol} FROM p{n})",
        f"ff AS MATERIALIZED (SELECT * EXCLUDE start FROM fa QUALIFY row_number() OVER (PARTITION BY g ORDER BY {qr.log_determinant()}, start) = 1)",
        f"ee AS (SELECT g, {qr.dist_bin()} FROM (SELECT g, {dist} FROM z JOIN ff USING (g)))",
        _quantile("mm", "ee", "g", 0.5, "mid"),
        f"u AS MATERIALIZED (SELECT lang, source, ff.*, greatest(exp((mid + 1) / {qr.GRID_D}) / {qr.CHI2_4_MEDIAN}, 1.0) AS scale FROM g1 JOIN ff USING (g) JOIN mm USING (g) WHERE g <> 'all' OR h >= {qr.COVERAGE} * {qr.MIN_ROWS})",
    ]
    final = f"SELECT doc_id, {', '.join(qr.COUNTS)}, base_failed, NOT base_failed AND coalesce(d2 / scale <= {qr.CHI2_4_CUTOFF}, true) AS kept FROM (SELECT st.*, scale, {dist} FROM st LEFT JOIN u ON st.lang IS NOT DISTINCT FROM u.lang AND st.source IS NOT DISTINCT FROM u.source AND NOT base_failed)"
    return f"WITH {', '.join(parts)} {final}"


def secrets() -> str:
    quote = lambda p: p.replace("'", "''")
    each = []
    for k, (kind, pattern, group, least) in enumerate(ss.STRONG + ss.WEAK):
        test = f"regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]')" if kind == "blob" else f"length(x) >= {least}"
        each.append(
            f"SELECT rid, {k} AS kord, '{kind}' AS kind, '{ss.ROLE[kind]}' AS role, e - length(m) AS s, e FROM (SELECT rid, m, x, sum(length(m) + length(gap)) OVER (PARTITION BY rid ORDER BY i) AS e "
            f"FROM (SELECT rid, unnest(ms) AS m, unnest(xs) AS x, unnest(gs[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (SELECT rid, regexp_extract_all(t, '{quote(pattern)}', 0) AS ms, regexp_extract_all(t, '{quote(pattern)}', {group}) AS xs, string_split_regex(t, '{quote(pattern)}') AS gs FROM d))) WHERE {test}"
        )
    gap = f"greatest(a.s - b.e, b.s - a.e) BETWEEN 0 AND {ss.SCOPE}"
    strong = len(ss.STRONG)
    return f"""WITH {ROWS}, p AS MATERIALIZED ({' UNION ALL '.join(each)}),
        l AS (SELECT a.rid, a.kord, a.kind, a.s, a.e, a.role, bool_or(b.role = 'id') AS i, bool_or(b.role = 'secret') AS c FROM p a JOIN p b ON a.rid = b.rid AND a.role <> b.role AND {gap} WHERE a.kord >= {strong} GROUP BY ALL),
        k AS (SELECT rid, kord, kind, s, e FROM p WHERE kord < {strong} UNION ALL SELECT rid, kord, kind, s, e FROM l WHERE (role = 'id' AND c) OR (role = 'secret' AND i) OR (role = 'endpoint' AND i AND c)),
        r AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, kord, e) FILTER (kord < {strong}) AS base, string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, kord, e) AS spans FROM k GROUP BY 1)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r ON r.rid = d.rid"""


def repeats() -> str:
    return f"""WITH {ROWS}, w AS MATERIALIZED (SELECT rid, doc_id, {WORDS} AS w FROM d),
        win AS (SELECT rid, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
        gone AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS p FROM win WHERE k > 1),
        kept AS (SELECT x.rid, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w) x ANTI JOIN gone ON gone.rid = x.rid AND gone.p = x.p GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.rid = w.rid"""


def leaks() -> str:
    return f"""WITH {ROWS}, w AS MATERIALIZED (SELECT rid, doc_id, {ALNUM} AS w FROM d),
        b AS (SELECT item_id, w, least(len(w), {dc.N}) AS n FROM (SELECT item_id, {ALNUM} AS w FROM (SELECT item_id, coalesce(text, '') AS t FROM benchmark)) WHERE len(w) > 0),
        g AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
        dg AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w CROSS JOIN (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
        h AS MATERIALIZED (SELECT rid, i, dg.n, item_id FROM dg JOIN g ON g.n = dg.n AND g.gram = dg.gram),
        x AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
        y AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN x ON x.rid = w.rid LEFT JOIN y ON y.rid = w.rid"""


def templates() -> str:
    mask = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
    words = f"list_filter(string_split_regex(regexp_replace(line, '{mask}', '{lt.FIELD}', 'g'), '{SPACE}'), lambda x: x <> '')"
    need = f"CASE WHEN max(n) < {lt.FEW_WORDS} THEN {lt.SHORT_TIMES * lt.MIN_DOCS} ELSE {lt.MIN_DOCS} END"
    runs = f"list_transform(range(least(n, {lt.PARTS})), lambda j: array_to_string(w[1 + j * n // least(n, {lt.PARTS}):(j + 1) * n // least(n, {lt.PARTS})], ' '))"
    parts = [
        "d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)",
        f"a AS MATERIALIZED (SELECT rid, t, pos, {words} AS w FROM (SELECT rid, t, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d))",
        "b AS MATERIALIZED (SELECT rid, t, pos, w, len(w) AS n, array_to_string(w, ' ') AS template FROM a WHERE len(w) > 0)",
        "lines AS MATERIALIZED (SELECT *, row_number() OVER x AS place, coalesce(lag(template) OVER x, '') AS before, coalesce(lead(template) OVER x, '') AS after, sum(n) OVER (PARTITION BY rid) AS total FROM b WINDOW x AS (PARTITION BY rid ORDER BY pos))",
        f"eq AS MATERIALIZED (SELECT template FROM lines GROUP BY 1 HAVING count(DISTINCT t) >= {need})",
        "l0 AS MATERIALIZED (SELECT *, concat(n, '/') AS leaf FROM lines WHERE template NOT IN (SELECT template FROM eq))",
    ]
    for k in range(lt.LEAD):
        parts += [
            f"br{k} AS MATERIALIZED (SELECT leaf, w[{k + 1}] AS word FROM l{k} GROUP BY 1, 2 HAVING count(*) >= {lt.MIN_DOCS})",
            f"l{k + 1} AS MATERIALIZED (SELECT l{k}.* EXCLUDE leaf, concat(l{k}.leaf, CASE WHEN br{k}.leaf IS NULL THEN '*' ELSE concat('=', word) END, '/') AS leaf FROM l{k} LEFT JOIN br{k} ON br{k}.leaf = l{k}.leaf AND word IS NOT DISTINCT FROM w[{k + 1}])",
        ]
    left, keyed = f"l{lt.LEAD}", []
    for r, share in enumerate(lt.SHARES):
        parts += [
            f"ex{r} AS MATERIALIZED (SELECT rid, pos, leaf, unnest(range(len(p))) AS i, unnest(p) AS h FROM (SELECT rid, pos, leaf, {runs} AS p FROM {left}))",
            f"of{r} AS MATERIALIZED (SELECT leaf, i, h FROM (SELECT leaf, i, h, count(*) AS k FROM ex{r} GROUP BY ALL) JOIN (SELECT leaf, count(*) AS lines FROM {left} GROUP BY 1) USING (leaf) WHERE k >= {lt.MIN_DOCS} AND k >= {share} * lines)",
            f"co{r} AS MATERIALIZED (SELECT rid, pos, count(*) AS constants, string_agg(concat(i, ':', h), chr(10) ORDER BY i) AS mark FROM ex{r} JOIN of{r} USING (leaf, i, h) GROUP BY 1, 2)",
            f"ne{r} AS MATERIALIZED (SELECT x.*, concat(leaf, chr(10), mark) AS key{r} FROM {left} x JOIN co{r} ON co{r}.rid = x.rid AND co{r}.pos = x.pos WHERE constants >= {lt.SAME} * least(n, {lt.PARTS}))",
            f"ke{r} AS MATERIALIZED (SELECT key{r} FROM ne{r} GROUP BY 1 HAVING count(DISTINCT t) >= {need})",
            f"le{r} AS MATERIALIZED (SELECT * EXCLUDE key{r} FROM ne{r} WHERE key{r} NOT IN (SELECT key{r} FROM ke{r}))",
        ]
        keyed.append(f"SELECT t, pos, place, n, total, before, after, concat('g{r}', chr(10), key{r}) AS key FROM ne{r} WHERE key{r} IN (SELECT key{r} FROM ke{r})")
        left = f"le{r}"
    recurs = lambda name, source: f"{name} AS MATERIALIZED (SELECT key FROM {source} GROUP BY 1 HAVING count(DISTINCT t) >= {need} AND least(count(DISTINCT before), count(DISTINCT after)) >= {lt.VARIED} * count(DISTINCT t))"
    parts += [
        f"met AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT t, pos, place, n, total, before, after, template AS key FROM lines WHERE template IN (SELECT template FROM eq) UNION ALL {' UNION ALL '.join(keyed)}))",
        "run AS MATERIALIZED (SELECT *, CASE WHEN lag(place) OVER x = place - 1 THEN lag(key) OVER x ELSE before END AS above, CASE WHEN lead(place) OVER x = place + 1 THEN lead(key) OVER x ELSE after END AS below, place - row_number() OVER x AS run FROM met WINDOW x AS (PARTITION BY t ORDER BY place))",
        "blk AS MATERIALIZED (SELECT * REPLACE (first_value(before) OVER x AS before, last_value(after) OVER x AS after) FROM run WINDOW x AS (PARTITION BY t, run ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
        "pa AS MATERIALIZED (SELECT * REPLACE (CASE before WHEN '' THEN concat(chr(10), t) ELSE before END AS before, CASE after WHEN '' THEN concat(chr(10), t) ELSE after END AS after) FROM blk)",
        recurs("re1", "pa"),
        "fl AS MATERIALIZED (SELECT * FROM pa WHERE key IN (SELECT key FROM re1))",
        "kd AS MATERIALIZED (SELECT key, count(DISTINCT t) AS docs FROM fl GROUP BY 1)",
        *(f"us_{side} AS MATERIALIZED (SELECT key, {side} FROM (SELECT key, {side}, count(DISTINCT t) AS k FROM fl GROUP BY 1, 2) JOIN kd USING (key) WHERE k >= {lt.VARIED} * docs)" for side in ("above", "below")),
        "sq AS MATERIALIZED (SELECT fl.*, a.key IS NOT NULL OR b.key IS NOT NULL AS fixed FROM fl LEFT JOIN us_above a ON a.key = fl.key AND a.above = fl.above LEFT JOIN us_below b ON b.key = fl.key AND b.below = fl.below)",
        f"lf AS MATERIALIZED (SELECT * FROM sq WHERE t IN (SELECT t FROM sq GROUP BY t HAVING sum(CASE WHEN fixed THEN n ELSE 0 END) <= {lt.MOST} * max(total)))",
        recurs("re2", "lf"),
        "gone AS MATERIALIZED (SELECT t, list(DISTINCT pos) AS drop FROM lf WHERE key IN (SELECT key FROM re2) GROUP BY 1)",
    ]
    kept = "array_to_string(list_transform(list_filter(list_zip(string_split(t, chr(10)), range(len(string_split(t, chr(10))))), lambda x: NOT list_contains(drop, x[2])), lambda x: x[1]), chr(10))"
    return f"WITH {', '.join(parts)} SELECT doc_id, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(len(drop), 0) AS BIGINT) AS n_dropped, sha256(CASE WHEN drop IS NULL THEN t ELSE {kept} END) AS kept_sha256 FROM d LEFT JOIN gone USING (t)"


def licenses() -> str:
    at = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS start, '{label}' AS label FROM (SELECT rid, w, unnest(range(1, len(w) - {len(p.split()) - 2})) AS i FROM w) WHERE array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}'" for p, label in ls.PHRASES
    )
    values = ", ".join(f"('{k}', {ls.size_class(len(t.split()))}, {ls.needed(len(set(t.split())), ls.THRESHOLD)}, {sorted(set(t.split()))!r})" for k, t in sorted(ls.TEMPLATES.items()))
    return f"""WITH {ROWS}, w AS MATERIALIZED (SELECT rid, doc_id, {ALNUM} AS w FROM d), pl AS MATERIALIZED ({at}),
        tp(label, c, need, ws) AS (VALUES {values}),
        bl AS MATERIALIZED (SELECT rid, c, list_distinct(w[k * c + 1:k * c + 2 * c]) AS b FROM (SELECT rid, w, c, unnest(range((len(w) + c - 1) // c)) AS k FROM w CROSS JOIN (SELECT DISTINCT c FROM tp))),
        f AS (SELECT rid, label, len(list_intersect(b, ws)) / len(ws) AS score FROM bl JOIN tp ON tp.c = bl.c AND len(list_intersect(b, ws)) >= need),
        p1 AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pl GROUP BY 1),
        al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM pl UNION SELECT rid, label FROM f) GROUP BY 1),
        sc AS (SELECT rid, max(score) AS best FROM f GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
        FROM w LEFT JOIN p1 ON p1.rid = w.rid LEFT JOIN al ON al.rid = w.rid LEFT JOIN sc ON sc.rid = w.rid"""


def all_sql() -> dict[str, str]:
    return {
        "op1_quality_mcd": quality(),
        "op3_secret_links": secrets(),
        "op4_debruijn_dedup": repeats(),
        "op6_decontaminate": leaks(),
        "op9_log_templates": templates(),
        "op10_license_join": licenses(),
    }
