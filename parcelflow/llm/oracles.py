"""DuckDB SQL with the same results as the queries, where SQL can express them."""

from __future__ import annotations

import math

from parcelflow.llm import line_dedup, quality, sharding

W = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"


def line_dedup_sql(docs: str = "documents", least: int = line_dedup.NEAR_CHARS) -> str:
    return f"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {docs} WHERE text IS NOT NULL),
p AS (SELECT * FROM l WHERE regexp_matches(line, '{HAS_WORD}')),
d AS (SELECT line, min(row(doc_id, pos)) AS fst FROM p GROUP BY line),
k AS (SELECT line, fst, length(line) - x AS m, side, CASE side WHEN 0 THEN left(line, (length(line) - x) // 2) ELSE right(line, length(line) - x - (length(line) - x) // 2) END AS half
      FROM d, (VALUES (0), (1)) AS a(x), (VALUES (0), (1)) AS b(side) WHERE length(line) >= {least}),
near AS (SELECT DISTINCT a.line FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.half = b.half WHERE b.fst < a.fst AND abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= 1),
flags AS (SELECT p.doc_id, p.pos, near.line IS NOT NULL AND row(p.doc_id, p.pos) = d.fst AS near FROM p JOIN d USING (line) LEFT JOIN near USING (line) WHERE near.line IS NOT NULL OR row(p.doc_id, p.pos) > d.fst),
o AS (SELECT l.doc_id, count(*) AS n_lines, count(f.pos) AS n_dropped, count(*) FILTER (f.near) AS n_near, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (f.pos IS NULL), '') AS text FROM l LEFT JOIN flags f USING (doc_id, pos) GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_near, 0) AS n_near, sha256(o.text) AS text_sha256 FROM {docs} t LEFT JOIN o USING (doc_id)"""


def quality_with(docs: str = "documents", risk: float = quality.RISK, delta: float = quality.DELTA) -> str:
    """Common table expressions that end in q: one row for each document with the features and the verdict."""
    rate, level = risk, f"{delta!r} / n_strata"
    grid = ", ".join(f"({c})" for c in quality.GRID)
    parts = ", ".join(f"CASE WHEN {b} > 0 THEN (1000 * {a}) // {b} * 100 // {unit} ELSE 0 END" for a, b, unit in quality.RATIOS.values())
    return f"""
w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{W}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{HAS_WORD}')) AS l FROM {docs}),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + x) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), (VALUES (0), (1), (2), (3), (4)) AS v(x) GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(lang, '') AS stratum, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{GAP}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(text, '\\P{{Lu}}+', '', 'g'))::BIGINT AS n_capitals, length(regexp_replace(text, '[^!?]+', '', 'g'))::BIGINT AS n_marks FROM w LEFT JOIN r USING (doc_id)),
told AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
s AS (SELECT doc_id, stratum, greatest({parts}) AS score FROM f),
v AS (SELECT s.*, good FROM s JOIN told USING (doc_id)),
n AS (SELECT stratum, count(*) AS n_good, count(*) OVER () AS n_strata FROM f JOIN told USING (doc_id) WHERE good GROUP BY stratum),
terms AS (SELECT stratum, k, n_strata, sum(exp(lgamma(n_good + 1) - lgamma(k + 1) - lgamma(n_good - k + 1) + k * {math.log(rate)!r} + (n_good - k) * {math.log1p(-rate)!r})) OVER (PARTITION BY stratum ORDER BY k) AS cdf
          FROM (SELECT *, unnest(generate_series(0, floor(n_good * {rate!r})::BIGINT)) AS k FROM n)),
allowed AS (SELECT stratum, max(k) AS allowed FROM terms WHERE cdf <= {level} GROUP BY stratum),
o AS (SELECT stratum, cutoff, count(*) FILTER (good) AS n_false, count(*) FILTER (NOT good) AS n_bad FROM v JOIN (VALUES {grid}) AS c(cutoff) ON score > cutoff GROUP BY ALL),
best AS (SELECT stratum, cutoff FROM o JOIN allowed USING (stratum) WHERE n_false <= allowed AND n_bad > {quality.GAIN} * n_false
         QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY n_bad - {quality.GAIN} * n_false DESC, cutoff DESC) = 1),
bad AS (SELECT DISTINCT doc_id FROM s JOIN best USING (stratum) WHERE score > cutoff),
q AS (SELECT f.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM f LEFT JOIN bad USING (doc_id))"""


def sharding_sql(docs: str = "documents", limit: int = sharding.LIMIT) -> str:
    """Every prefix of every path is summed up, and each row takes its shortest that fits. Rows of one path that don't fit are paged."""
    bits = lambda c: f"lpad(bin(('0x' || substr(md5({c}), 1, 16))::UBIGINT), 64, '0')"
    return f"""
WITH p AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, {bits("coalesce(doc_id::VARCHAR, '')")} || {bits("coalesce(text, '')")} AS path, row_number() OVER () AS row_no FROM {docs}),
u AS (SELECT path, sum(n_bytes) AS b, count(*) AS n, any_value(n_bytes) AS each FROM p GROUP BY path),
x AS (SELECT u.*, d, sum(b) OVER w AS all_b, sum(n) OVER w AS all_n FROM u, range(0, {sharding.BITS + 1}) AS t(d) WINDOW w AS (PARTITION BY d, left(path, d))),
s AS (SELECT path, min(d) FILTER (all_b <= {limit} OR all_n = 1) AS depth FROM x GROUP BY path)
SELECT doc_id, n_bytes, left(path, coalesce(depth, {sharding.BITS})) AS shard, coalesce(depth, {sharding.BITS})::BIGINT AS depth,
       CASE WHEN depth IS NULL THEN (row_number() OVER (PARTITION BY path ORDER BY row_no) - 1) // greatest(1, {limit} // n_bytes) ELSE 0 END::BIGINT AS page FROM p JOIN s USING (path)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op9_sharding": sharding_sql(),
        "op3_line_dedup": line_dedup_sql(),
        "op10_quality": f"WITH {quality_with()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q",
    }
