"""DuckDB SQL that gives the same rows as the queries over whole documents.

Shingles and windows are built with window functions, one row per word, so no
text is held more than once.  Words are ``[^\\x20\\x09-\\x0D]+`` throughout.
"""

from __future__ import annotations

import math

from weirflow.llm.quality_rules import GAMMA, LEAST, MEASURES, SLACK

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP1_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE len(w) >= 5),
f AS (SELECT doc_id, n, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS s FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM f WHERE i <= n - 4 UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, edge.b FROM reach JOIN edge ON reach.y = edge.a),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN size USING (doc_id)
"""

# water level: sources in order of 2 * size / weight; the first that its share does not fill sets the share of all after it
OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce("text", ''), '{WORD}')) AS BIGINT) AS size, md5('11|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
k AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w FROM s),
r AS (SELECT *, row_number() OVER p AS pos, CAST(sum(n) OVER () AS BIGINT) AS t, CAST(coalesce(sum(2 * n) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS f,
  CAST(sum(w) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws FROM k WHERE n > 0 WINDOW p AS (ORDER BY CAST(n AS DOUBLE) / w, source)),
lvl AS (SELECT 3 * t - 2 * f AS a, 2 * ws AS b FROM r WHERE (3 * t - 2 * f) * w <= 4 * n * ws QUALIFY row_number() OVER (ORDER BY pos) = 1),
g AS (SELECT source, n, CASE WHEN n = 0 THEN 0.0 WHEN a * w >= 2 * n * b THEN CAST(2 * n AS DOUBLE) ELSE CAST(a * w AS DOUBLE) / CAST(b AS DOUBLE) END AS target, CASE WHEN n = 0 THEN 0 ELSE least(2 * n, a * w // b) END AS give FROM k LEFT JOIN lvl ON true),
b AS (SELECT d.*, g.n, g.target, g.give, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, n AS source_size, CAST(target AS DOUBLE) AS target, CAST(CASE WHEN n = 0 THEN 0 ELSE give // n * size + greatest(0, least(size, give % n - before)) END AS BIGINT) AS taken FROM b
"""

_BINS = {m: f"CAST(ceil(ln(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE)) / {math.log(GAMMA)!r}) AS BIGINT)" for m, (a, b, _) in MEASURES.items()}
_TWO_SIDED = ", ".join(f"'{m}'" for m, v in MEASURES.items() if v[2])


def _level(name: str, groups: list[str], parent: str | None) -> str:
    """Upper and lower bin per group and measure from the sketch merged over ``groups``, pooled with the parent's."""
    by = "".join(f"{g}, " for g in groups)
    own = f"""{name}_own AS (SELECT {by}measure, total, q50 + 7 * half AS hi, q50 - 7 * half AS lo FROM (SELECT *, greatest({LEAST}, least(q75 - q50, q50 - q25)) AS half FROM (
  SELECT {by}measure, max(total) AS total, min(CASE WHEN upto >= ceil(total * 0.25) THEN bin END) AS q25, min(CASE WHEN upto >= ceil(total * 0.5) THEN bin END) AS q50, min(CASE WHEN upto >= ceil(total * 0.75) THEN bin END) AS q75
  FROM (SELECT {by}measure, bin, sum(n) OVER (PARTITION BY {by}measure) AS total, sum(n) OVER (PARTITION BY {by}measure ORDER BY bin) AS upto FROM (SELECT {by}measure, bin, sum(n) AS n FROM sketch GROUP BY {by}measure, bin)) GROUP BY {by}measure)))"""
    if parent is None:
        return f"{own},\n{name} AS (SELECT measure, hi, lo FROM {name}_own)"
    hi, lo = (f"CAST(floor(CAST(o.total * o.{x} + 50 * p.{x} AS DOUBLE) / (o.total + 50)) AS BIGINT)" for x in ("hi", "lo"))
    on = "".join(f" AND p.{g} IS NOT DISTINCT FROM o.{g}" for g in groups[:-1])
    return f"{own},\n{name} AS (SELECT {''.join(f'o.{g}, ' for g in groups)}o.measure, CASE WHEN o.measure IN ({_TWO_SIDED}) THEN {hi} ELSE least({hi}, p.hi + {SLACK}) END AS hi, {lo} AS lo FROM {name}_own o JOIN {parent} p ON p.measure = o.measure{on})"


_EXPLODED = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {x} AS bin FROM counted WHERE NOT base_failed" for m, x in _BINS.items())
_PASSES = " AND ".join(f"{x} <= max(hi) FILTER (WHERE measure = '{m}')" + (f" AND {x} >= max(lo) FILTER (WHERE measure = '{m}')" if MEASURES[m][2] else "") for m, x in _BINS.items())

OP9_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce("text", '') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, regexp_extract_all(t, '{WORD}') AS w FROM d),
u AS (SELECT rid, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
f AS (SELECT rid, i, CASE WHEN i <= n - 4 THEN concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) END AS s FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, CASE WHEN s IS NOT NULL AND count(*) OVER (PARTITION BY rid, s) > 1 THEN 1 ELSE 0 END AS two FROM f),
cover AS (SELECT rid, max(two) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
rep AS (SELECT rid, CAST(sum(c) AS BIGINT) AS c FROM cover GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
counted AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM (SELECT d.rid, doc_id, lang, source, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines, coalesce(rep.c, 0) AS n_repeat_words FROM d JOIN w USING (rid) JOIN ln USING (rid) LEFT JOIN rep USING (rid))),
sketch AS MATERIALIZED (SELECT lang, source, measure, bin, count(*) AS n FROM ({_EXPLODED}) GROUP BY ALL),
{_level("every", [], None)},
{_level("lang_only", ["lang"], "every")},
{_level("cuts", ["lang", "source"], "lang_only")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE {_PASSES} END AS kept
FROM counted LEFT JOIN cuts ON cuts.lang IS NOT DISTINCT FROM counted.lang AND cuts.source IS NOT DISTINCT FROM counted.source
GROUP BY rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed
"""
