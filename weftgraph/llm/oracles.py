"""DuckDB SQL for the operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from .license_scan import BASE_PHRASES, TEMPLATES
from .quality_rules import BOILERPLATE

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = (
    r"list_transform(regexp_extract_all(COALESCE(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: "
    + _LOWER.format(x="x")
    + ")"
)

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s
  FROM d, LATERAL (SELECT unnest(range(1, greatest(2, len(ws) - 3))) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
comp(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.root FROM comp c JOIN link l ON l.a = c.id)
SELECT c.id AS doc_id, MIN(c.root) AS class_id, (SELECT COUNT(*) FROM link l WHERE l.a = c.id) AS n_links
FROM comp c GROUP BY c.id
"""

_SPACE = r"\x20\x09-\x0D"
OP5 = rf"""
WITH d AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[{_SPACE}]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS ls
  FROM (SELECT doc_id, COALESCE(text, '') AS text FROM documents) q),
t AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)),
r AS (SELECT doc_id, i FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, g) AS c FROM t) q WHERE c > 1),
c AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
l AS (
  SELECT doc_id, line, length(line) AS chars, len(regexp_extract_all(line, '[^{_SPACE}]+')) AS n,
    len(regexp_extract_all(line, '[|»>·•]')) AS seps, len(regexp_extract_all(line, '[#*$%&|<>!]')) AS syms
  FROM (SELECT doc_id, unnest(ls) AS line FROM d) q),
f AS (
  SELECT doc_id, SUM(chars) AS total, SUM(CASE WHEN (seps >= 3 AND 3 * seps >= n)
      OR (chars <= 200 AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') AND n <= 12)
      OR (NOT regexp_matches(line, '[.!?:;,…。！？]') AND n >= 20) OR (syms >= 3 AND 4 * syms > n) THEN chars ELSE 0 END) AS lost
  FROM l GROUP BY doc_id),
b AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(COALESCE(c.n, 0) AS BIGINT) AS n_repeat_words, COALESCE(total, 0) AS total, COALESCE(lost, 0) AS lost
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * total AS kept
FROM b
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
u AS (
  SELECT *, COUNT(*) OVER (PARTITION BY w) - COUNT(*) OVER (PARTITION BY doc_id, w) AS c1,
    LAG(w) OVER (PARTITION BY doc_id ORDER BY i) AS p, COUNT(*) OVER () - COUNT(*) OVER (PARTITION BY doc_id) AS others FROM t),
b AS (
  SELECT *, LAG(c1) OVER (PARTITION BY doc_id ORDER BY i) AS cp,
    CASE WHEN p IS NULL THEN 0 ELSE COUNT(*) OVER (PARTITION BY p, w) - COUNT(*) OVER (PARTITION BY doc_id, p, w) END AS c2 FROM u),
s AS (
  SELECT doc_id, COUNT(*) AS n, COUNT(*) FILTER (c2 > 0 OR (p IS NULL AND c1 > 0)) AS found,
    SUM(CASE WHEN c2 > 0 THEN ln(c2 / cp::DOUBLE)
      ELSE ln(greatest(c1, 1) / greatest(1, others)::DOUBLE) + CASE WHEN p IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END END) AS x
  FROM b GROUP BY doc_id)
SELECT doc_id, COALESCE(n, 0) AS n_words, COALESCE(found, 0) AS n_found, ROUND(COALESCE(x, 0.0), 3) AS log_score, ROUND(x / n, 4) AS mean_log_score
FROM documents LEFT JOIN s USING (doc_id)
"""

_TEMPLATES = ", ".join(f"({i}, '{label}', {i < len(BASE_PHRASES)}, string_split('{t}', ' '))" for i, (t, label) in enumerate(BASE_PHRASES + TEMPLATES))
OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
t AS (
  SELECT doc_id, i - 1 AS spot, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c, ws[i + 3] AS d
  FROM d, LATERAL (SELECT unnest(range(1, len(ws))) AS i)),
tmpl(template, label, base, tw) AS (VALUES {_TEMPLATES}),
tp AS (
  SELECT template, label, base, len(tw) AS size, i - 1 AS place, tw[i] AS a, tw[i + 1] AS b, tw[i + 2] AS c, tw[i + 3] AS d
  FROM tmpl, LATERAL (SELECT unnest(range(1, CASE WHEN base THEN len(tw) ELSE len(tw) - 2 END)) AS i)),
v AS (SELECT t.doc_id, tp.template, tp.label, tp.base, tp.size, t.spot - tp.place AS diagonal, tp.place, t.spot
  FROM t JOIN tp ON t.a = tp.a AND t.b = tp.b AND (tp.base OR (t.c = tp.c AND t.d = tp.d))),
g AS (SELECT doc_id, template, label, base, size, diagonal, COUNT(*) AS votes, MIN(spot) AS first, MAX(spot) AS last FROM v GROUP BY ALL),
m AS (SELECT *, CASE WHEN COALESCE(diagonal - LAG(diagonal) OVER w > 3, true) THEN 1 ELSE 0 END AS apart FROM g WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
n AS (SELECT *, CASE WHEN base THEN diagonal ELSE SUM(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) END AS span FROM m),
s AS (
  SELECT doc_id, label, base, size, least(1.0::DOUBLE, SUM(votes) / (size - CASE WHEN base THEN 1 ELSE 3 END)::DOUBLE) AS coverage, MIN(first) AS first, MAX(last) AS last
  FROM n GROUP BY doc_id, template, label, base, size, span),
h AS (SELECT *, CASE WHEN base THEN coverage = 1 ELSE coverage >= 0.6 AND last + 4 - first <= 1.5 * size END AS holds FROM s),
r AS (
  SELECT doc_id, COUNT(*) FILTER (base AND holds) AS n_base, MIN(first) FILTER (base AND holds) AS first_word, MAX(first) FILTER (base AND holds) AS last_word,
    array_to_string(list_sort(list_distinct(COALESCE(list(label) FILTER (base AND holds), []))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(COALESCE(list(label) FILTER (holds), []))), ',') AS labels,
    MAX(coverage) FILTER (NOT base OR holds) AS score
  FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(n_base, 0) AS n_base, first_word, last_word,
  COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels, ROUND(COALESCE(score, 0.0), 6) AS score
FROM d LEFT JOIN r USING (doc_id)
"""

ORACLE_SQL = {"op2_jaccard_join": OP2, "op3_license_scan": OP3, "op5_quality_rules": OP5, "op10_lm_scoring": OP10}
