"""DuckDB SQL for the queries over source files, prompts and snippets, written from the tables and not from the files."""

from __future__ import annotations

from .operators.resolve import PROMPT_PATTERNS, PROMPT_STOP
from .oracles import ORACLE_SQL as _GRAPH_SQL
from .oracles import _q, _tokens
from .sources.rendered import FOLDERS, PARTS_PER_FILE, STYLES

_CALLS = """
c AS (SELECT DISTINCT s, t FROM (
    SELECT l_partkey AS s, LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS t
    FROM lineitem WHERE l_returnflag = 'R') x WHERE t IS NOT NULL AND s <> t)"""


def _written(language: str) -> str:
    """What extraction must find: each part as a function of its file, each call, and an import for each pair of files."""
    style = STYLES[language]
    owned = f"CASE WHEN pk % 2 = 1 THEN {style.odd_owned} ELSE {style.even_owned} END"
    kind = "include" if language == "c" else "imports"
    first_of_folder = f"(SELECT MIN(z.n) FROM p z WHERE z.n % {FOLDERS} = m % {FOLDERS})" if language == "go" else "m"
    extra = style.odd.count("\n") + 1, style.even.count("\n") + 1
    fixed = len([part for part in (style.head, style.middle, style.end)])
    classes = f"UNION ALL SELECT 'class', path || '::Mod' || n, 'Mod' || n FROM (SELECT DISTINCT n, path FROM p) k" if style.has_class else ""
    return f"""WITH {_CALLS},
k AS (SELECT p_partkey AS pk, p_partkey // {PARTS_PER_FILE} AS n FROM part),
p AS (SELECT pk, n, 'src/pkg' || (n % {FOLDERS}) || '/Mod' || n || '{style.ending}' AS path,
    CASE WHEN {owned} THEN 'Mod' || n || '.f' || pk ELSE 'f' || pk END AS name FROM k),
i AS (SELECT DISTINCT a.n, b.n AS m FROM c JOIN k a ON a.pk = c.s JOIN k b ON b.pk = c.t WHERE a.n <> b.n),
l AS (SELECT n, greatest(1, COUNT(*)) AS lines FROM i GROUP BY n),
o AS (SELECT n, path, COUNT(*) FILTER (pk % 2 = 1) AS odds, COUNT(*) FILTER (pk % 2 = 0) AS evens FROM p GROUP BY n, path)
SELECT 'file' AS type, path AS first, 'loc ' || (COALESCE(lines, 1) + {fixed} + greatest(1, {extra[0]} * odds) + greatest(1, {extra[1]} * evens)) AS second FROM o LEFT JOIN l USING (n)
UNION ALL SELECT 'function', path || '::' || name, name FROM p {classes}
UNION ALL SELECT 'calls', a.path || '::' || a.name, b.path || '::' || b.name FROM c JOIN p a ON a.pk = c.s JOIN p b ON b.pk = c.t
UNION ALL SELECT DISTINCT '{kind}', a.path, b.path FROM (SELECT n, {first_of_folder} AS m FROM i) j
  JOIN (SELECT DISTINCT n, path FROM p) a ON a.n = j.n JOIN (SELECT DISTINCT n, path FROM p) b ON b.n = j.m WHERE a.path <> b.path"""


_STOP = ", ".join(f"'{w}'" for w in PROMPT_STOP)
_PROMPT = "concat('Please rename ', replace(role, 's', '_S'), ' and `fix me` in pkg.mod( now: ', text)"
_NAMED = " UNION ALL ".join(
    "SELECT id, {k} * 100000 + generate_subscripts(l, 1) AS spot, unnest(l) AS hint, true AS strong FROM (SELECT id, regexp_extract_all(text, '{p}', 1) AS l FROM pr) q{k}".format(
        k=k, p=p.replace("'", "''")
    )
    for k, p in enumerate(PROMPT_PATTERNS)
)
_HINTS = f"""w AS (SELECT id, list_filter(regexp_split_to_array(text, '\\W+'), lambda x: length(x) >= 3 AND regexp_matches(x, '^[A-Za-z_]') AND lower(x) NOT IN ({_STOP})) AS l FROM pr),
      h AS ({_NAMED} UNION ALL
        SELECT id, 900000 + generate_subscripts(l, 1), unnest(l), NULL FROM w),
      g AS (SELECT h.id, spot, trim(hint) AS hint, COALESCE(strong, len(w.l) <= 3 OR regexp_matches(hint, '_|[a-z][A-Z]')) AS strong FROM h JOIN w USING (id)),
      hints AS (SELECT id, arg_min(hint, spot) AS hint, bool_or(strong) AS strong FROM g WHERE length(hint) >= 2 AND lower(hint) NOT IN ({_STOP}) GROUP BY id, lower(hint))"""
_PROMPTS = """pr AS (SELECT t.id, CASE k % 5 WHEN 0 THEN 'rename ' || name WHEN 1 THEN '`' || replace(name, '_', ' ') || '`' WHEN 2 THEN 'change ' || regexp_replace(name, '_[0-9]+$', '')
    WHEN 3 THEN 'What does ' || replace(file, '/', '.') || '.' || name || '( do' ELSE 'hello' END || ', as said: ' || t.text AS text
  FROM (SELECT DISTINCT ON (id) concat_ws(':', conv_id, turn) AS id, (conv_id * 31 + turn * 7) % 200 AS k, text FROM conversations WHERE text IS NOT NULL) t JOIN cg_sym ON pk = k)"""
_SCORED = _GRAPH_SQL["r3_score_symbols"]

ORACLE_SQL = {
    **{f"x{k}_{language}": _written(language) for k, language in enumerate(("python", "c", "java", "go", "rust", "csharp", "javascript"), 1)},
    "j12_enclosing": """WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a, 20 + o_orderkey % 10 * 20 AS w FROM orders),
      c AS (SELECT DISTINCT o_custkey, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS day, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
      SELECT CAST(c.o_custkey AS VARCHAR) AS file, CAST(c.day AS INT) AS "at", CAST(l_partkey AS VARCHAR) AS name,
        (list(CAST(o_orderkey AS VARCHAR) ORDER BY w, CAST(o_orderkey AS VARCHAR)))[1] AS caller
      FROM c JOIN o ON o.o_custkey = c.o_custkey AND a <= c.day AND c.day < a + w GROUP BY ALL""",
    "r2_prompt_hints": f"""WITH pr AS (SELECT DISTINCT ON (id) id, text FROM (SELECT concat_ws(':', conv_id, turn) AS id, {_PROMPT} AS text FROM conversations WHERE text IS NOT NULL) q),
      {_HINTS} SELECT * FROM hints""",
    "r4_prompts": _q(f"""SELECT prompt, CASE WHEN best IS NULL THEN 'none' WHEN top < 4 THEN 'unclear' WHEN top < 12 AND top - best[2].score < 1 THEN 'ambiguous' ELSE 'match' END AS outcome,
        CASE WHEN top >= 12 OR top >= 4 AND NOT COALESCE(top - best[2].score < 1, false) THEN best[1].id END AS id,
        CASE WHEN top >= 12 OR top >= 4 AND NOT COALESCE(top - best[2].score < 1, false) THEN top END AS score,
        CASE WHEN top < 4 THEN array_to_string(list_transform(best[:3], lambda b: b.whole), ', ')
          WHEN top < 12 AND top - best[2].score < 1 THEN array_to_string(list_transform(best[:4], lambda b: b.whole), ', ') END AS suggestions
      FROM (SELECT pr.id AS prompt, best, best[1].score AS top FROM pr LEFT JOIN few ON few.id = pr.id) j""", f"""{_PROMPTS}, {_HINTS},
words AS (SELECT hint, lower(hint) AS low, regexp_extract(lower(hint), '([^.]*)$', 1) AS tail, {_tokens("hint")} AS parts FROM (SELECT DISTINCT hint FROM hints) d),
sy AS (SELECT id, lower(name) AS n, replace(file, '/', '.') || '.' || name AS whole, {_tokens("name")} AS t FROM cg_sym),
fit AS (SELECT hint, id, l + CASE WHEN l <= 8 AND sh > 0 THEN 6 * sh + FLOOR(4 * sh / len(parts) + 0.5) ELSE 0 END AS strength FROM (
  SELECT hint, parts, id, CASE WHEN lower(whole) = low OR ends_with(lower(whole), '.' || low) THEN 30 WHEN n = low THEN 26 WHEN n = tail THEN 22 WHEN ends_with(lower(whole), '.' || tail) THEN 18
    WHEN contains(n, low) OR contains(low, n) THEN 8 WHEN contains(lower(whole), low) THEN 4 ELSE 0 END AS l, len(list_filter(parts, lambda x: list_contains(t, x))) AS sh FROM words, sy) c WHERE l + sh > 0),
scored AS (SELECT p, id, ROUND(SUM(v) + 0.5, 6) AS score FROM (SELECT h.id AS p, f.id, strength * CASE WHEN strong THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END AS v FROM hints h JOIN fit f USING (hint)
  UNION ALL SELECT p, id, 0.0::DOUBLE FROM (SELECT DISTINCT id AS p FROM hints) d, sy) u GROUP BY p, id),
few AS (SELECT p AS id, list({{'score': score, 'id': q.id, 'whole': whole}} ORDER BY score DESC, q.id) AS best FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p ORDER BY score DESC, id) AS r FROM scored) q
  JOIN sy ON sy.id = q.id WHERE r <= 4 GROUP BY p)"""),
    "x11_merged": _q("""SELECT type, id AS first, name AS second FROM cg_nodes JOIN k USING (id) WHERE kept = id
      UNION ALL SELECT DISTINCT type, a.kept, b.kept FROM cg_edges e JOIN k a ON a.id = e.source JOIN k b ON b.id = e.target WHERE a.kept <> b.kept""",
      """k AS (SELECT n.id, CASE WHEN type = 'file' THEN n.id ELSE FIRST_VALUE(n.id) OVER (PARTITION BY type, replace(p.p_name, ' ', '_') || '.' || (p.p_partkey % 10) ORDER BY n.seq, n.id) END AS kept
        FROM cg_nodes n LEFT JOIN cg_sym s ON s.id = n.id LEFT JOIN part p ON p.p_partkey = s.pk)"""),
    "r8_owner_and_name": """SELECT page_id, CASE WHEN k < 4 THEN regexp_extract(url, '^[a-z]+://([^/]+)', 1) END AS owner, CASE WHEN k < 4 THEN 'p' || page_id END AS name FROM (SELECT *, page_id % 6 AS k FROM pages) q""",
    "a13_rolling_churn": """WITH c AS (SELECT DISTINCT o_orderkey, CAST(o_orderdate AS DATE) AS d, lower(p_type) AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
      b AS (SELECT file, d, COUNT(*) AS n FROM c GROUP BY file, d),
      e AS (SELECT DISTINCT file, d + k AS as_of FROM b, (VALUES (1), (91)) v(k) WHERE d + k <= (SELECT MAX(d) - 7 FROM c))
      SELECT file, as_of, CAST(COALESCE(SUM(n) FILTER (d >= as_of - 90), 0) AS BIGINT) AS churn, MAX(d) AS last_commit FROM e JOIN b USING (file) WHERE d < as_of GROUP BY file, as_of""",
    "r4_best_match": f"""SELECT id, score FROM (SELECT *, LEAD(score) OVER (ORDER BY score DESC, id) AS next, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS r FROM ({_SCORED}) x) y
      WHERE r = 1 AND score >= 4 AND (score >= 12 OR score - COALESCE(next, 0) >= 1)""",
    "r6_snippet_symbols": _q("""SELECT DISTINCT o AS snippet, id FROM (
        SELECT o, only_id AS id FROM met WHERE n = 1
        UNION ALL SELECT met.o, y.id FROM met JOIN sy y ON y.nm = met.nm WHERE met.n > 1 AND EXISTS (SELECT 1 FROM anchor a WHERE a.o = met.o AND a.file = y.file)
        UNION ALL SELECT met.o, y.id FROM met JOIN sy y ON y.nm = met.nm WHERE met.n BETWEEN 2 AND 3 AND size < 4 AND member
          AND NOT EXISTS (SELECT 1 FROM anchor a JOIN sy z ON z.file = a.file WHERE a.o = met.o AND z.nm = met.nm)) u""",
      """sy AS (SELECT s.pk, s.id, s.file, CASE WHEN s.pk % 3 = 0 THEN s.name ELSE p.p_name END AS nm FROM cg_sym s JOIN part p ON p.p_partkey = s.pk),
hit AS (SELECT l_orderkey AS o, nm, bool_or(l_linenumber % 2 = 1) AS member FROM lineitem JOIN sy ON sy.pk = l_partkey GROUP BY 1, 2),
cnt AS (SELECT nm, COUNT(*) AS n, MIN(id) AS only_id, MIN(file) AS only_file FROM sy GROUP BY nm),
met AS (SELECT h.*, c.n, only_id, only_file, COUNT(*) OVER (PARTITION BY o) AS size FROM hit h JOIN cnt c USING (nm)),
anchor AS (SELECT DISTINCT o, only_file AS file FROM met WHERE n = 1)"""),
    "r7_targets": _q("""SELECT * FROM (SELECT c_custkey AS query, CASE c_custkey % 3
        WHEN 0 THEN COALESCE((SELECT arg_min(id, 1000000 - fan_in) FROM sy WHERE kind = 'module' AND file = 'tests/test_brand_' || (c_custkey % 9) || '.py'),
          (SELECT id FROM sy WHERE contains(lower(name), 'test_brand_' || (c_custkey % 9)) OR contains(lower(file), 'test_brand_' || (c_custkey % 9)) ORDER BY fan_in DESC, id LIMIT 1))
        WHEN 1 THEN (SELECT id FROM sy WHERE contains(lower(name), 'widget_' || c_custkey) OR contains(lower(file), 'widget_' || c_custkey) ORDER BY fan_in DESC, id LIMIT 1)
        ELSE (SELECT id FROM sy WHERE contains(lower(name), 'dget_' || c_custkey) OR contains(lower(file), 'dget_' || c_custkey) ORDER BY fan_in DESC, id LIMIT 1) END AS id
      FROM customer) q WHERE id IS NOT NULL""", "sy AS (SELECT id, name, kind, file, fan_in FROM cg_symbols)"),
    "f9_search_many": _q("""SELECT text, id FROM (SELECT a.text, n.id, ROW_NUMBER() OVER (PARTITION BY a.text ORDER BY n.seq, n.id) AS r
        FROM a JOIN cg_nodes n ON contains(lower(n.name), lower(a.text)) OR contains(lower(n.file), lower(a.text))) q WHERE r <= 50""",
      """a AS (SELECT DISTINCT upper(substr(replace(p_name, ' ', '_') || '_' || p_partkey, CAST(s_suppkey % 5 + 1 AS INT), CAST(s_suppkey % 7 + 2 AS INT))) AS text
        FROM supplier JOIN part ON p_partkey = s_suppkey % 97 + 1)"""),
    "s1_archives": """WITH p AS (SELECT page_id AS n, page_id // 100 AS archive, COALESCE(html, '') AS html,
        ['src/app', 'tests', 'node_modules/x', '.hidden', 'lib'][page_id % 5 + 1] || '/' || CASE WHEN page_id % 11 = 0 THEN repeat('long_name/', 12) ELSE '' END || 'page' || page_id
          || ['.py', '.ts', '.html', '.d.ts', '.go', '.test.js', '.java'][page_id % 7 + 1] AS path FROM pages),
      m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY archive ORDER BY n) AS r FROM p WHERE n % 5 NOT IN (2, 3) AND n % 7 NOT IN (2, 3, 5))
      SELECT 'map' AS kept_for, archive, path, md5(html) AS content_md5 FROM m WHERE r <= 40
      UNION ALL SELECT 'index', archive, 'top/' || path, md5(html) FROM p WHERE n % 5 IN (0, 4) AND n % 7 IN (0, 1) AND strlen(html) <= 20000""",
    "s6_notebooks": """SELECT conv_id, CASE WHEN COUNT(*) FILTER (role = 'assistant') > 0 THEN md5(string_agg(COALESCE(text, ''), chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant')) END AS source_md5
      FROM conversations GROUP BY conv_id""",
    "s10_replaced": "SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS name, c_nationkey AS repo_id FROM customer",
    "s10_incremental": f"""SELECT * FROM ({_written("python")}) w
      WHERE NOT (regexp_extract(first, 'Mod(\\d+)\\.py', 1)::BIGINT % 14 = 3) AND (type NOT IN ('calls', 'imports') OR NOT (regexp_extract(second, 'Mod(\\d+)\\.py', 1)::BIGINT % 14 = 3))""",
    "s10_batches": f"""WITH {_CALLS}, k AS (SELECT p_partkey AS pk, p_partkey // {PARTS_PER_FILE} AS n FROM part), f AS (SELECT DISTINCT n FROM k),
      d AS (SELECT DISTINCT a.n FROM c JOIN k a ON a.pk = c.s JOIN k b ON b.pk = c.t WHERE c.t = 2 AND a.n <> b.n)
      SELECT 'all' AS note, COUNT(*) AS changed, COUNT(*) AS extracted, 0 AS dependents FROM f
      UNION ALL SELECT 'a remark', COUNT(*), COUNT(*), 0 FROM f WHERE n % 10 = 1
      UNION ALL SELECT 'renamed', COUNT(*), COUNT(*), (SELECT COUNT(*) FROM d) FROM f WHERE n = 0""",
    "f11_guarded_writes": """SELECT c_nationkey AS repo_id, c_custkey AS id, CASE WHEN n_regionkey = 1 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS name
      FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (1, 3)""",
    "s12_listed": """SELECT s_suppkey AS id, CAST(round(s_acctbal) AS BIGINT) AS updated_at, ROW_NUMBER() OVER (ORDER BY CAST(round(s_acctbal) AS BIGINT) DESC, s_suppkey) AS place
      FROM supplier WHERE s_nationkey = 7""",
    "s11_runs": """SELECT concat('region ', n_regionkey) AS prompt, 'behavior' AS change_kind, COUNT(*) AS n, COUNT(*) FILTER (s_suppkey % 3 = 0) AS high,
      COUNT(*) FILTER (s_suppkey % 3 = 1) AS medium, COUNT(*) FILTER (s_suppkey % 3 = 2) AS low, COUNT(*) AS total
      FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey
      UNION ALL SELECT concat('region ', r), 'behavior', 0, 0, 0, 0, 0 FROM range(5) x(r) WHERE r NOT IN (SELECT n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "s12_deleted": "SELECT c_custkey AS id, c_nationkey AS repo_id FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "f10_allowed_rows": "SELECT o_custkey AS repo_id, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_mktsegment = 'BUILDING')",
    "u7_broken_keys": """SELECT 'symbol name' AS rule, COUNT(*) AS n FROM (SELECT p_name FROM part GROUP BY 1 HAVING COUNT(*) > 1) a
      UNION ALL SELECT 'edge', COUNT(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_partkey, l_returnflag HAVING COUNT(*) > 1) b
      UNION ALL SELECT 'source', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT p_partkey FROM part)
      UNION ALL SELECT 'target', COUNT(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""",
    "p_suggested_tests": _q("""SELECT id, CASE pk % 3 WHEN 0 THEN 'tests/' || regexp_replace(regexp_replace(file, '^src/', ''), '[^/]*$', '') || 'test_' || regexp_extract(file, '([^/]*)$', 1)
        WHEN 1 THEN regexp_replace(file, '\\.py$', '.test.ts') ELSE 'tests/' || regexp_replace(file, '\\.py$', '.go.test') END AS suggested, 'get_' || lower(name) AS snake FROM cg_sym"""),
}
