"""DuckDB SQL with the rows of each registered query, written independently of the Spark plans."""

from __future__ import annotations

from .operators.ingest import SNIPPET_NOISE, SNIPPET_STOP

_VIEWS = """
cg_sym AS (
  SELECT p_partkey AS pk, concat('p', CAST(p_partkey AS VARCHAR)) AS id,
    CASE WHEN p_type = 'PROMO' THEN concat('tests/test_', lower(replace(p_brand, '#', '_')), '.py')
         ELSE concat('src/', lower(p_type), '/', lower(replace(p_brand, '#', '_')), '.py') END AS file,
    concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS VARCHAR)) AS name
  FROM part),
cg_call AS (
  SELECT DISTINCT s, t FROM (
    SELECT l_partkey AS s, LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS t
    FROM lineitem WHERE l_returnflag = 'R') x
  WHERE t IS NOT NULL AND s <> t),
cg_nodes AS (
  SELECT id, 'function' AS type, file, name, CAST(NULL AS INT) AS loc, 1000000 + pk AS seq FROM cg_sym
  UNION ALL
  SELECT file, 'file', file, file, CAST(COUNT(*) * 7 AS INT), MIN(pk) FROM cg_sym GROUP BY file),
cg_edges AS (
  SELECT concat('p', CAST(s AS VARCHAR)) AS source, concat('p', CAST(t AS VARCHAR)) AS target, 'calls' AS type FROM cg_call
  UNION ALL
  SELECT DISTINCT a.file, b.file, 'imports'
  FROM cg_call c JOIN cg_sym a ON a.pk = c.s JOIN cg_sym b ON b.pk = c.t
  WHERE a.file <> b.file),
cg_symbols AS (
  SELECT n.id, n.file, n.name, CASE WHEN n.type = 'file' THEN 'module' ELSE 'function' END AS kind,
    CAST(COALESCE(i.c, 0) AS BIGINT) AS fan_in, CAST(COALESCE(o.c, 0) AS BIGINT) AS fan_out,
    CAST(COALESCE(h.c, 0) AS BIGINT) AS churn, n.seq
  FROM cg_nodes n
  LEFT JOIN (SELECT target, COUNT(*) AS c FROM cg_edges GROUP BY target) i ON i.target = n.id
  LEFT JOIN (SELECT source, COUNT(*) AS c FROM cg_edges GROUP BY source) o ON o.source = n.id
  LEFT JOIN (SELECT s.id AS hid, COUNT(*) AS c FROM lineitem l JOIN cg_sym s ON s.pk = l.l_partkey
             CROSS JOIN (SELECT MAX(l_shipdate) AS m FROM lineitem) x
             WHERE l.l_shipdate >= x.m - INTERVAL 90 DAYS GROUP BY s.id) h ON h.hid = n.id),
target AS (SELECT id, fan_in FROM cg_symbols WHERE kind = 'function' ORDER BY fan_in DESC, id LIMIT 1),
ug_nodes AS (SELECT DISTINCT user_id AS id FROM events),
ug_edges AS (
  SELECT DISTINCT u AS source, v AS target FROM (
    SELECT user_id AS u, LEAD(user_id) OVER (ORDER BY ts, event_id) AS v,
           event_type AS a, LEAD(event_type) OVER (ORDER BY ts, event_id) AS b FROM events) x
  WHERE v IS NOT NULL AND u <> v AND a = 'error' AND b = 'purchase'),
ug_both AS (SELECT source AS a, target AS b FROM ug_edges UNION ALL SELECT target, source FROM ug_edges)
"""


def _q(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {_VIEWS}{',' + more if more else ''} {body}"


def _reach(depth: int) -> str:
    return f"""
walk(id, d) AS (SELECT id, 0 FROM target UNION
  SELECT e.source, w.d + 1 FROM cg_edges e JOIN walk w ON e.target = w.id WHERE w.d < {depth}),
hit AS (SELECT id, MIN(d) AS depth FROM walk GROUP BY id)"""


_RISK = "CASE WHEN s.fan_in >= 5 OR s.churn >= 3 THEN 'high' WHEN s.fan_in >= 2 OR s.churn >= 1 THEN 'medium' ELSE 'low' END"
_TEST = r"regexp_matches(file, '(?i)(?:^|/)(?:test_[^/]+\.py|[^/]+_test\.py|[^/]+\.test\.[tj]sx?|[^/]+\.spec\.[tj]sx?)$|(?:^|/)(?:tests?|__tests__)/')"
_MODULE = """CASE WHEN len(list_filter(string_split(file, '/'), lambda p: p <> '')) <= 1 THEN 'root'
  ELSE array_to_string(list_slice(list_filter(string_split(file, '/'), lambda p: p <> ''), 1,
    greatest(1, least(2, len(list_filter(string_split(file, '/'), lambda p: p <> '')) - 1))), '/') END"""
_SECONDS = "CASE WHEN COALESCE(loc, 0) = 0 THEN 1.5::DOUBLE ELSE least(10.0::DOUBLE, greatest(0.5::DOUBLE, 1 + loc * 0.01::DOUBLE)) END"
_PLAN = f"""{_reach(8)},
plan AS (SELECT h.id, h.depth AS distance, CASE WHEN h.depth <= 2 THEN 'high' WHEN h.depth <= 4 THEN 'medium' ELSE 'low' END AS priority,
  {_SECONDS} AS seconds FROM hit h JOIN cg_nodes USING (id) WHERE h.depth > 0 AND {_TEST})"""
_COVER = f"""
fwd(test, id, d) AS (SELECT id, id, 0 FROM cg_nodes WHERE {_TEST} UNION
  SELECT f.test, e.target, f.d + 1 FROM fwd f JOIN cg_edges e ON e.source = f.id WHERE f.d < 8),
cover AS (SELECT n.id, COUNT(DISTINCT f.test) AS tests FROM cg_nodes n LEFT JOIN fwd f ON f.id = n.id AND f.test <> n.id
  WHERE NOT {_TEST} GROUP BY n.id)"""
_INBOUND = """
inb AS (SELECT COUNT(*) AS code_nodes, CAST(SUM(CASE WHEN fan_in > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_inbound
  FROM cg_symbols WHERE kind = 'function')"""
_FOCUS = """
near(id, d) AS (SELECT id, 0 FROM target UNION
  SELECT CASE WHEN e.source = n.id THEN e.target ELSE e.source END, n.d + 1 FROM near n
  JOIN cg_edges e ON e.source = n.id OR e.target = n.id WHERE n.d < 2)"""
_SUGGEST = "concat('tests/', regexp_replace(regexp_replace({f}, '^src/', ''), '[^/]*$', ''), 'test_', regexp_extract({f}, '([^/]*)$', 1))"
_STRIDE = """
line AS (SELECT id, ROW_NUMBER() OVER (ORDER BY id) - 1 AS spot, COUNT(*) OVER () AS n FROM ug_nodes),
src AS (SELECT l.id FROM line l WHERE n <= 60 OR spot IN (SELECT (i * (SELECT COUNT(*) FROM ug_nodes)) // 60 FROM range(60) r(i))),
far(source, id, depth) AS (SELECT id, id, 0 FROM src UNION
  SELECT f.source, u.b, f.depth + 1 FROM far f JOIN ug_both u ON u.a = f.id WHERE f.depth < 14),
dist AS (SELECT source, id, MIN(depth) AS depth FROM far GROUP BY source, id)"""
_BETWEEN = """
w(s, v, k, c) AS (SELECT id, id, 0, 1.0::DOUBLE FROM ug_nodes UNION ALL
  (SELECT w.s, u.b, w.k + 1, SUM(w.c) FROM w JOIN ug_both u ON u.a = w.v WHERE w.k < 14 GROUP BY 1, 2, 3)),
d AS (SELECT s, v, MIN(k) AS d, arg_min(c, k) AS g FROM w GROUP BY 1, 2),
nn AS (SELECT COUNT(*) AS n FROM ug_nodes),
bt AS (SELECT x.v AS id, SUM(x.g * y.g / z.g) / ((n - 1) * (n - 2)) AS betweenness
  FROM d x JOIN d y ON y.s = x.v JOIN d z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d, nn
  WHERE x.s <> x.v AND y.v <> x.v AND x.s <> y.v GROUP BY x.v, n)"""
_RINGS = """
pth(a, b) AS (SELECT source, target FROM ug_edges UNION SELECT p.a, e.target FROM pth p JOIN ug_edges e ON e.source = p.b),
ring AS (SELECT x.a AS id, MIN(y.b) AS r FROM pth x JOIN pth y ON y.a = x.a JOIN pth z ON z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY x.a)"""
_PARTS = """
comp(id, root) AS (SELECT id, id FROM ug_nodes UNION SELECT u.b, c.root FROM comp c JOIN ug_both u ON u.a = c.id),
parts AS (SELECT id, MIN(root) AS component FROM comp GROUP BY id)"""
_DENSITY = "(SELECT COUNT(*) FROM (SELECT DISTINCT least(source, target), greatest(source, target) FROM {e})) / ((SELECT COUNT(*) FROM {v}) * ((SELECT COUNT(*) FROM {v}) - 1) / 2.0::DOUBLE)"

_CAPPED = ",".join(
    ["""
oe AS (SELECT *, concat_ws(' ', type, source, target) AS k FROM cg_edges),
l0 AS (SELECT id, 0 AS depth, CAST(NULL AS VARCHAR) AS kind FROM target)"""]
    + [
        f"""
l{d} AS (SELECT * FROM l{d - 1} UNION ALL SELECT id, {d}, kind FROM (
  SELECT source AS id, arg_min(type, k) AS kind, ROW_NUMBER() OVER (ORDER BY MIN(k)) AS r FROM oe
  WHERE target IN (SELECT id FROM l{d - 1} WHERE depth = {d - 1}) AND source NOT IN (SELECT id FROM l{d - 1}) GROUP BY source) q
  WHERE r <= 200 - (SELECT COUNT(*) FROM l{d - 1} WHERE depth > 0))"""
        for d in range(1, 5)
    ]
)

_BLANKED = "html"
for _noise in SNIPPET_NOISE:
    _BLANKED = "regexp_replace({}, '{}', ' ', 'g')".format(_BLANKED, _noise.replace("'", "''"))

_PATHS = "WITH p AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, o_custkey % 11 AS e FROM orders) "

def _ranks(graph: str) -> str:
    """Rounds of ranks over the nodes and edges of a graph's views."""
    return f"""
n AS (SELECT id, COUNT(*) OVER () AS nn FROM {graph}_nodes),
od AS (SELECT source, COUNT(*) AS k FROM {graph}_edges GROUP BY 1),
pr(it, id, r) AS (
  SELECT 0, id, 1.0::DOUBLE / nn FROM n
  UNION ALL
  (SELECT p.it + 1, n.id, 0.15 / n.nn + 0.85 * COALESCE(x.m, 0) + 0.85 * d.dm / n.nn
   FROM n
   CROSS JOIN (SELECT COALESCE(SUM(CASE WHEN od.k IS NULL THEN r END), 0) AS dm FROM pr LEFT JOIN od ON od.source = pr.id) d
   JOIN pr p ON p.id = n.id
   LEFT JOIN (SELECT e.target, SUM(pr.r / od.k) AS m FROM pr
              JOIN {graph}_edges e ON e.source = pr.id JOIN od ON od.source = pr.id GROUP BY 1) x ON x.target = n.id
   WHERE p.it < 50))"""


def _tokens(name: str) -> str:
    """Parts of a name by the rule: at capitals behind small letters or digits, and at _, - and dots."""
    return f"list_filter(regexp_split_to_array(lower(regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_.-]'), lambda y: length(y) >= 2)"


ORACLE_SQL = {
    "a1_counts": _q("SELECT type, COUNT(*) AS n FROM cg_nodes GROUP BY type UNION ALL SELECT type, COUNT(*) FROM cg_edges GROUP BY type"),
    "a8_fan_counts": _q("SELECT id, fan_in, fan_out FROM cg_symbols"),
    "j13_symbols": _q("SELECT * FROM cg_symbols"),
    "j15_neighbours": _q("""SELECT t.id, 'out' AS direction, e.target AS neighbour, e.type FROM target t JOIN cg_edges e ON e.source = t.id
      UNION ALL SELECT t.id, 'in', e.source, e.type FROM target t JOIN cg_edges e ON e.target = t.id WHERE e.source <> e.target"""),
    "g5_orphans": _q("SELECT id FROM cg_symbols WHERE fan_in = 0"),
    "g1_pagerank": _q("SELECT id, ROUND(r, 8) AS pagerank FROM pr WHERE it = 50", _ranks("ug")),
    "t1_top_by_rank": _q("SELECT id, ROUND(r, 8) AS score FROM pr WHERE it = 50 ORDER BY score DESC, id LIMIT 25", _ranks("cg")),
    "w3_low_signal_by_rank": _q("""SELECT s.id, s.file, (ROW_NUMBER() OVER (PARTITION BY s.file ORDER BY ROUND(r, 8) DESC, s.seq)
        > greatest(2, CEIL(COUNT(*) OVER (PARTITION BY s.file) * 0.5))) AND s.id NOT IN (SELECT id FROM x) AS hidden
      FROM cg_nodes s JOIN pr ON pr.id = s.id WHERE it = 50 AND type = 'function'""",
      _ranks("cg") + """,
xe AS (SELECT e.source, e.target FROM cg_edges e JOIN cg_nodes a ON a.id = e.source JOIN cg_nodes b ON b.id = e.target WHERE a.file <> b.file),
x AS (SELECT source AS id FROM xe UNION SELECT target FROM xe)"""),
    "w1_percentile": _q("SELECT id, ROUND(percent_rank() OVER (ORDER BY fan_in), 6) AS percentile FROM cg_symbols"),
    "g2_betweenness": _q("SELECT n.id, ROUND(COALESCE(b.betweenness, 0), 8) AS betweenness FROM ug_nodes n LEFT JOIN bt b USING (id)", _BETWEEN),
    "g3_clustering": _q("""SELECT n.id, ROUND(CASE WHEN COALESCE(k.k, 0) < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * COALESCE(l.c, 0) / (k.k * (k.k - 1)) END, 6) AS clustering
      FROM ug_nodes n LEFT JOIN (SELECT a, COUNT(*) AS k FROM s GROUP BY a) k ON k.a = n.id
      LEFT JOIN (SELECT x.a, COUNT(*) AS c FROM s x JOIN s y ON y.a = x.a AND x.b < y.b JOIN s z ON z.a = x.b AND z.b = y.b GROUP BY x.a) l ON l.a = n.id""",
      "s AS (SELECT DISTINCT a, b FROM ug_both)"),
    "g7_components": _q("SELECT id, component FROM parts", _PARTS),
    "a11_density": _q(f"SELECT ROUND({_DENSITY.format(e='cg_edges', v='cg_nodes')}, 8) AS density"),
    "g6_distances": _q("SELECT source, id, CAST(depth AS INT) AS depth FROM dist", _STRIDE),
    "g8_health": _q(f"""SELECT CAST(dia AS INT) AS diameter, avg_path, ROUND(dens, 8) AS density, comps AS components, rings AS cycles,
      CAST(greatest(0, least(100, 100 - CASE WHEN top > 0.6 THEN 25 WHEN top > 0.35 THEN 15 ELSE 0 END
        - CASE WHEN dia > 10 THEN 15 WHEN dia > 7 THEN 10 ELSE 0 END - CASE WHEN comps > 1 THEN 20 ELSE 0 END
        - CASE WHEN dens < 0.05 OR dens > 0.40 THEN 10 ELSE 0 END - least(30, 12 * rings))) AS INT) AS health
      FROM (SELECT (SELECT COUNT(DISTINCT r) FROM ring) AS rings, (SELECT MAX(depth) FROM dist) AS dia, (SELECT FLOOR(AVG(depth) * 10 + 0.5) / 10 FROM dist WHERE depth > 0) AS avg_path,
        {_DENSITY.format(e='ug_edges', v='ug_nodes')} AS dens, (SELECT COUNT(DISTINCT component) FROM parts) AS comps,
        (SELECT MAX(betweenness) FROM bt) AS top) q""", _STRIDE + "," + _PARTS + "," + _BETWEEN + "," + _RINGS),
    "g4_cycles": _q("""SELECT a.s AS id, least(a.s, MIN(b.t)) AS cycle, COUNT(DISTINCT b.t) AS size FROM c a JOIN c b ON b.s = a.s JOIN c r ON r.s = b.t AND r.t = a.s
      WHERE a.t = a.s GROUP BY a.s""", "e AS (SELECT source AS s, target AS t FROM cg_edges WHERE type = 'imports'), c(s, t) AS (SELECT s, t FROM e UNION SELECT c.s, e.t FROM c JOIN e ON e.s = c.t)"),
    "g4_witnesses": _q("""SELECT graph, CAST(cycle AS VARCHAR) AS cycle, CAST("at" AS INT) AS "at", CAST(id AS VARCHAR) AS id FROM walked""",
      """e AS (SELECT 'files' AS graph, source AS s, target AS t FROM cg_edges WHERE type = 'imports' AND regexp_replace(source, '/[^/]*$', '') = regexp_replace(target, '/[^/]*$', '')
        UNION ALL SELECT 'users', lpad(CAST(source AS VARCHAR), 20, '0'), lpad(CAST(target AS VARCHAR), 20, '0') FROM ug_edges),
      clo(graph, s, t) AS (SELECT graph, s, t FROM e UNION SELECT c.graph, c.s, e.t FROM clo c JOIN e ON e.graph = c.graph AND e.s = c.t),
      mem AS (SELECT a.graph, a.s AS id, least(a.s, MIN(b.t)) AS cycle FROM clo a JOIN clo b ON b.graph = a.graph AND b.s = a.s JOIN clo r ON r.graph = a.graph AND r.s = b.t AND r.t = a.s WHERE a.t = a.s GROUP BY a.graph, a.s),
      ins AS (SELECT m.graph, m.cycle, e.s, e.t FROM e JOIN mem m ON m.graph = e.graph AND m.id = e.s JOIN mem k ON k.graph = e.graph AND k.id = e.t AND k.cycle = m.cycle),
      reached(graph, cycle, id, d) AS (SELECT DISTINCT graph, cycle, cycle, 0 FROM mem UNION SELECT r.graph, r.cycle, i.t, r.d + 1 FROM reached r JOIN ins i ON i.graph = r.graph AND i.cycle = r.cycle AND i.s = r.id WHERE r.d < 40),
      dist AS (SELECT graph, cycle, id, MIN(d) AS d FROM reached GROUP BY ALL),
      par AS (SELECT a.graph, a.cycle, a.id, MIN(x.id) AS parent FROM dist a JOIN ins i ON i.graph = a.graph AND i.cycle = a.cycle AND i.t = a.id JOIN dist x ON x.graph = a.graph AND x.cycle = a.cycle AND x.id = i.s AND x.d = a.d - 1 GROUP BY ALL),
      fin AS (SELECT graph, cycle, MIN(struct_pack(d := d, id := id)) AS f FROM dist JOIN ins i USING (graph, cycle) WHERE i.s = id AND i.t = cycle GROUP BY ALL),
      back(graph, cycle, "at", id) AS (SELECT graph, cycle, f.d, f.id FROM fin UNION ALL SELECT b.graph, b.cycle, b."at" - 1, p.parent FROM back b JOIN par p ON p.graph = b.graph AND p.cycle = b.cycle AND p.id = b.id WHERE b."at" > 0),
      walked AS (SELECT graph, CASE graph WHEN 'users' THEN CAST(CAST(cycle AS BIGINT) AS VARCHAR) ELSE cycle END AS cycle, "at", CASE graph WHEN 'users' THEN CAST(CAST(id AS BIGINT) AS VARCHAR) ELSE id END AS id FROM back)"""),
    "g23_impact": _q(f"SELECT h.id, CAST(h.depth AS INT) AS depth, s.fan_in, s.churn, {_RISK} AS risk FROM hit h JOIN cg_symbols s USING (id) WHERE h.depth > 0", _reach(5)),
    "a7_impact_summary": _q(f"""SELECT CAST(COUNT(*) FILTER (r = 'high') AS BIGINT) AS high, CAST(COUNT(*) FILTER (r = 'medium') AS BIGINT) AS medium,
      CAST(COUNT(*) FILTER (r = 'low') AS BIGINT) AS low, COUNT(*) AS total, CAST(COALESCE(MAX(depth), 0) AS INT) AS depth_max
      FROM (SELECT h.depth, {_RISK} AS r FROM hit h JOIN cg_symbols s USING (id) WHERE h.depth > 0) q""", _reach(5)),
    "p3_continuous_risk": _q("""SELECT id, CAST(depth AS INT) AS depth, FLOOR(raw * 1000 + 0.5) / 1000 AS score,
      CASE WHEN raw > 0.66 THEN 'high' WHEN raw > 0.33 THEN 'medium' ELSE 'low' END AS level
      FROM (SELECT h.id, h.depth, 0.5::DOUBLE / h.depth + 0.3::DOUBLE * s.fan_in / greatest(1, MAX(s.fan_in) OVER ())
        + 0.2::DOUBLE * s.churn / greatest(1, MAX(s.churn) OVER ()) AS raw
        FROM hit h JOIN cg_symbols s USING (id) WHERE h.depth > 0) q""", _reach(4)),
    "p4_criticality": _q("""SELECT kind, total, shallow, FLOOR(score * 1000 + 0.5) / 1000 AS points,
      CASE WHEN breaks AND (fan_in >= 5 OR shallow >= 5) THEN 'critical' WHEN score >= 60 THEN 'critical' WHEN score >= 35 THEN 'significant'
        WHEN score >= 15 OR (breaks AND total >= 1) THEN 'moderate' ELSE 'minor' END AS level,
      concat_ws('; ', CASE kind WHEN 'delete' THEN 'deletion breaks every caller' WHEN 'rename' THEN 'rename breaks every caller until updated'
          WHEN 'signature' THEN 'signature change breaks every caller' END,
        CASE WHEN fan_in >= 8 THEN concat('core symbol (', fan_in, ' direct callers)') WHEN fan_in >= 3 THEN concat('used by ', fan_in, ' other symbols')
          WHEN fan_in = 1 THEN '1 direct caller' WHEN fan_in > 0 THEN concat(fan_in, ' direct callers') END,
        CASE WHEN total = 1 THEN '1 downstream symbol affected' WHEN total > 0 THEN concat(total, ' downstream symbols affected') END,
        CASE WHEN shallow > 0 THEN concat(shallow, ' immediate') END) AS reasons
      FROM (SELECT *, (least(40.0::DOUBLE, fan_in * 5.0::DOUBLE) + least(30.0::DOUBLE, shallow * 4.0::DOUBLE) + least(20.0::DOUBLE, total * 0.8::DOUBLE))
          * CASE WHEN breaks THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN kind = 'delete' THEN 10 ELSE 0 END AS score
        FROM (SELECT kind, kind <> 'behavior' AS breaks, (SELECT fan_in FROM target) AS fan_in, total, shallow
          FROM (VALUES ('behavior'), ('delete'), ('rename'), ('signature')) v(kind),
            (SELECT COUNT(*) AS total, COUNT(*) FILTER (depth <= 2) AS shallow FROM hit WHERE depth > 0) c) d) e""", _reach(5)),
    "g24_impact_capped": _q("SELECT id, CAST(depth AS INT) AS depth, kind FROM l4 WHERE depth > 0", _CAPPED),
    "a5_hotspots": _q("""SELECT file, symbols, score, ROUND(score / MAX(score) OVER (), 6) AS share,
      CASE WHEN score / MAX(score) OVER () >= 0.66 THEN 'high' WHEN score / MAX(score) OVER () >= 0.33 THEN 'medium' ELSE 'low' END AS band
      FROM (SELECT file, COUNT(*) AS symbols, CAST(3 * MAX(fan_in) + 2 * MAX(fan_out) + MAX(churn) + CASE WHEN COUNT(*) > 1 THEN COUNT(*) ELSE 0 END AS BIGINT) AS score
        FROM (SELECT * FROM cg_symbols ORDER BY fan_in DESC, id LIMIT 300) t GROUP BY file ORDER BY score DESC, file LIMIT 12) q"""),
    "a6_risky_files": _q("SELECT * FROM (SELECT file, MAX(churn) AS churn, COUNT(*) AS symbols, MAX(MAX(churn)) OVER () AS max_churn, COUNT(*) OVER () AS total_files FROM cg_symbols GROUP BY file HAVING MAX(churn) > 0) q ORDER BY churn DESC, file LIMIT 12"),
    "a3_modules": _q(f"SELECT {_MODULE} AS module, COUNT(*) FILTER (type = 'file') AS files, COUNT(*) FILTER (type <> 'file') AS symbols FROM cg_nodes GROUP BY 1"),
    "a4_module_edges": _q("SELECT a.m AS source, b.m AS target, e.type, COUNT(*) AS weight FROM cg_edges e JOIN mk a ON a.id = e.source JOIN mk b ON b.id = e.target WHERE a.m <> b.m GROUP BY 1, 2, 3",
      f"mk AS (SELECT id, {_MODULE} AS m FROM cg_nodes)"),
    "g19_file_graph": _q("SELECT DISTINCT e.source, e.target, e.type FROM cg_edges e JOIN cg_nodes a ON a.id = e.source AND a.type = 'file' JOIN cg_nodes b ON b.id = e.target AND b.type = 'file'"),
    "g17_focus": _q("SELECT source, target, type FROM cg_edges WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)", _FOCUS),
    "g18_focus_module": _q("SELECT id FROM m UNION SELECT e.target FROM cg_edges e JOIN m ON m.id = e.source UNION SELECT e.source FROM cg_edges e JOIN m ON m.id = e.target",
      f"m AS (SELECT id FROM cg_nodes WHERE {_MODULE} = 'tests')"),
    "t2_top_symbols": _q("SELECT source, target, type FROM cg_edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)",
      "k AS ((SELECT id FROM cg_symbols WHERE kind = 'function' ORDER BY fan_in DESC, seq LIMIT 100) UNION ALL SELECT id FROM cg_symbols WHERE kind = 'module')"),
    "w3_low_signal": _q("""SELECT s.id, s.file, (ROW_NUMBER() OVER (PARTITION BY s.file ORDER BY s.fan_in DESC, s.seq)
        > greatest(1, CEIL(COUNT(*) OVER (PARTITION BY s.file) * 0.25))) AND s.id NOT IN (SELECT id FROM x) AS hidden
      FROM cg_symbols s WHERE kind = 'function'""",
      """xe AS (SELECT e.source, e.target FROM cg_edges e JOIN cg_nodes a ON a.id = e.source JOIN cg_nodes b ON b.id = e.target WHERE a.file <> b.file),
x AS (SELECT source AS id FROM xe UNION SELECT target FROM xe)"""),
    "w4_zone_leaders": _q(f"""SELECT zone, type, id, degree, CAST(place AS INT) AS place FROM (
      SELECT {_MODULE} AS zone, n.type, n.id, s.fan_in + s.fan_out AS degree,
        ROW_NUMBER() OVER (PARTITION BY {_MODULE.replace('file,', 'n.file,')}, n.type ORDER BY s.fan_in + s.fan_out DESC, n.seq, n.id) AS place
      FROM cg_nodes n JOIN (SELECT id, fan_in, fan_out FROM cg_symbols) s ON s.id = n.id) q
      WHERE place <= CASE type WHEN 'file' THEN 3 WHEN 'class' THEN 2 ELSE 1 END"""),
    "t7_zones": _q(f"SELECT {_MODULE} AS zone, COUNT(*) AS n FROM cg_nodes GROUP BY 1"),
    "g10_covering_tests": _q("SELECT id, CAST(distance AS INT) AS distance FROM plan", _PLAN),
    "g12_test_plan": _q("SELECT id, CAST(distance AS INT) AS distance, priority, ROUND(seconds, 6) AS seconds FROM plan", _PLAN),
    "a10_plan_summary": _q(f"""SELECT t AS tests, ROUND(s, 3) AS seconds, ROUND(a, 3) AS all_seconds,
      greatest(0.0::DOUBLE, FLOOR((1 - s / a) * 100 * 10 + 0.5) / 10) AS saved_percent
      FROM (SELECT (SELECT COUNT(*) FROM plan) AS t, (SELECT COALESCE(SUM(FLOOR(seconds * 100 + 0.5) / 100), 0) FROM plan) AS s,
        (SELECT SUM({_SECONDS}) FROM cg_nodes WHERE {_TEST}) AS a) q""", _PLAN),
    "g11_coverage": _q("SELECT id, tests FROM cover", _COVER),
    "a9_coverage_summary": _q("SELECT COUNT(*) AS nodes, COUNT(*) FILTER (tests > 0) AS covered, FLOOR(COUNT(*) FILTER (tests > 0) * 100 / COUNT(*) * 10 + 0.5) / 10 AS percent FROM cover", _COVER),
    "g15_dead_code": _q(f"""SELECT id, CASE WHEN {_TEST} AND fan_out = 0 THEN 'orphan test' WHEN kind = 'module' THEN 'no importers'
        WHEN contains(name, '.') OR contains(name, '::') OR (SELECT code_nodes >= 50 AND with_inbound / code_nodes < 0.3 FROM inb) THEN 'likely-dispatch' ELSE 'no callers' END AS reason
      FROM cg_symbols WHERE ({_TEST} AND fan_out = 0) OR (fan_in = 0 AND NOT (kind = 'module' AND {_TEST}))""", _INBOUND),
    "a15_inbound": _q("SELECT code_nodes, with_inbound, ROUND(with_inbound / code_nodes, 6) AS ratio, code_nodes >= 50 AND with_inbound / code_nodes < 0.3 AS low_confidence FROM inb", _INBOUND),
    "g16_proposals": _q(f"""SELECT concat(t.id, '::', k) AS id, t.id AS target, {_SUGGEST.format(f="n.file")} AS suggested_file, concat('test_', lower(n.name), e) AS suggested_name, w AS rationale, 'unit' AS kind, p AS priority
      FROM target t JOIN cg_nodes n ON n.id = t.id, (VALUES ('happy', '_happy_path', 'high', 'Cover the typical successful invocation with representative inputs.'),
        ('edges', '_edge_cases', 'high', 'Empty / null / boundary inputs — these are usually where bugs hide.'),
        ('errors', '_raises_on_invalid', 'medium', 'Invalid inputs should fail loudly. Assert the error type and message.')) v(k, e, p, w)
      UNION ALL SELECT concat(t.id, '::integ::', o.id), t.id, {_SUGGEST.format(f="n.file")}, concat('test_', lower(n.name), '_integrates_with_', lower(o.name)),
        concat('Verify the contract between `', n.name, '` and its dependency `', o.name, '`.'), 'integration', 'medium'
      FROM target t JOIN cg_nodes n ON n.id = t.id, (SELECT m.id, m.name FROM cg_edges e JOIN target t ON e.source = t.id JOIN cg_nodes m ON m.id = e.target WHERE NOT {_TEST.replace("(file,", "(m.file,")}
        ORDER BY e.type, e.source, e.target LIMIT 4) o
      UNION ALL SELECT concat(t.id, '::smoke::', o.id), t.id, {_SUGGEST.format(f="o.file")}, concat('test_', lower(o.name), '_still_uses_', lower(n.name)),
        concat('`', o.name, '` calls this — a smoke test there guards against regressions.'), 'smoke', 'low'
      FROM target t JOIN cg_nodes n ON n.id = t.id, (SELECT m.id, m.name, m.file FROM cg_edges e JOIN target t ON e.target = t.id JOIN cg_nodes m ON m.id = e.source WHERE NOT {_TEST.replace("(file,", "(m.file,")}
        ORDER BY e.type, e.source, e.target LIMIT 3) o"""),
    "a14_plan_groups": _q("SELECT priority, COUNT(*) AS tests, ROUND(SUM(seconds), 3) AS seconds FROM plan GROUP BY priority", _PLAN),
    "s13_plan_json": _q("""SELECT concat('{"id":"', id, '","distance":', distance, ',"priority":"', priority, '","estimated_time":', CAST(ROUND(seconds, 2) AS VARCHAR), '}') AS json FROM plan""", _PLAN),
    "s13_plan_shell": _q("SELECT DISTINCT 'pytest ' || file AS command FROM plan JOIN cg_nodes USING (id)", _PLAN),
    "g14_changed_files": _q("SELECT id FROM cg_nodes WHERE type = 'file' AND file IN ('tests/test_brand_1.py', 'src/eco/brand_2.py', 'src/eco/none.py')"),
    "g25_reaching_edges": _q("SELECT e.source, e.target, e.type FROM cg_edges e JOIN up a ON a.id = e.source JOIN up b ON b.id = e.target",
      "up(id) AS ((SELECT id FROM cg_nodes WHERE type = 'file' ORDER BY seq, id LIMIT 1) UNION SELECT e.source FROM cg_edges e JOIN up ON up.id = e.target WHERE e.type = 'imports')"),
    "j14_contains": _q("SELECT file AS source, id AS target, 'contains' AS type FROM cg_nodes WHERE type = 'function'"),
    "f8_visible_types": _q("SELECT source, target, type FROM cg_edges WHERE type = 'calls'"),
    "f14_highlighted": _q("""SELECT id, 'active' AS by FROM (SELECT id FROM target UNION SELECT e.source FROM cg_edges e JOIN target t ON e.target = t.id UNION SELECT e.target FROM cg_edges e JOIN target t ON e.source = t.id) a
      UNION ALL SELECT id, 'search' FROM cg_nodes WHERE contains(lower(name), 'promo') OR contains(lower(file), 'promo')"""),
    "g20_abstraction": _q("""SELECT DISTINCT 'module' AS level, concat('module:', a.m) AS source, concat('module:', b.m) AS target, e.type FROM fe e JOIN mk a ON a.id = e.source JOIN mk b ON b.id = e.target WHERE a.m <> b.m
      UNION ALL SELECT DISTINCT 'file', source, target, type FROM fe WHERE type = 'imports' UNION ALL SELECT 'symbol', source, target, type FROM fe""",
      f"""mk AS (SELECT id, {_MODULE} AS m FROM cg_nodes), me AS (SELECT id FROM mk WHERE m = 'tests'),
near AS (SELECT id FROM me UNION SELECT e.target FROM cg_edges e JOIN me ON me.id = e.source UNION SELECT e.source FROM cg_edges e JOIN me ON me.id = e.target),
fe AS (SELECT e.* FROM cg_edges e JOIN near a ON a.id = e.source JOIN near b ON b.id = e.target)"""),
    "g21_collapsed": _q("""SELECT file, COUNT(*) AS n, string_agg(id, ',' ORDER BY fan_in DESC, seq) AS hidden FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY file ORDER BY fan_in DESC, seq) AS r, COUNT(*) OVER (PARTITION BY file) AS k FROM cg_symbols WHERE kind = 'function') q
      WHERE r > greatest(1, CEIL(k * 0.25)) GROUP BY file"""),
    "g22_display": _q("""SELECT id FROM cg_symbols WHERE kind = 'module' UNION ALL SELECT id FROM (
      SELECT t.*, ROW_NUMBER() OVER (PARTITION BY file ORDER BY fan_in DESC, seq) AS r, COUNT(*) OVER (PARTITION BY file) AS k FROM t) q
      WHERE r <= greatest(1, CEIL(k * 0.25)) OR id IN (SELECT e.source FROM cg_edges e JOIN t a ON a.id = e.source JOIN t b ON b.id = e.target WHERE a.file <> b.file
        UNION SELECT e.target FROM cg_edges e JOIN t a ON a.id = e.source JOIN t b ON b.id = e.target WHERE a.file <> b.file)""",
      "t AS (SELECT * FROM cg_symbols WHERE kind = 'function' ORDER BY fan_in DESC, seq LIMIT 50)"),
    "p7_change_kind": """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'rename') THEN 'rename' WHEN contains(lower(text), 'delete') OR contains(lower(text), 'remove') THEN 'delete'
      WHEN contains(lower(text), 'signature') OR contains(lower(text), 'parameter') OR contains(lower(text), 'argument') THEN 'signature' ELSE 'behavior' END AS kind FROM conversations""",
    "a16_churn_banner": _q("SELECT bool_and(churn = 0) AS all_quiet, COUNT(*) FILTER (kind = 'module') < 3 AS few_files FROM cg_symbols"),
    "j2_resolve_calls": "SELECT DISTINCT CAST(p.p_partkey AS VARCHAR) AS source, CAST(f.k AS VARCHAR) AS target FROM part p JOIN (SELECT p_name, MIN(p_partkey) AS k FROM part GROUP BY 1) f ON f.p_name = p.p_name WHERE f.k <> p.p_partkey",
    "r1_name_tokens": _q(f"SELECT id, array_to_string({_tokens('v')}, ' ') AS tokens FROM styled",
      """styled AS (SELECT id, CASE pk % 4 WHEN 0 THEN name WHEN 1 THEN replace(name, '_', '-')
  WHEN 2 THEN array_to_string(list_transform(string_split(name, '_'), lambda x: upper(x[1]) || x[2:]), '') ELSE replace(name, '_', ' ') || '.x' END AS v FROM cg_sym)"""),
    "r3_score_symbols": _q(f"""SELECT id, ROUND(SUM((l + CASE WHEN l <= 8 AND sh > 0 THEN 6 * sh + FLOOR(4 * sh / n + 0.5) ELSE 0 END) * w) + 0.5, 6) AS score FROM (
      SELECT s.id, h.w, CASE WHEN s.qn = h.h OR ends_with(s.qn, '.' || h.h) THEN 30 WHEN s.n = h.h THEN 26 WHEN contains(s.n, h.h) OR contains(h.h, s.n) THEN 8
          WHEN contains(s.qn, h.h) THEN 4 ELSE 0 END AS l,
        len(list_filter({_tokens('h.h')}, lambda x: list_contains(s.t, x))) AS sh, len({_tokens('h.h')}) AS n
      FROM (SELECT id, lower(name) AS n, lower(replace(file, '/', '.') || '.' || name) AS qn, {_tokens('name')} AS t FROM cg_sym) s,
        (VALUES ('red_widget_1', 1.0::DOUBLE), ('blue bolt', 0.35::DOUBLE), ('promo', 0.35::DOUBLE)) h(h, w)) q GROUP BY id"""),
    "f1_skipped": _PATHS + """SELECT id, k IN (1, 2, 3, 4, 5) OR e IN (1, 2, 3) AS skipped, k IN (1, 2, 7) OR e = 7 AS secret,
      ['.py', '.ts', '.ts', '.js', '.rb', '.sql', '.go', '.pem', '.css', '.tsx', '.vue'][e + 1] AS ending,
      CASE WHEN e = 0 THEN 'python' WHEN e IN (1, 2, 3, 9) THEN 'javascript' WHEN e = 6 THEN 'go' END AS language FROM p""",
    "a2_skipped_endings": _PATHS + """SELECT CASE e WHEN 4 THEN '.rb' WHEN 5 THEN '.sql' WHEN 8 THEN '.css' ELSE '.vue' END AS ending, COUNT(*) AS files
      FROM p WHERE e IN (4, 5, 8, 10) GROUP BY 1 ORDER BY files DESC, ending LIMIT 4""",
    "r5_identifiers": f"""WITH c AS (SELECT page_id AS id, {_BLANKED} AS code FROM pages),
      f AS (SELECT id, unnest(regexp_extract_all(code, '\\b([A-Za-z_][A-Za-z0-9_]+)\\s*\\(', 1)) AS name, true AS call FROM c
        UNION ALL SELECT id, unnest(regexp_extract_all(code, '(?:\\.|::|->)([A-Za-z_][A-Za-z0-9_]+)', 1)), false FROM c
        UNION ALL SELECT id, unnest(regexp_extract_all(code, '<([A-Z][A-Za-z0-9_]*)', 1)), true FROM c)
      SELECT id, name, COUNT(*) AS occurrences, bool_or(call) AS has_call, bool_or(NOT call) AS has_member FROM f
      WHERE length(name) >= 3 AND name NOT IN ({", ".join(f"'{w}'" for w in SNIPPET_STOP)}) GROUP BY id, name""",
    "r8_repository": r"SELECT page_id, regexp_extract(url, '^(?:[a-z]+://)?([^/]+)', 1) AS host, regexp_extract(url, '^(?:[a-z]+://)?[^/]+/([^/?#]+)', 1) AS folder FROM pages",
    "f9_search": _q("SELECT id FROM cg_nodes WHERE contains(lower(name), 'promo') OR contains(lower(file), 'promo') UNION ALL SELECT id FROM cg_nodes WHERE contains(lower(name), '_7') OR contains(lower(file), '_7')"),
    "f10_visible": "SELECT c_custkey AS id, c_nationkey AS owner_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'public' ELSE 'private' END AS visibility FROM customer WHERE c_nationkey = 3 OR c_mktsegment = 'BUILDING'",
    "a13_churn": _q("SELECT s.file, CAST(COUNT(*) FILTER (l.l_shipdate >= TIMESTAMP '2001-10-01' - INTERVAL 90 DAYS) AS BIGINT) AS churn, CAST(MAX(l.l_shipdate) AS DATE) AS last_commit FROM lineitem l JOIN cg_sym s ON s.pk = l.l_partkey GROUP BY s.file"),
}

# Bands and bundles of figures that have their SQL above.
ORACLE_SQL["p9_health_bands"] = f"""SELECT CASE WHEN diameter <= 7 THEN 'good' WHEN diameter <= 10 THEN 'warn' ELSE 'bad' END AS diameter_band,
  CASE WHEN avg_path <= 4 THEN 'good' WHEN avg_path <= 6 THEN 'warn' ELSE 'bad' END AS path_band,
  CASE WHEN density BETWEEN 0.08 AND 0.35 THEN 'good' WHEN density BETWEEN 0.05 AND 0.5 THEN 'warn' ELSE 'bad' END AS density_band,
  CASE WHEN components = 1 THEN 'good' WHEN components <= 2 THEN 'warn' ELSE 'bad' END AS component_band,
  CASE WHEN health >= 80 THEN 5 WHEN health >= 65 THEN 4 WHEN health >= 50 THEN 3 WHEN health >= 35 THEN 2 ELSE 1 END AS dots
  FROM ({ORACLE_SQL["g8_health"]}) h"""
ORACLE_SQL["g9_all_metrics"] = f"""SELECT id, ROUND(pagerank, 6) AS pagerank, ROUND(share, 6) AS percentile, ROUND(betweenness, 6) AS betweenness, clustering,
  COALESCE(i.n, 0) AS fan_in, COALESCE(o.n, 0) AS fan_out, i.n IS NULL AS orphan,
  CASE WHEN betweenness > 0.5 THEN 'critical' WHEN betweenness > 0.25 THEN 'review' ELSE 'normal' END AS flow,
  CASE WHEN clustering >= 0.6 THEN 'high' WHEN clustering >= 0.3 THEN 'medium' ELSE 'low' END AS cohesion,
  CAST(FLOOR((1 - share) * 100 + 0.5) AS INT) AS top_percent
  FROM (SELECT *, percent_rank() OVER (ORDER BY pagerank) AS share FROM ({ORACLE_SQL["g1_pagerank"]}) a) p
  JOIN ({ORACLE_SQL["g2_betweenness"]}) b USING (id) JOIN ({ORACLE_SQL["g3_clustering"]}) c USING (id)
  LEFT JOIN ({_q("SELECT target, COUNT(*) AS n FROM ug_edges GROUP BY 1")}) i ON i.target = id
  LEFT JOIN ({_q("SELECT source, COUNT(*) AS n FROM ug_edges GROUP BY 1")}) o ON o.source = id"""
ORACLE_SQL["g13_aggregate_plan"] = _q(
    f"""SELECT id, CAST(distance AS INT) AS distance, CASE WHEN distance <= 2 THEN 'high' WHEN distance <= 4 THEN 'medium' ELSE 'low' END AS priority, ROUND({_SECONDS}, 6) AS seconds
    FROM (SELECT id, MIN(d) AS distance FROM wk WHERE d > 0 AND id <> start GROUP BY id) w JOIN cg_nodes USING (id) WHERE {_TEST}""",
    """st AS ((SELECT id FROM cg_symbols WHERE kind = 'function' ORDER BY fan_in DESC, id LIMIT 2) UNION
  SELECT arg_min(id, seq) FROM cg_nodes WHERE type = 'function' AND file LIKE 'tests/%' GROUP BY file),
wk(start, id, d) AS (SELECT id, id, 0 FROM st UNION SELECT w.start, e.source, w.d + 1 FROM wk w JOIN cg_edges e ON e.target = w.id WHERE w.d < 8)""",
)
