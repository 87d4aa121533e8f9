"""Operators on small graphs whose results are known in closed form."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.graph import CodeGraph
from weftgraph.operators import impact, intervals, layers, metrics, resolve, testplan, traverse
from weftgraph.streaming.churn import daily_churn


def graph(spark, n, pairs, kind="calls"):
    nodes = spark.createDataFrame(
        [(f"n{i}", "function", f"src/m{i % 2}/f.py", f"n{i}", None, i) for i in range(n)],
        "id string, type string, file string, name string, loc int, seq long",
    )
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", kind, i) for i, (a, b) in enumerate(pairs)], "source string, target string, type string, seq long")
    return CodeGraph(nodes, edges)


def test_star_betweenness_and_clustering(spark):
    g = graph(spark, 5, [(i, 0) for i in range(1, 5)])
    b = {r["id"]: r["betweenness"] for r in metrics.betweenness(g).collect()}
    assert b["n0"] == pytest.approx(1.0) and b["n1"] == 0
    assert all(r["clustering"] == 0 for r in metrics.clustering(g).collect())


def test_triangle_clustering(spark):
    g = graph(spark, 3, [(0, 1), (1, 2), (2, 0)])
    assert {r["clustering"] for r in metrics.clustering(g).collect()} == {1.0}


def test_two_nodes_have_no_betweenness(spark):
    assert {r["betweenness"] for r in metrics.betweenness(graph(spark, 2, [(0, 1)])).collect()} == {0.0}


def test_pagerank_sums_to_one_with_dangling_and_parallel_edges(spark):
    g = graph(spark, 4, [(0, 1), (0, 1), (0, 2)])
    ranks = {r["id"]: r["pagerank"] for r in metrics.pagerank(g, 10).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0)
    assert ranks["n1"] > ranks["n2"] > ranks["n3"]


def test_empty_graph(spark):
    g = graph(spark, 1, []).induced(spark.createDataFrame([], "id string"))
    assert metrics.pagerank(g).count() == 0
    assert metrics.graph_stats(g).first()["health"] == 100


def test_components_and_dangling_edges(spark):
    g = graph(spark, 5, [(0, 1), (1, 2), (3, 9)])
    parts = {r["id"]: r["component"] for r in metrics.weak_components(g).collect()}
    assert parts == {"n0": "n0", "n1": "n0", "n2": "n0", "n3": "n3", "n4": "n4"}


def test_reach_depths_and_cycles(spark):
    g = graph(spark, 4, [(0, 1), (1, 2), (2, 0), (3, 2)])
    seed = spark.createDataFrame([("n2",)], "id string")
    assert {r["id"]: r["depth"] for r in traverse.reach(g.edges, seed, None).collect()} == {"n2": 0, "n1": 1, "n3": 1, "n0": 2}
    assert {r["id"] for r in traverse.reach(g.edges, seed, 1).collect()} == {"n2", "n1", "n3"}


def test_self_loop_counts_as_incoming(spark):
    assert {r["id"] for r in metrics.orphans(graph(spark, 2, [(0, 0)])).collect()} == {"n1"}


def test_percentile_equals_percent_rank(spark):
    rows = spark.createDataFrame([(i, float(i // 3)) for i in range(10)], "id long, score double")
    got = {r["id"]: r["percentile"] for r in metrics.percentile(rows, "score").collect()}
    want = {i: sum(j // 3 < i // 3 for j in range(10)) / 9 for i in range(10)}
    assert got == pytest.approx(want)


def test_stride_sample_is_by_seq(spark):
    g = graph(spark, 61, [])
    got = sorted(int(r["id"][1:]) for r in metrics.stride_sample(g.nodes, 60).collect())
    assert got == sorted({i * 61 // 60 for i in range(60)})


def test_module_key_and_bare_name(spark):
    cases = {"a.py": "root", "src/a.py": "src", "src/x/y/a.py": "src/x", "": "root"}
    got = spark.createDataFrame([(k,) for k in cases], "f string").select("f", paths.module_key(F.col("f")).alias("m")).collect()
    assert {r["f"]: r["m"] for r in got} == cases
    assert spark.range(1).select(paths.bare_name(F.lit("a::B.c"))).first()[0] == "c"


def test_paths_resolve_to_the_first_candidate(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/a.js",), ("src/b/index.tsx",)], "path string")
    asked = spark.createDataFrame([("src/q/x.ts", s) for s in ("../a", "./../b", "@/none", "react", "../../src/q/../b")] + [("y.ts", "~/a")], "source string, path string")
    got = {(r["source"], r["target"]) for r in resolve.resolve_scripts(asked, files).collect()}
    assert got == {("src/q/x.ts", "src/a.ts"), ("src/q/x.ts", "src/b/index.tsx"), ("y.ts", "src/a.ts")}


def test_match_must_be_sure_or_ahead(spark):
    rows = lambda *s: spark.createDataFrame(list(s), "id string, score long")
    assert resolve.best_match(rows(("a", 30), ("b", 30))).first()["id"] == "a"
    assert resolve.best_match(rows(("a", 8), ("b", 8))).count() == 0
    assert resolve.best_match(rows(("a", 8), ("b", 7))).first()["id"] == "a"
    assert resolve.best_match(rows(("a", 3))).count() == 0


def test_cap_keeps_the_nearest(spark):
    g = graph(spark, 151, [(i, 0) for i in range(1, 151)])
    start = spark.createDataFrame([("n0",)], "id string")
    symbols = g.nodes.join(metrics.degrees(g), "id").withColumn("churn", F.lit(0))
    assert impact.affected(symbols, g.edges, start).count() == 150
    assert {r["id"] for r in impact.hard_capped(g.edges, start, cap=100).collect()} == {f"n{i}" for i in range(1, 101)}
    assert impact.soft_capped(g.edges, start, limit=101).count() == 150  # all callers of an opened node are taken


def opened_by_hand(edges, start, depth, limit):
    far, queue = {start: 0}, [start]
    while queue and len(far) <= limit:
        node = queue.pop(0)
        if far[node] < depth:
            for s, t in edges:
                if t == node and s not in far:
                    far[s] = far[node] + 1
                    queue.append(s)
    return {f"n{k}": v for k, v in far.items() if v}


@pytest.mark.parametrize("limit", [1, 5, 9, 20, 500])
def test_soft_cap_equals_a_queue(spark, limit):
    rng = random.Random(limit)
    pairs = list(dict.fromkeys((rng.randrange(60), rng.randrange(60)) for _ in range(150)))
    g = graph(spark, 60, pairs)
    got = {r["id"]: r["depth"] for r in impact.soft_capped(g.edges, spark.createDataFrame([("n0",)], "id string"), 4, limit).collect()}
    assert got == opened_by_hand(pairs, 0, 4, limit)


@pytest.mark.parametrize(
    ("kind", "fan_in", "depths", "level", "points"),
    [("behavior", 0, [], "minor", 0), ("rename", 1, [3], "moderate", 9.28), ("delete", 5, [1], "critical", 57.68), ("signature", 1, [1] * 5, "critical", 46.4),
     ("behavior", 2, [1, 2], "moderate", 19.6), ("behavior", 9, [1, 3], "significant", 45.6), ("delete", 0, [], "minor", 10)],
)
def test_criticality_floors(spark, kind, fan_in, depths, level, points):
    found = spark.createDataFrame([(f"a{i}", d) for i, d in enumerate(depths)], "id string, depth int")
    row = impact.criticality(found, spark.createDataFrame([(fan_in,)], "fan_in long"), kind).first()
    assert (row["level"], row["points"]) == (level, pytest.approx(points))
    assert any("every caller" in r for r in row["reasons"]) == (kind != "behavior")


def test_hotspots_without_any_use(spark):
    symbols = spark.createDataFrame([("a", "f1", 0, 0, 0), ("b", "f2", 0, 0, 0)], "id string, file string, fan_in long, fan_out long, churn long")
    assert {(r["share"], r["band"]) for r in impact.hotspots(symbols).collect()} == {(0.0, "low")}


def test_clustering_with_loops_equals_brute_force(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(40)] + [(3, 3), (5, 5)]
    g = graph(spark, 13, pairs)
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(13)}
    want = {f"n{i}": 2 * sum(q in near[p] for p in n for q in n if p < q) / (len(n) * (len(n) - 1)) if len(n) > 1 else 0.0 for i, n in near.items()}
    assert {r["id"]: r["clustering"] for r in metrics.clustering(g).collect()} == pytest.approx(want)


def test_dead_code_spares_what_is_alive(spark):
    rows = [("a", "function", "src/x.py", "__init__"), ("b", "function", "src/x.py", "on_event"), ("c", "function", "src/cli.py", "go"), ("d", "function", "src/x.py", "main"),
            ("e", "function", "src/api.py", "thing"), ("f", "function", "src/x.py", "K.method"), ("g", "function", "src/x.py", "lost"), ("h", "file", "src/alone.py", "src/alone.py"),
            ("i", "file", "src/__init__.py", "src/__init__.py"), ("j", "function", "tests/test_x.py", "test_y"), ("k", "function", "src/x.py", "on_")]
    nodes = spark.createDataFrame([(*r, None, i) for i, r in enumerate(rows)], "id string, type string, file string, name string, loc int, seq long")
    dead = testplan.dead_code(CodeGraph(nodes, spark.createDataFrame([], "source string, target string, type string, seq long")))
    assert {r["id"]: r["reason"] for r in dead.collect()} == {"f": "likely-dispatch", "g": "no callers", "h": "no importers", "j": "orphan test", "k": "no callers"}


def test_stream_of_files_replaces_repositories(spark, tmp_path):
    from weftgraph.streaming.churn import keep_files_current

    write = lambda rows: spark.createDataFrame(rows, "repo_id int, path string, content string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for rows in ([(1, "a", "old"), (2, "b", "stays")], [(1, "a", "new"), (1, "c", "more")]):
        write(rows)
        keep_files_current(spark.readStream.schema("repo_id int, path string, content string").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    got = {(r["repo_id"], r["path"], r["content"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, "a", "new"), (1, "c", "more"), (2, "b", "stays")}


def test_low_inbound_demotes_dead_code(spark):
    g = graph(spark, 60, [(0, i) for i in range(1, 7)])
    assert testplan.inbound(g).first()["low_confidence"]
    assert {r["reason"] for r in testplan.dead_code(g).collect()} == {"likely-dispatch"}


def test_density_knobs():
    assert layers.density_knobs("essential", 9)["top_k"] == 50
    assert layers.density_knobs("all", 9)["top_k"] == 9
    assert layers.density_knobs("balanced", 9)["keep_ratio"] == 0.5


def test_daily_churn_stream(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "a"), ("2024-01-01 12:00:00", "a"), ("2024-01-02 01:00:00", "b")]
    spark.createDataFrame(rows, "ts string, file string").select(F.to_timestamp("ts").alias("ts"), "file").write.parquet(str(tmp_path / "in"))
    stream = daily_churn(spark.readStream.schema("ts timestamp, file string").parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("churn").start()
    query.processAllAvailable()
    query.stop()
    assert {(str(r["day"]), r["file"]): r["commits"] for r in spark.table("churn").collect()} == {("2024-01-01", "a"): 2, ("2024-01-02", "b"): 1}


def test_notebook_source(spark):
    import json

    from weftgraph.operators.ingest import notebook_source

    book = {"cells": [
        {"cell_type": "code", "source": ["import a\n", "%magic\n", "b = 1"]},
        {"cell_type": "markdown", "source": "text"},
        {"cell_type": "code", "source": "!ls\nc = [2]"},
    ]}
    rows = spark.createDataFrame([(json.dumps(book),), ("no json",), (json.dumps({"cells": []}),)], "content string")
    assert [r[0] for r in rows.select(notebook_source(F.col("content"))).collect()] == ["import a\nb = 1\n\nc = [2]", None, None]


@pytest.mark.parametrize(
    ("path", "out"),
    [("src/a.py", False), ("node_modules/x.js", True), (".github/a.py", True), ("a/.b/c.py", True), ("src/x.d.ts", True),
     ("src/x.spec.TSX", True), ("vite.config.ts", True), ("src/hooks/use-toast.ts", True), ("supabase/a.ts", True), ("build", False)],
)
def test_skipped_paths(spark, path, out):
    from weftgraph.operators.ingest import skipped

    assert spark.range(1).select(skipped(F.lit(path))).first()[0] == out


def test_hints_rank_as_documented(spark):
    rows = [("a", "parse", "core.parse", "function"), ("b", "Parse", "core.Parse", "class"), ("c", "reparse", "x.reparse", "method"), ("d", "other", "parse.other", "function")]
    symbols = spark.createDataFrame(rows, "id string, name string, qualified_name string, kind string")
    got = {r["id"]: r["score"] for r in resolve.score_symbols(symbols, [("core.parse", True)]).collect()}
    assert got["a"] == 30.5 and got["b"] == 30.25 and got["c"] == 0.5 and got["d"] == 0.5


def test_cycles_by_component(spark):
    g = graph(spark, 10, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5), (6, 7), (8, 6)], "imports")
    got = {r["id"]: (r["cycle"], r["size"]) for r in metrics.cycles(g).collect()}
    assert got == {"n0": ("n0", 3), "n1": ("n0", 3), "n2": ("n0", 3), "n3": ("n3", 2), "n4": ("n3", 2), "n5": ("n5", 1)}


def test_import_resolvers(spark):
    frame = spark.createDataFrame
    includes = frame([("a.c", "util/x.h"), ("a.c", "none.h")], "source string, path string")
    files = frame([("lib/x.h", 1), ("src/util/x.h", 2)], "path string, seq long")
    assert [tuple(r) for r in resolve.resolve_includes(includes, files).collect()] == [("a.c", "lib/x.h")]
    inside = frame([("a.c", "x.h")], "source string, path string")
    assert resolve.resolve_includes(inside, frame([("lib/my_x.h", 1), ("x.h", 2)], "path string, seq long")).first()["target"] == "lib/my_x.h"
    packages = frame([("m.go", "example.org/app/pkg/db")], "source string, path string")
    folders = frame([("db", "x/db.go"), ("pkg/db", "app/pkg/db/db.go")], "folder string, target string")
    assert resolve.resolve_packages(packages, folders).first()["target"] == "app/pkg/db/db.go"
    classes = frame([("A.java", "org.shop.Cart.Item")], "source string, path string")
    named = frame([("Cart", "shop/Cart.java"), ("Item", "shop/Item.java")], "name string, target string")
    assert resolve.resolve_classes(classes, named).first()["target"] == "shop/Item.java"
    calls = frame([("f", 15, "g"), ("f", 45, "h")], "file string, at int, name string")
    spans = frame([("f", "outer", 0, 40), ("f", "inner", 10, 20)], "file string, caller string, start int, end int")
    assert {(r["name"], r["caller"]) for r in intervals.enclosing(calls, spans).collect()} == {("g", "inner")}


def test_cycles_are_written_out(spark):
    """Several components, one of a node alone, one whose least node has a longer and a shorter way round, and ways that lead nowhere."""
    edges = ["a b", "b c", "c d", "d a", "b e", "e a", "e f", "f g", "x x", "m n", "n m", "n z", "q r", "r s", "s t", "t q", "r t"]
    ids = sorted({v for e in edges for v in e.split()})
    g = CodeGraph(
        spark.createDataFrame([(i, "file", i, i, None, k) for k, i in enumerate(ids)], "id string, type string, file string, name string, loc int, seq long"),
        spark.createDataFrame([(*e.split(), "imports") for e in edges], "source string, target string, type string"),
    )
    found = {}
    for r in sorted(metrics.cycle_witnesses(g).collect(), key=lambda r: r["at"]):
        found.setdefault(r["cycle"], []).append(r["id"])
    assert found == {"a": ["a", "b", "e"], "x": ["x"], "m": ["m", "n"], "q": ["q", "r", "t"]}
    assert metrics.cycle_witnesses(CodeGraph(g.nodes, g.edges.where("source = 'n' and target = 'z'"))).count() == 0


@pytest.mark.parametrize(
    ("address", "found"),
    [("a/b", ("a", "b")), (" a/b.git ", ("a", "b")), ("https://github.com/a/b/tree/x", ("a", "b")), ("HTTP://GitHub.com/a/b.git", ("a", "b")),
     ("git@github.com:a/b.git", ("a", "b")), ("https://other.org/a/b", None), ("a/b/c", None), ("a b/c", None), ("", None), (None, None)],
)
def test_addresses_of_repositories(spark, address, found):
    row = spark.range(1).select(resolve.owner_and_name(F.lit(address).cast("string")).alias("r")).first()["r"]
    assert (tuple(row) if row else None) == found
