"""The registered queries over derived graphs, one or more for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .graph import CodeGraph
from .operators import impact, ingest, layers, metrics, resolve, testplan, traverse
from .plans.lineage import cut
from .sources import derived
from .sources.adjacency import PackedAdjacency


def _graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The part graph, cut from its tables, or as it is stored."""
    stored = derived.prepared(spark, sf_dir)
    if stored:
        return stored.parts
    g = derived.part_graph(spark, sf_dir)
    return CodeGraph(cut(g.nodes), cut(g.edges))


def _symbols(spark: SparkSession, sf_dir: str, g: CodeGraph) -> DataFrame:
    churn = derived.part_churn(spark, sf_dir)
    rows = g.nodes.join(metrics.degrees(g), "id").join(churn, "id", "left").na.fill(0, ["churn"])
    return rows.select("id", "file", "name", F.when(F.col("type") == "file", "module").otherwise("function").alias("kind"), "fan_in", "fan_out", "churn", "seq")


def _target(symbols: DataFrame) -> DataFrame:
    """The function with most callers."""
    return symbols.where("kind = 'function'").orderBy(F.desc("fan_in"), "id").limit(1)


def _case(spark: SparkSession, sf_dir: str) -> tuple[CodeGraph, DataFrame, DataFrame]:
    g, stored = _graph(spark, sf_dir), derived.prepared(spark, sf_dir)
    symbols = stored.symbols if stored else cut(_symbols(spark, sf_dir, g))
    return g, symbols, cut(_target(symbols))


def prepare(spark: SparkSession, sf_dir: str) -> derived.Prepared:
    """Stores the graphs of a folder of tables, with packed edges, for the queries that follow in this session."""
    g, users = derived.part_graph(spark, sf_dir), derived.user_graph(spark, sf_dir).closed()
    g, users = CodeGraph(cut(g.nodes), cut(g.edges)), CodeGraph(cut(users.nodes), cut(users.edges))
    made = derived.Prepared(
        g, cut(_symbols(spark, sf_dir, g)), PackedAdjacency.build(g.edges, reverse=True), PackedAdjacency.build(g.edges, both=True), users, PackedAdjacency.build(users.edges)
    )
    return derived.keep_prepared(spark, sf_dir, made)


def _callers(spark: SparkSession, sf_dir: str, g: CodeGraph) -> DataFrame | PackedAdjacency:
    stored = derived.prepared(spark, sf_dir)
    return stored.callers if stored else g.edges


def _numbered(g: CodeGraph) -> CodeGraph:
    """Edges with a seq that orders them by source and target among those of a node."""
    return CodeGraph(g.nodes, g.edges.withColumn("seq", F.concat_ws(" ", "type", "source", "target")))


def a1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.part_graph(spark, sf_dir)
    kinds = g.nodes.groupBy("type").agg(F.count("*").alias("n"))
    return kinds.unionByName(g.edges.groupBy("type").agg(F.count("*").alias("n")))


def a8_fan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.degrees(derived.part_graph(spark, sf_dir))


def j13_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir, _graph(spark, sf_dir))


def j15_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, target = _case(spark, sf_dir)
    return traverse.neighbours(g, target)


def g5_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.orphans(derived.part_graph(spark, sf_dir))


def g1_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = derived.prepared(spark, sf_dir)
    ranks = metrics.pagerank(stored.users, forward=stored.links) if stored else metrics.pagerank(derived.user_graph(spark, sf_dir))
    return ranks.select("id", F.round("pagerank", 8).alias("pagerank"))


def w1_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = metrics.percentile(metrics.degrees(derived.part_graph(spark, sf_dir)).select("id", F.col("fan_in").cast("double").alias("score")), "score")
    return ranked.select("id", F.round("percentile", 6).alias("percentile"))


def g2_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.betweenness(derived.user_graph(spark, sf_dir)).select("id", F.round("betweenness", 8).alias("betweenness"))


def g3_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.clustering(derived.user_graph(spark, sf_dir)).select("id", F.round("clustering", 6).alias("clustering"))


def g7_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weak_components(derived.user_graph(spark, sf_dir))


def a11_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.density(derived.part_graph(spark, sf_dir)).select(F.round("density", 8).alias("density"))


def g6_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.user_graph(spark, sf_dir)
    return metrics.distances(g, metrics.stride_sample(g.nodes, 60))


def g8_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.graph_stats(derived.user_graph(spark, sf_dir), import_types=("calls",))
    return stats.select("diameter", "avg_path", F.round("density", 8).alias("density"), "components", "cycles", "health")


def g4_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cycles(derived.part_graph(spark, sf_dir), ("imports",))


def g4_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest cycle through the least of each component: of users, and of files along the imports within their folder."""
    users, g = derived.user_graph(spark, sf_dir), derived.part_graph(spark, sf_dir)
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    near = CodeGraph(g.nodes, g.edges.where((F.col("type") == "imports") & (folder("source") == folder("target"))))
    of_users = metrics.cycle_witnesses(users, ("calls",)).select(F.lit("users").alias("graph"), F.col("cycle").cast("string").alias("cycle"), "at", F.col("id").cast("string").alias("id"))
    return of_users.unionByName(metrics.cycle_witnesses(near).select(F.lit("files").alias("graph"), "cycle", "at", "id"))


def g23_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, symbols, target = _case(spark, sf_dir)
    return impact.affected(symbols, _callers(spark, sf_dir, g), target).select("id", "depth", "fan_in", "churn", "risk")


def a7_impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, symbols, target = _case(spark, sf_dir)
    return impact.summary(impact.affected(symbols, _callers(spark, sf_dir, g), target))


def p3_continuous_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, symbols, target = _case(spark, sf_dir)
    return impact.continuous_risk(impact.affected(symbols, _callers(spark, sf_dir, g), target, 4)).select("id", "depth", "score", "level")


def p4_criticality(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, symbols, target = _case(spark, sf_dir)
    found = cut(impact.affected(symbols, _callers(spark, sf_dir, g), target))
    kinds = ("behavior", "delete", "rename", "signature")
    rows = [impact.criticality(found, target, kind).select(F.lit(kind).alias("kind"), "*") for kind in kinds]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return every.withColumn("reasons", F.array_join("reasons", "; "))


def g24_impact_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, target = _case(spark, sf_dir)
    return impact.hard_capped(_numbered(g).edges, target)


def g23_impact_soft_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, target = _case(spark, sf_dir)
    return impact.soft_capped(_numbered(g).edges, target)


def a5_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.hotspots(_symbols(spark, sf_dir, _graph(spark, sf_dir)))


def a6_risky_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.risky_files(_symbols(spark, sf_dir, _graph(spark, sf_dir)))


def a3_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.module_nodes(derived.part_graph(spark, sf_dir))


def a4_module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.module_edges(derived.part_graph(spark, sf_dir))


def g19_file_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.file_graph(derived.part_graph(spark, sf_dir)).edges


def g17_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, target = _case(spark, sf_dir)
    stored = derived.prepared(spark, sf_dir)
    return traverse.focus(g, target, 2, stored.around if stored else None).edges.select("source", "target", "type")


def g18_focus_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.focus_module(_graph(spark, sf_dir), "tests").nodes.select("id")


def t2_top_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return layers.top_symbols(g, metrics.degrees(g).select("id", F.col("fan_in").alias("score")), 100).edges.select("source", "target", "type")


def _ranks(g: CodeGraph) -> DataFrame:
    return metrics.pagerank(g).select("id", F.round("pagerank", 8).alias("score"))


def t1_top_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nodes of the part graph with the highest rank."""
    return metrics.top(_ranks(_graph(spark, sf_dir)), "score", 25)


def w3_low_signal_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return layers.low_signal(g, _ranks(g))


def w3_low_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return layers.low_signal(g, metrics.degrees(g).select("id", F.col("fan_in").alias("score")), 0.25, 1)


def w4_zone_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.zone_leaders(_graph(spark, sf_dir))


def t7_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derived.part_graph(spark, sf_dir).nodes
    return nodes.groupBy(paths.module_key(F.col("file")).alias("zone")).agg(F.count("*").alias("n"))


def g10_covering_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, target = _case(spark, sf_dir)
    return testplan.covering_tests(g, target, callers=_callers(spark, sf_dir, g))


def g12_test_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, target = _case(spark, sf_dir)
    return testplan.test_plan(g, target).select("id", "distance", "priority", F.round("seconds", 6).alias("seconds"))


def a10_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, target = _case(spark, sf_dir)
    return testplan.plan_summary(g, testplan.test_plan(g, target)).select("tests", F.round("seconds", 3).alias("seconds"), F.round("all_seconds", 3).alias("all_seconds"), "saved_percent")


def g11_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testplan.coverage(_graph(spark, sf_dir))


def a9_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testplan.coverage_summary(testplan.covered(_graph(spark, sf_dir)))


def g15_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testplan.dead_code(_graph(spark, sf_dir))


def a15_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testplan.inbound(_graph(spark, sf_dir))


def g16_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, target = _case(spark, sf_dir)
    return testplan.proposals(_numbered(g), target.select("id"))


def g13_aggregate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for a change of all promotional parts' files' first functions and of the two most-called functions."""
    g, symbols, _ = _case(spark, sf_dir)
    best = symbols.where("kind = 'function'").orderBy(F.desc("fan_in"), "id").limit(2).select("id")
    first = g.nodes.where("type = 'function' and file like 'tests/%'").groupBy("file").agg(F.min_by("id", "seq").alias("id")).select("id")
    return testplan.aggregate_plan(g, best.unionByName(first)).select("id", "distance", "priority", F.round("seconds", 6).alias("seconds"))


def a14_plan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, target = _case(spark, sf_dir)
    return testplan.plan_groups(testplan.test_plan(g, target)).select("priority", "tests", F.round("seconds", 3).alias("seconds"))


def s13_plan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, target = _case(spark, sf_dir)
    return testplan.plan_json(testplan.test_plan(g, target))


def s13_plan_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, target = _case(spark, sf_dir)
    return testplan.shell_export(testplan.test_plan(g, target), g.nodes).select("command")


def g14_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testplan.files_changed(derived.part_graph(spark, sf_dir), F.lit("tests/test_brand_1.py, src/eco/brand_2.py\nsrc/eco/none.py,,"))


def g25_reaching_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = layers.file_graph(_graph(spark, sf_dir))
    root = g.nodes.orderBy("seq", "id").limit(1).select("id")
    return traverse.highlighted_edges(g, root)


def j14_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.contains_edges(derived.part_graph(spark, sf_dir))


def f8_visible_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.visible(derived.part_graph(spark, sf_dir), ["function"], ["calls", "imports"]).edges.select("source", "target", "type")


def f14_highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, target = _case(spark, sf_dir)
    return layers.highlighted(g, target.select("id")).withColumn("by", F.lit("active")).unionByName(layers.highlighted(g, target, " Promo").withColumn("by", F.lit("search")))


def g20_abstraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the three levels within the tests' module."""
    g = _graph(spark, sf_dir)
    levels = [layers.apply_abstraction(g, level, "tests").edges.select(F.lit(level).alias("level"), "source", "target", "type") for level in ("module", "file", "symbol")]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def _fan_in(g: CodeGraph) -> DataFrame:
    return cut(metrics.degrees(g).select("id", F.col("fan_in").alias("score")))


def g21_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is hidden in each file if only imports are shown: no function's edges then leave its file."""
    g = _graph(spark, sf_dir)
    hidden = layers.collapsed(CodeGraph(g.nodes, g.edges.where("type = 'imports'")), _fan_in(g), 0.25, 1)[1]
    return hidden.select("file", F.size("hidden").cast("long").alias("n"), F.array_join("hidden", ",").alias("hidden"))


def g22_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return layers.display(g, _fan_in(g), "essential").nodes.select("id")


def p9_health_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.graph_stats(derived.user_graph(spark, sf_dir), import_types=("calls",))
    bands = paths.health_bands(*(F.col(c) for c in ("diameter", "avg_path", "density", "components", "health")))
    return stats.select(*bands)


def g9_all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of the users, with the tags they give (P10)."""
    rows = cut(metrics.all_metrics(derived.user_graph(spark, sf_dir)))
    tags = layers.node_tags(rows)
    digits = [F.round(F.round(c, 8), 6).alias(c) for c in ("pagerank", "percentile", "betweenness", "clustering")]
    return rows.select("id", *digits, "fan_in", "fan_out", "orphan").join(tags, "id")


def p7_change_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = derived.read(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", paths.change_kind(F.col("text")).alias("kind"))


def a16_churn_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _symbols(spark, sf_dir, _graph(spark, sf_dir))
    return symbols.agg(F.bool_and(F.col("churn") == 0).alias("all_quiet"), (F.count_if(F.col("kind") == "module") < 3).alias("few_files"))


def j2_resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers call whatever part shares their order's first letters: names here are part names without keys."""
    named = derived.read(spark, sf_dir, "part").select("p_name", F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("id"))
    symbols = named.select(F.col("p_name").alias("name"), "id", "seq")
    calls = derived.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source"), F.col("p_name").alias("callee"))
    return resolve.resolve_calls(calls, symbols)


def r1_name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in four styles by their part's key: snake, kebab, camel, and words with a dotted ending, which spaces don't part."""
    symbols, name = derived.part_symbols(spark, sf_dir), F.col("name")
    camel, spaced = F.replace(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("")), F.concat(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(".x"))
    styled = F.element_at(F.array(name, F.replace(name, F.lit("_"), F.lit("-")), camel, spaced), (F.col("pk") % 4 + 1).cast("int"))
    return symbols.select("id", F.array_join(paths.name_tokens(styled), " ").alias("tokens"))


def r3_score_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = derived.part_symbols(spark, sf_dir).select("id", "name", F.concat_ws(".", F.regexp_replace("file", "/", "."), "name").alias("qualified_name"), F.lit("function").alias("kind"))
    return resolve.score_symbols(symbols, [("red_widget_1", True), ("blue bolt", False), ("promo", False)])


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each order: folders and endings by its status, priority and keys."""
    orders = derived.read(spark, sf_dir, "orders")
    folder = F.element_at(F.array(*map(F.lit, ["src", "dist", ".git", "src/components/ui", "lib/out", "app/.hidden", "tests", "vendor"])), (F.col("o_orderkey") % 8 + 1).cast("int"))
    end = F.element_at(F.array(*map(F.lit, [".py", ".d.ts", ".test.ts", ".config.js", ".rb", ".sql", ".go", ".pem", ".css", ".tsx", ".vue"])), (F.col("o_custkey") % 11 + 1).cast("int"))
    return orders.select(F.col("o_orderkey").alias("id"), F.concat(folder, F.lit("/f"), F.col("o_orderkey").cast("string"), end).alias("path"))


def f1_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, sf_dir).select("id", ingest.skipped(path).alias("skipped"), ingest.secret(path).alias("secret"), ingest.ending(path).alias("ending"), ingest.language(path).alias("language"))


def a2_skipped_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.skipped_endings(_paths(spark, sf_dir))


def r5_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member accesses and components in raw pages, as in code."""
    pages = derived.read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("code"))
    return ingest.identifiers(pages)


def r8_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.read(spark, sf_dir, "pages")
    host, folder = resolve.repository(F.col("url"))
    return pages.select("page_id", host.alias("host"), folder.alias("folder"))


def f9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.search(derived.part_graph(spark, sf_dir).nodes, "PROMO").select("id").unionByName(
        resolve.search(derived.part_graph(spark, sf_dir).nodes, "_7").select("id")
    )


def f10_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = derived.read(spark, sf_dir, "customer")
    repos = customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner_id"), F.when(F.col("c_mktsegment") == "BUILDING", "public").otherwise("private").alias("visibility"))
    return resolve.visible(repos, F.lit(3))


def a13_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits to the files of their parts."""
    files = derived.part_symbols(spark, sf_dir).select(F.col("pk").alias("l_partkey"), "file")
    lines = derived.read(spark, sf_dir, "lineitem").join(files, "l_partkey").select(F.col("l_shipdate").alias("ts"), F.array("file").alias("files"))
    return resolve.commit_churn(lines, F.lit("2001-10-01").cast("timestamp"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_counts, a8_fan_counts, j13_symbols, j15_neighbours, g5_orphans, g1_pagerank, w1_percentile, g2_betweenness,
        g3_clustering, g7_components, a11_density, g6_distances, g8_health, g4_cycles, g4_witnesses, g23_impact, a7_impact_summary,
        p3_continuous_risk, p4_criticality, g24_impact_capped, a5_hotspots, a6_risky_files, a3_modules, a4_module_edges,
        g19_file_graph, g17_focus, g18_focus_module, t1_top_by_rank, t2_top_symbols, w3_low_signal_by_rank, w3_low_signal, w4_zone_leaders, t7_zones,
        g10_covering_tests, g12_test_plan, a10_plan_summary, g11_coverage, a9_coverage_summary, g15_dead_code,
        a15_inbound, g16_proposals, g23_impact_soft_cap, g13_aggregate_plan, a14_plan_groups, s13_plan_json, s13_plan_shell,
        g14_changed_files, g25_reaching_edges, j14_contains, f8_visible_types, f14_highlighted, g20_abstraction, g21_collapsed,
        g22_display, p9_health_bands, g9_all_metrics, p7_change_kind, a16_churn_banner, j2_resolve_calls, r1_name_tokens, r3_score_symbols, f1_skipped,
        a2_skipped_endings, r5_identifiers, r8_repository, f9_search,
        f10_visible, a13_churn,
    )
}
