"""Abstraction of a graph: modules, files, and trimming of what carries little signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import module_key
from ..graph import CodeGraph, induced_edges
from .traverse import reach


def module_nodes(graph: CodeGraph) -> DataFrame:
    """(module, files, symbols) of every module."""
    return graph.nodes.groupBy(module_key(F.col("file")).alias("module")).agg(
        F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") != "file").alias("symbols")
    )


def module_edges(graph: CodeGraph) -> DataFrame:
    """(source, target, type, weight): edges between different modules, counted."""
    at = graph.nodes.select("id", module_key(F.col("file")).alias("m"))
    ends = graph.edges.join(at.withColumnsRenamed({"id": "source", "m": "from"}), "source").join(at.withColumnsRenamed({"id": "target", "m": "to"}), "target")
    return ends.where("from <> to").groupBy(F.col("from").alias("source"), F.col("to").alias("target"), "type").agg(F.count("*").alias("weight"))


def file_graph(graph: CodeGraph) -> CodeGraph:
    """File nodes and the distinct edges among them."""
    files = graph.nodes.where("type = 'file'")
    return CodeGraph(files, induced_edges(graph.edges, files.select("id")).select("source", "target", "type").distinct())


def focus_module(graph: CodeGraph, module: str) -> CodeGraph:
    """A module's nodes, their neighbours, and the edges among all of these."""
    members = graph.nodes.where(module_key(F.col("file")) == module).select("id")
    return graph.induced(reach(graph.edges, members, 1, both=True).select("id"))


def top_symbols(graph: CodeGraph, scores: DataFrame, k: int) -> CodeGraph:
    """All files and the k symbols with the best score (id, score; none counts as 0, ties by seq), with their edges."""
    symbols = graph.nodes.where("type <> 'file'").join(scores.select("id", "score"), "id", "left").na.fill(0, ["score"])
    best = symbols.orderBy(F.desc("score"), "seq").limit(k).select("id")
    return graph.induced(best.unionByName(graph.nodes.where("type = 'file'").select("id")))


def low_signal(graph: CodeGraph, scores: DataFrame, keep_ratio: float = 0.5, min_per_file: int = 2) -> DataFrame:
    """(id, file, hidden): each symbol, hidden if it is beyond its file's share by score and no edge leaves its file."""
    at = graph.nodes.select("id", "file")
    ends = graph.edges.join(at.withColumnsRenamed({"id": "source", "file": "f"}), "source").join(at.withColumnsRenamed({"id": "target", "file": "t"}), "target").where("f <> t")
    crossing = ends.select(F.col("source").alias("id")).unionByName(ends.select(F.col("target").alias("id"))).distinct().withColumn("crossing", F.lit(True))
    per_file = Window.partitionBy("file")
    symbols = graph.nodes.where("type <> 'file'").join(scores.select("id", "score"), "id", "left").na.fill(0, ["score"])
    placed = symbols.withColumn("place", F.row_number().over(per_file.orderBy(F.desc("score"), "seq"))).withColumn("n", F.count("*").over(per_file))
    keep = F.greatest(F.lit(min_per_file), F.ceil(F.col("n") * F.lit(keep_ratio)))
    return placed.join(crossing, "id", "left").select("id", "file", (~F.coalesce("crossing", F.lit(False)) & (F.col("place") > keep)).alias("hidden"))


def collapsed(graph: CodeGraph, scores: DataFrame, keep_ratio: float = 0.5, min_per_file: int = 2) -> tuple[CodeGraph, DataFrame]:
    """The graph without low_signal() symbols, and (file, hidden): the ids hidden in each file that has a node, in order of the score."""
    marked = low_signal(graph, scores, keep_ratio, min_per_file)
    hidden = marked.where("hidden").join(scores.select("id", "score"), "id", "left").na.fill(0, ["score"]).join(graph.nodes.select("id", "seq"), "id")
    files = graph.nodes.where("type = 'file'").groupBy("file").agg(F.min_by("id", "seq").alias("node"))
    listed = hidden.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("score"), "seq", "id"))), lambda h: h["id"]).alias("hidden"))
    keep = graph.nodes.join(marked.where("hidden").select("id"), "id", "left_anti").select("id")
    return graph.induced(keep), listed.join(files, "file").select(F.col("node").alias("file"), "hidden")


def apply_abstraction(graph: CodeGraph, level: str, module: str | None = None, file: str | None = None) -> CodeGraph:
    """The graph at a level (module, file or symbol), within a module if one is given, and around a file at symbol level."""
    working = focus_module(graph, module) if module else graph
    if level == "module":
        nodes = module_nodes(working).select(F.concat(F.lit("module:"), "module").alias("id"), F.lit("file").alias("type"), F.col("module").alias("file"), F.col("module").alias("name"), F.col("symbols").cast("int").alias("loc"), F.lit(0).cast("long").alias("seq"))
        named = lambda c: F.concat(F.lit("module:"), F.col(c)).alias(c)
        return CodeGraph(nodes, module_edges(working).select(named("source"), named("target"), "type", "weight"))
    if level == "file":
        return file_graph(working)
    if file:
        root = working.nodes.where(F.col("id") == file).select("id")
        return working.induced(reach(working.edges, root, 1, both=True).select("id"))
    return working


def display(graph: CodeGraph, scores: DataFrame, density: str = "balanced", module: str | None = None, file: str | None = None, search: str = "") -> CodeGraph:
    """What is shown at symbol level: trimmed to the best symbols and then within files, unless a file or a search is on."""
    base = apply_abstraction(graph, "symbol", module, file)
    if file or search.strip() or density == "all":
        return base
    knobs = density_knobs(density, 0)
    return collapsed(top_symbols(base, scores, int(knobs["top_k"])), scores, knobs["keep_ratio"], int(knobs["min_per_file"]))[0]


def visible(graph: CodeGraph, node_types: list[str], edge_types: list[str]) -> CodeGraph:
    """Nodes and edges of these types; an edge needs both of its ends."""
    nodes = graph.nodes.where(F.col("type").isin(node_types))
    return CodeGraph(nodes, induced_edges(graph.edges.where(F.col("type").isin(edge_types)), nodes.select("id")))


def contains_edges(graph: CodeGraph) -> DataFrame:
    """(source, target, type): from the file node of each symbol's file (the last one) to the symbol."""
    files = graph.nodes.where("type = 'file'").groupBy("file").agg(F.max_by("id", F.struct("seq", "id")).alias("source"))
    inside = graph.nodes.where("type <> 'file'").select("file", F.col("id").alias("target")).join(files, "file").where("source <> target")
    return inside.select("source", "target", F.lit("contains").alias("type"))


def highlighted(graph: CodeGraph, active: DataFrame, search: str = "") -> DataFrame:
    """(id): what is highlighted: nodes whose name or file holds the search, else the active node and its neighbours."""
    q = search.strip().lower()
    if q:
        return graph.nodes.where(F.lower("name").contains(q) | F.lower("file").contains(q)).select("id")
    return reach(graph.edges, active, 1, both=True).select("id")


def node_tags(metrics: DataFrame) -> DataFrame:
    """(id, flow, cohesion, rank): tags of nodes (id, betweenness, clustering, percentile): bottlenecks, close ones, and the top share."""
    b, c = F.col("betweenness"), F.col("clustering")
    flow = F.when(b > 0.5, "critical").when(b > 0.25, "review").otherwise("normal")
    cohesion = F.when(c >= 0.6, "high").when(c >= 0.3, "medium").otherwise("low")
    top = F.floor((1 - F.col("percentile")) * 100 + 0.5).cast("int")
    return metrics.select("id", flow.alias("flow"), cohesion.alias("cohesion"), top.alias("top_percent"))


def zone_leaders(graph: CodeGraph, limits: dict[str, int] | None = None) -> DataFrame:
    """(zone, type, id, degree, place): the nodes of most edges in each module, so many of each type."""
    limits = limits or {"file": 3, "class": 2, "function": 1}
    ends = graph.edges.select(F.col("source").alias("id")).unionByName(graph.edges.select(F.col("target").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    zoned = graph.nodes.select("id", "type", "seq", module_key(F.col("file")).alias("zone")).join(degree, "id", "left").na.fill(0, ["degree"])
    place = F.row_number().over(Window.partitionBy("zone", "type").orderBy(F.desc("degree"), "seq", "id"))
    allowed = F.coalesce(*(F.when(F.col("type") == t, F.lit(n)) for t, n in limits.items()), F.lit(0))
    return zoned.withColumn("place", place).where(F.col("place") <= allowed).select("zone", "type", "id", "degree", "place")


def density_knobs(level: str, total_symbols: int) -> dict[str, float]:
    """How many symbols to keep, and which share of a file's, at a display density."""
    return {
        "all": {"top_k": total_symbols, "keep_ratio": 1.0, "min_per_file": 999},
        "essential": {"top_k": 50, "keep_ratio": 0.25, "min_per_file": 1},
    }.get(level, {"top_k": 100, "keep_ratio": 0.5, "min_per_file": 2})
