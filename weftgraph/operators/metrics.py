"""Graph metrics and architecture health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..plans.lineage import cut, cut_counted, partitions
from ..sources.adjacency import PackedAdjacency
from .traverse import reach


def degrees(graph: CodeGraph) -> DataFrame:
    """(id, fan_in, fan_out): edges counted with their multiplicity, dangling ones by their known end."""
    into = graph.edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in"))
    out = graph.edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("fan_out"))
    return graph.nodes.select("id").join(into, "id", "left").join(out, "id", "left").na.fill(0, ["fan_in", "fan_out"])


def pagerank(graph: CodeGraph, iterations: int = 50, damping: float = 0.85, forward: PackedAdjacency | None = None) -> DataFrame:
    """(id, pagerank): a fixed number of rounds; parallel edges count, dangling mass goes to every node.

    forward are the closed graph's edges packed by source, if there are any already.
    Every node gets the same from the damping and from dangling nodes, so ranks are sums
    of the powers that start as 1 and go along the edges alone. A round is one join of
    the nodes' values with the packed lists, which never move, and one sum by target; a
    node sends itself nothing, so that it stays. A power's totals over all nodes, and
    over dangling ones, are observed while it is written; they weigh the powers at last.
    """
    g = graph.closed()
    n = g.nodes.count()
    if n == 0:
        return g.nodes.select("id", F.lit(0.0).alias("pagerank"))
    forward = forward or PackedAdjacency.build(g.edges)
    lists = forward.table().select("id", "share", "fan", "to")
    fans = lists.where("share = 0").select("id", F.lit(0.0).alias("_fan"))
    state = g.nodes.select("id").join(fans, "id", "left").select("id", F.lit(1.0).alias("value"), F.coalesce("_fan", F.lit(1.0)).alias("dangling"))
    own = F.struct(F.col("id").alias("to"), F.lit(0.0).alias("value"), F.col("dangling"))
    sent = F.transform("to", lambda s: F.struct(s["to"].alias("to"), (F.col("value") * s["times"] / F.col("fan")).alias("value"), F.lit(0.0).alias("dangling")))
    first = F.coalesce("share", F.lit(0)) == 0  # of a hub's rows one speaks for the node itself
    mail = F.concat(F.when(first, F.array(own)).otherwise(F.array()), F.coalesce(sent, F.array()))
    powers, lost, totals = [], [], []
    with partitions(g.nodes.sparkSession, forward.buckets):  # values are dealt as the lists are, however few buckets these have
        for k in range(iterations + 1):
            seen = Observation()
            state = cut(state.observe(seen, F.sum("value").alias("all"), F.sum(F.col("value") * F.col("dangling")).alias("lost")))
            totals.append(seen.get["all"])
            lost.append(seen.get["lost"])
            powers.append(state.select("id", "value"))
            if k < iterations:  # in hash tables of the lists, as nothing has to be sorted or broadcast
                told = state.join(lists.hint("shuffle_hash"), "id", "left").select(F.explode(mail).alias("m")).select("m.*")
                state = told.groupBy(F.col("to").alias("id")).agg(F.sum("value").alias("value"), F.sum("dangling").alias("dangling"))
    given: list[float] = []  # what every node gets in a round
    for t in range(iterations):
        mass = sum(given[t - 1 - k] * damping**k * lost[k] for k in range(t)) + damping**t * lost[t] / n
        given.append(((1 - damping) + damping * mass) / n)
    weight = [given[iterations - 1 - k] * damping**k for k in range(iterations)] + [damping**iterations / n]
    total = sum(w * s for w, s in zip(weight, totals, strict=True))
    every = None
    for w, rows in zip(weight, powers, strict=True):
        part = rows.select("id", (F.col("value") * F.lit(w / total)).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(F.sum("part").alias("pagerank"))


def percentile(scores: DataFrame, column: str, decimals: int = 12) -> DataFrame:
    """Adds percentile: the share of other nodes with a lower score (0 for a single node).

    The number of nodes below comes from distinct scores, whose running sum is over
    ranges of scores, so no task sorts all nodes.
    """
    value = F.round(column, decimals)
    per_value = scores.groupBy(value.alias("_v")).agg(F.count("*").alias("_n"))
    edges = per_value.selectExpr("percentile_approx(_v, array(0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9), 1000) as cuts")
    ranged = per_value.crossJoin(F.broadcast(edges)).withColumn("_range", F.size(F.filter("cuts", lambda c: c < F.col("_v")))).drop("cuts")
    before = ranged.groupBy("_range").agg(F.sum("_n").alias("_m")).withColumn(
        "_before", F.coalesce(F.sum("_m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    running = Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    below = ranged.join(before, "_range").withColumn("_below", F.col("_before") + F.coalesce(F.sum("_n").over(running), F.lit(0)))
    total = scores.agg(F.count("*").alias("_total"))
    below = cut(below.select("_v", "_below"))
    n_values = below.count()
    # A score that very many nodes have is a hot key, but then there are fewer scores; these are broadcast if they are few.
    joined = scores.withColumn("_v", value).join(F.broadcast(below) if n_values <= 100_000 else below, "_v").crossJoin(F.broadcast(total))
    return joined.withColumn("percentile", F.when(F.col("_total") > 1, F.col("_below") / (F.col("_total") - 1)).otherwise(0.0)).drop("_v", "_below", "_total")


def stride_sample(nodes: DataFrame, n: int) -> DataFrame:
    """(id): n nodes at even strides of the ingest order; all if there are no more than n. n is a small constant."""
    count = nodes.count()
    if count <= n:
        return nodes.select("id")
    wanted = nodes.sparkSession.createDataFrame([(int(i * count // n),) for i in range(n)], "at long")
    return ranked(nodes, "seq").join(F.broadcast(wanted), "at").select("id")


def ranked(df: DataFrame, key: str, name: str = "at") -> DataFrame:
    """Adds the place of each row by a long key, from 0; ties by id. Rows are ranked within ranges of the key."""
    low, high, count = df.agg(F.min(key), F.max(key), F.count("*")).first()
    parts = max(1, min(4096, count // 50_000))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // parts))
    bucketed = df.withColumn("_part", F.floor((F.col(key) - (low or 0)) / width))
    before = bucketed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key, "id")) - 1
    return bucketed.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def distances(graph: CodeGraph, sources: DataFrame) -> DataFrame:
    """(source, id, depth): steps between nodes, ignoring direction, from each source (one column, id)."""
    steps = cut(graph.undirected().select(F.col("a").alias("id"), F.col("b").alias("to")).distinct())
    frontier = cut(sources.select(F.col("id").alias("origin"), "id").withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        found = frontier.join(steps, "id").select("origin", F.col("to").alias("id")).distinct()
        frontier = cut(found.join(seen.select("origin", "id"), ["origin", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen.withColumnRenamed("origin", "source")


def betweenness(graph: CodeGraph, max_sources: int = 200) -> DataFrame:
    """(id, betweenness): shortest paths through a node, over an undirected multigraph, from at most max_sources sources.

    Level by level: path counts go out from every source, dependencies come back; both
    are joins and sums over (source, node).
    """
    g = graph.closed()
    n = g.nodes.count()
    zero = g.nodes.select("id", F.lit(0.0).alias("betweenness"))
    if n < 3:
        return zero
    sources = stride_sample(g.nodes, max_sources)
    n_sources = min(n, max_sources)
    steps = cut(g.undirected().where("a <> b").groupBy("a", "b").agg(F.count("*").alias("times")))
    level = cut(sources.select(F.col("id").alias("origin"), "id", F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("origin", "id")
    while True:
        found = level.join(steps, F.col("id") == F.col("a")).groupBy("origin", F.col("b").alias("id")).agg(F.sum(F.col("paths") * F.col("times")).alias("paths"))
        level = cut(found.join(seen, ["origin", "id"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("origin", "id"))
    parts, after = [], None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("delta", F.lit(0.0)) if after is None else levels[k].join(after, ["origin", "id"], "left").na.fill(0.0, ["delta"])
        parts.append(here.where("origin <> id").select("id", "delta"))
        share = here.select("origin", F.col("id").alias("w"), ((1 + F.col("delta")) / F.col("paths")).alias("share"))
        before = levels[k - 1].select("origin", F.col("id").alias("b"), "paths")
        after = cut(
            share.join(steps, F.col("w") == F.col("a")).join(before, ["origin", "b"])
            .groupBy("origin", F.col("b").alias("id")).agg(F.sum(F.col("paths") * F.col("times") * F.col("share")).alias("delta"))
        )
    if not parts:
        return zero
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    scale = (n / n_sources) / ((n - 1) * (n - 2))
    summed = total.groupBy("id").agg((F.sum("delta") * scale).alias("betweenness"))
    return g.nodes.select("id").join(summed, "id", "left").na.fill(0.0, ["betweenness"])


def clustering(graph: CodeGraph) -> DataFrame:
    """(id, clustering): linked pairs among a node's neighbours; sets, a self-loop makes a node its own neighbour.

    Triangles are counted once each, from edges that point to the end with more
    neighbours: a node has at most about the square root of twice the edges such ones, so
    a hub doesn't pair all its neighbours.
    """
    g = graph.closed()
    near = cut(g.undirected().distinct())
    size = cut(near.groupBy("a").agg(F.count("*").alias("k")))
    ranked_ends = near.where("a <> b").join(size.withColumnRenamed("k", "ka"), "a").join(size.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b")
    up = cut(ranked_ends.where("ka < kb or (ka = kb and a < b)").select("a", "b", "kb"))
    x, y = up.alias("x"), up.alias("y")
    wedges = x.join(y, (F.col("x.a") == F.col("y.a")) & F.expr("x.kb < y.kb or (x.kb = y.kb and x.b < y.b)"))
    wedges = wedges.select(F.col("x.a").alias("v"), F.col("x.b").alias("a"), F.col("y.b").alias("b"))
    triangles = wedges.join(up.select("a", "b"), ["a", "b"], "left_semi")
    corners = triangles.select(F.explode(F.array("v", "a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("links"))
    # A self-loop pairs a node with each of its other neighbours, which it is linked to; a neighbour's
    # own loop pairs nothing here, as pairs are of different neighbours.
    loops = near.where("a = b").select(F.col("a").alias("v")).join(size, F.col("a") == F.col("v")).select("v", (F.col("k") - 1).alias("own"))
    return (
        g.nodes.select("id").join(size, F.col("id") == F.col("a"), "left").drop("a").join(corners, F.col("id") == F.col("v"), "left").drop("v")
        .join(loops, F.col("id") == F.col("v"), "left")
        .select("id", F.when(F.col("k") >= 2, 2 * (F.coalesce("links", F.lit(0)) + F.coalesce("own", F.lit(0))) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))
    )


def orphans(graph: CodeGraph) -> DataFrame:
    """(id): nodes without incoming edges other than contains; a self-loop counts as incoming."""
    into = graph.edges.where("type <> 'contains'").select(F.col("target").alias("id"))
    return graph.nodes.select("id").join(into, "id", "left_anti")


def weak_components(graph: CodeGraph) -> DataFrame:
    """(id, component): the least id each node is connected to, by label propagation with pointer jumping."""
    g = graph.closed()
    steps = cut(g.undirected().where("a <> b").distinct())
    labels = cut(g.nodes.select("id", F.col("id").alias("component")))
    while True:
        near = steps.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        lowered = labels.join(near, F.col("id") == F.col("a"), "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("new"))
        jump = lowered.select(F.col("id").alias("_r"), F.col("new").alias("_far"))
        after = cut(lowered.join(jump, F.col("new") == F.col("_r"), "left").select("id", "component", F.least("new", F.coalesce("_far", "new")).alias("new")))
        done = after.where("component <> new").isEmpty()
        labels = after.select("id", F.col("new").alias("component"))
        if done:
            return labels


def density(graph: CodeGraph) -> DataFrame:
    """(density): distinct unordered ends of all edges, dangling ones and loops too, over all possible pairs."""
    pairs = graph.edges.select(F.least("source", "target").alias("p"), F.greatest("source", "target").alias("q")).distinct().agg(F.count("*").alias("m"))
    n = F.col("n")
    return graph.nodes.agg(F.count("*").alias("n")).crossJoin(pairs).select(F.when(n > 1, F.col("m") / (n * (n - 1) / 2)).otherwise(0.0).alias("density"))


def js_round(x: Column, digits: int) -> Column:
    """Half towards plus infinity, as exported values are rounded."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def health_score(max_betweenness: Column, diameter: Column, components: Column, dense: Column, cycles: Column) -> Column:
    """0 to 100: deductions for a bottleneck, long paths, several components, odd density and import cycles."""
    score = (
        100
        - F.when(max_betweenness > 0.6, 25).when(max_betweenness > 0.35, 15).otherwise(0)
        - F.when(diameter > 10, 15).when(diameter > 7, 10).otherwise(0)
        - F.when(components > 1, 20).otherwise(0)
        - F.when((dense < 0.05) | (dense > 0.40), 10).otherwise(0)
        - F.least(F.lit(30), cycles * 12)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def graph_stats(graph: CodeGraph, max_sources: int = 60, import_types: tuple[str, ...] = ("imports", "include")) -> DataFrame:
    """One row: diameter, avg_path, density, components, cycles, health.

    Distances go out from at most max_sources sources. cycles counts the strongly
    connected components with a cycle over edges of import_types.
    """
    g = graph.closed()
    if g.nodes.isEmpty():
        return g.nodes.sparkSession.createDataFrame([(0, 0.0, 0.0, 0, 0, 100)], "diameter int, avg_path double, density double, components long, cycles long, health int")
    d = distances(g, stride_sample(g.nodes, max_sources)).where("depth > 0")
    paths = d.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("diameter"), js_round(F.coalesce(F.avg("depth"), F.lit(0.0)), 1).alias("avg_path"))
    parts = weak_components(g).agg(F.countDistinct("component").alias("components"))
    top = betweenness(g).agg(F.max("betweenness").alias("top"))
    rings = cycles(g, import_types).agg(F.countDistinct("cycle").alias("cycles"))
    joined = paths.crossJoin(density(graph)).crossJoin(parts).crossJoin(top).crossJoin(rings)  # a row each
    health = health_score(F.col("top"), F.col("diameter"), F.col("components"), F.col("density"), F.col("cycles"))
    return joined.select("diameter", "avg_path", "density", "components", "cycles", health.cast("int").alias("health"))


def all_metrics(graph: CodeGraph) -> DataFrame:
    """(id, pagerank, percentile, betweenness, clustering, fan_in, fan_out, orphan) of every node."""
    g = CodeGraph(cut(graph.nodes), cut(graph.edges))
    ranks = percentile(cut(pagerank(g)), "pagerank")
    lonely = orphans(g).withColumn("orphan", F.lit(True))
    rows = ranks.join(betweenness(g), "id").join(clustering(g), "id").join(degrees(g), "id").join(lonely, "id", "left")
    return rows.select("id", "pagerank", "percentile", "betweenness", "clustering", "fan_in", "fan_out", F.coalesce("orphan", F.lit(False)).alias("orphan"))


def top(scores: DataFrame, column: str, n: int) -> DataFrame:
    """The n rows with the highest score; ties by id."""
    return scores.orderBy(F.desc(column), "id").limit(n)


def cycles(graph: CodeGraph, types: tuple[str, ...] = ("imports", "include")) -> DataFrame:
    """(id, cycle, size): nodes on a directed cycle over edges of these types, by strongly connected component.

    cycle is the component's least id; a node with an edge to itself is a cycle of one.
    Nodes without a way in or out are trimmed first. Then the greatest id that reaches a
    node colours it, and what reaches the colour's own node within the colour is a
    component; the rest goes round again.
    """
    g = graph.closed()
    edges = cut(g.edges.where(F.col("type").isin(*types)).select("source", "target").distinct())
    loops = edges.where("source = target").select(F.col("source").alias("id"), F.col("source").alias("root"))
    edges = cut(edges.where("source <> target"))
    found: list[DataFrame] = [cut(loops)]
    while True:
        while True:  # trim
            kept = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            kept = cut(kept.join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
            done = kept.count() == edges.count()
            edges = kept
            if done:
                break
        if edges.isEmpty():
            break
        colour = cut(edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().withColumn("colour", F.col("id")))
        while True:
            come = edges.join(colour.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.max("colour").alias("come"))
            after = cut(colour.join(come, "id", "left").select("id", "colour", F.greatest("colour", F.coalesce("come", "colour")).alias("new")))
            done = after.where("colour <> new").isEmpty()
            colour = after.select("id", F.col("new").alias("colour"))
            if done:
                break
        inside = edges.join(colour.withColumnsRenamed({"id": "source", "colour": "c"}), "source").join(colour.withColumnsRenamed({"id": "target", "colour": "d"}), "target").where("c = d")
        inside = cut(inside.select("source", "target"))
        roots = colour.where("id = colour").select("id")
        members = cut(reach(inside, roots, None).select("id").join(colour, "id").select("id", F.col("colour").alias("root")))
        found.append(members)
        gone = members.select("id")
        edges = cut(edges.join(gone, F.col("source") == F.col("id"), "left_anti").join(gone, F.col("target") == F.col("id"), "left_anti"))
    parts = found[0]
    for f in found[1:]:
        parts = parts.unionByName(f)
    sized = parts.groupBy("root").agg(F.min("id").alias("cycle"), F.countDistinct("id").alias("size"))
    looped = found[0].select(F.col("id").alias("_loop"))
    on_cycle = parts.join(sized, "root").join(looped, F.col("id") == F.col("_loop"), "left").where("size > 1 or _loop is not null")
    return on_cycle.groupBy("id").agg(F.max(F.struct("size", "cycle")).alias("c")).select("id", "c.cycle", "c.size")


def cycle_witnesses(graph: CodeGraph, types: tuple[str, ...] = ("imports", "include")) -> DataFrame:
    """(cycle, at, id): for each component of cycles() one cycle, written out from its least node (at 0) along the edges.

    It is a shortest one through that node. All components are searched at once, level
    by level: a node keeps as its parent the least of those it is first reached from,
    and a component is done at the level whose least node leads back. Then the paths are
    walked back by their parents, a step of all at a time, so a round is a join of no
    more rows than there are components.
    """
    members = cut(cycles(graph, types).select("id", "cycle"))
    edges = graph.edges.where(F.col("type").isin(*types)).select("source", "target").distinct()
    into = members.select(F.col("id").alias("target"), F.col("cycle").alias("_c"))
    inside = cut(edges.join(members.withColumnRenamed("id", "source"), "source").join(into, "target").where("cycle = _c").select("cycle", "source", "target"))
    roots = members.select("cycle").distinct()
    frontier, n = cut_counted(roots.select("cycle", F.col("cycle").alias("id"), F.lit(None).cast(members.schema["id"].dataType).alias("parent"), F.lit(0).alias("depth")))
    seen, ends = frontier, None
    while n:
        steps = cut(frontier.select("cycle", F.col("id").alias("source"), "depth").join(inside, ["cycle", "source"]))
        home = cut(steps.where("target = cycle").groupBy("cycle").agg(F.min("source").alias("id"), F.min("depth").alias("at")))
        ends = home if ends is None else ends.unionByName(home)
        going = steps.join(home.select("cycle"), "cycle", "left_anti")
        first = going.groupBy("cycle", F.col("target").alias("id")).agg(F.min("source").alias("parent"), (F.min("depth") + 1).cast("int").alias("depth"))
        frontier, n = cut_counted(first.join(seen.select("cycle", "id"), ["cycle", "id"], "left_anti"))
        seen = seen.unionByName(frontier)
    if ends is None:
        return frontier.select("cycle", F.col("depth").alias("at"), "id")  # no component at all
    place, left = cut_counted(ends.select("cycle", "at", "id"))
    found, parents = place, cut(seen.select("cycle", "id", "parent"))
    while left:
        place, left = cut_counted(place.where("at > 0").join(parents, ["cycle", "id"]).select("cycle", (F.col("at") - 1).alias("at"), F.col("parent").alias("id")))
        found = found.unionByName(place)
    return found
