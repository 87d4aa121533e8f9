"""Breadth-first traversal, a frontier at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..plans.lineage import cut, cut_counted
from ..sources.adjacency import PackedAdjacency

FEW_IDS = 256  # so many ids travel as a list
BROADCAST_IDS = 100_000  # rows of ids up to which a frontier, or what was seen, is broadcast


def few(ids: DataFrame, n: int) -> DataFrame:
    """A table of n ids, broadcast if that is few."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def reach(edges: DataFrame | PackedAdjacency, seeds: DataFrame, max_depth: int | None, *, reverse: bool = True, both: bool = False) -> DataFrame:
    """(id, depth): least number of steps from any seed (one column, id; depth 0), at most max_depth.

    reverse walks edges from target to source (callers, importers), both ignores the
    direction; packed lists have their direction already. A level joins the frontier to
    the edges and drops what was seen. Packed lists never move: a short frontier reads
    its own buckets alone, a longer one is dealt to them. Plain edges stay where they
    are while frontier and seen are small enough to broadcast. Nothing else is collected.
    """
    packed = isinstance(edges, PackedAdjacency)
    if not packed:
        out, back = ("target", "source") if reverse else ("source", "target")
        steps = edges.select(F.col(out).alias("id"), F.col(back).alias("to"))
        if both:
            steps = steps.unionByName(edges.select(F.col(back).alias("id"), F.col(out).alias("to")))
        if max_depth is None or max_depth > 1:
            steps = cut(steps)
    frontier, n_new = cut_counted(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    seen, n_seen, depth = frontier, n_new, 0
    while n_new and (max_depth is None or depth < max_depth):
        depth += 1
        if packed and n_new <= FEW_IDS:
            found = edges.steps_from_few([r["id"] for r in frontier.collect()])
        elif packed:
            found = edges.steps_from(few(frontier.select("id"), n_new))
        else:
            found = steps.join(few(frontier.select("id"), n_new), "id").select("to")
        new = found.select(F.col("to").alias("id")).distinct().join(few(seen.select("id"), n_seen), "id", "left_anti")
        frontier, n_new = cut_counted(new.withColumn("depth", F.lit(depth)))
        seen, n_seen = seen.unionByName(frontier), n_seen + n_new
    return seen


def focus(graph: CodeGraph, root: DataFrame, hops: int = 1, around: PackedAdjacency | None = None) -> CodeGraph:
    """The subgraph within so many steps of root (one column, id), whatever the edges' direction; around are its edges packed by either end."""
    return graph.induced(reach(around or graph.edges, root, hops, both=True).select("id"))


def neighbours(graph: CodeGraph, node: DataFrame) -> DataFrame:
    """(id, direction, neighbour, type): out and in edges of the nodes in node; a self-loop is out only."""
    ids = node.select("id")
    out = graph.edges.join(ids, F.col("source") == F.col("id")).select("id", F.lit("out").alias("direction"), F.col("target").alias("neighbour"), "type")
    into = graph.edges.join(ids, F.col("target") == F.col("id")).where("source <> target")
    return out.unionByName(into.select("id", F.lit("in").alias("direction"), F.col("source").alias("neighbour"), "type"))


def highlighted_edges(graph: CodeGraph, root: DataFrame) -> DataFrame:
    """Edges among everything from which root can be reached."""
    reached = reach(graph.edges, root, None).select("id")
    return graph.induced(reached).edges
