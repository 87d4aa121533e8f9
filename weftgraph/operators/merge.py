"""One node for each qualified name, whichever file declares it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..plans.lineage import cut


def survivors(nodes: DataFrame, key: Column) -> DataFrame:
    """(id, kept): each node and the first in ingest order (seq, then id) of those with its key; nodes without a key keep themselves."""
    keyed = nodes.select("id", "seq", key.alias("_key"))
    first = keyed.where("_key is not null").groupBy("_key").agg(F.min(F.struct("seq", "id")).alias("first"))
    return keyed.join(first, "_key", "left").select("id", F.coalesce("first.id", "id").alias("kept"))


def merge_nodes(g: CodeGraph, key: Column) -> CodeGraph:
    """The graph with one node for each key (a column of its nodes): the first in ingest order, as it was.

    Edges of the others move to it. Edges that become equal are one, and those that would
    lead from a node to itself because of the merge are gone; a node's own loop stays.
    Edges with an unknown end are dropped. Node ids are distinct; edges have source, target and type.
    """
    kept = cut(survivors(g.nodes, key))
    nodes = g.nodes.join(kept.where("id = kept").select("id"), "id", "left_semi")
    from_, to = kept.toDF("source", "_from"), kept.toDF("target", "_to")
    moved = g.edges.join(from_, "source").join(to, "target").where("_from <> _to or source = target")
    return CodeGraph(nodes, moved.select(F.col("_from").alias("source"), F.col("_to").alias("target"), "type").distinct())
