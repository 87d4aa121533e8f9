"""The property graph every operator works on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CodeGraph:
    """nodes(id, type, file, name, loc, seq) and edges(source, target, type[, seq]); edges may dangle until closed()."""

    nodes: DataFrame
    edges: DataFrame

    def closed(self) -> CodeGraph:
        """Without edges to or from unknown nodes."""
        return CodeGraph(self.nodes, induced_edges(self.edges, self.nodes.select("id")))

    def induced(self, ids: DataFrame) -> CodeGraph:
        """The nodes whose id is in ids (one column, id), and the edges among them."""
        return CodeGraph(self.nodes.join(ids, "id", "left_semi"), induced_edges(self.edges, ids))

    def undirected(self) -> DataFrame:
        """(a, b): each edge in both directions, parallel ones kept."""
        ends = self.edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
        return ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    keep = ids.select(F.col("id").alias("_keep")).distinct()
    return edges.join(keep, F.col("source") == F.col("_keep"), "left_semi").join(keep, F.col("target") == F.col("_keep"), "left_semi")
