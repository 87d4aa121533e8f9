"""Connected components of a link table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node each node of links (a, b; longs) is connected to.

    Alternates large-star and small-star steps until the links are stars; their number
    grows with the logarithm of the component's size. Each round is checkpointed.
    """

    def both(edges: DataFrame) -> DataFrame:
        return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def signature(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := signature(edges)) != before:
        before = now
        # Large star: all larger neighbours of a node go to the least of its neighbours and itself.
        near = both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # Small star: a node and its smaller neighbours go to the least of these.
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(root, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        edges = checkpoint(small)
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
