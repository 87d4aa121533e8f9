"""Edges as packed lists, bucketed and sorted by node: written once, then joined by rounds and searches without moving them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut_counted, shared_folder

LIST_LENGTH = 10_000  # a node with more neighbours has several rows
PAIRS_PER_BUCKET, MAX_BUCKETS = 250_000, 50_000


@dataclass(frozen=True)
class PackedAdjacency:
    """A bucketed table (id, share, fan, to): a node's neighbours with how often each is an edge, and how many edges that are in all."""

    spark: SparkSession
    name: str
    buckets: int

    @classmethod
    def build(cls, edges: DataFrame, *, reverse: bool = False, both: bool = False, buckets: int | None = None) -> PackedAdjacency:
        """Packs edges (source, target) by their source; reverse by their target, both by either end. A bucket has PAIRS_PER_BUCKET or so."""
        spark = edges.sparkSession
        forward = edges.select(F.col("source").alias("id"), F.col("target").alias("to"))
        backward = edges.select(F.col("target").alias("id"), F.col("source").alias("to"))
        pairs = (forward.unionByName(backward) if both else backward if reverse else forward).groupBy("id", "to").agg(F.count("*").alias("times"))
        pairs, n_pairs = cut_counted(pairs)
        buckets = buckets or max(1, min(MAX_BUCKETS, -(-n_pairs // PAIRS_PER_BUCKET)))
        sizes = pairs.groupBy("id").agg(F.count("*").alias("n"), F.sum("times").alias("fan"))
        sized = pairs.join(sizes, "id")
        shares = F.ceil(F.col("n") / LIST_LENGTH).cast("int")
        # A list holds LIST_LENGTH neighbours or so: a hub's are dealt to shares by a hash.
        share = F.when(F.col("n") > LIST_LENGTH, F.pmod(F.xxhash64("to"), shares)).otherwise(0).cast("int")
        packed = sized.groupBy("id", share.alias("share"), "fan").agg(F.collect_list(F.struct("to", "times")).alias("to"))
        name = f"adjacency_{uuid.uuid4().hex}"
        rows = packed.repartition(buckets, "id").sortWithinPartitions("id", "share")
        rows.write.format("parquet").bucketBy(buckets, "id").sortBy("id").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
        return cls(spark, name, buckets)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def steps_from(self, ids: DataFrame) -> DataFrame:
        """(to) of all steps from ids (one column, id), repeated as found; the lists stay where they are."""
        return self.table().select("id", "to").join(ids, "id").select(F.explode("to").alias("s")).select(F.col("s.to").alias("to"))

    def steps_from_few(self, ids: list) -> DataFrame:
        """The same for a short list of ids, whose buckets alone are read."""
        return self.table().where(F.col("id").isin(ids)).select(F.explode("to").alias("s")).select(F.col("s.to").alias("to"))
