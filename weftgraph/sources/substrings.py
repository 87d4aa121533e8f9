"""Finding many texts by what they contain: a stored inverted index of pairs and triples of characters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSTINGS_PER_KEY = 10_000
BROADCAST_ROWS = 100_000


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text, none if it is shorter."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


@dataclass
class SubstringIndex:
    """Tables below one folder: grams (gram, n, best) and postings (gram, share, text, best).

    Each text carries a value, best, by which a search ranks what it finds: the least
    counts. A gram's postings are dealt to shares of about POSTINGS_PER_KEY rows, so no
    key of a join has more, however common a gram is.
    """

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, texts: DataFrame, path: str) -> SubstringIndex:
        """Indexes texts (text, best), lower-cased; equal texts are one, with the least best. Null and empty texts are left out."""
        spark = texts.sparkSession
        low = texts.select(F.lower("text").alias("text"), "best").where("text <> ''").groupBy("text").agg(F.min("best").alias("best"))
        low.write.parquet(f"{path}/texts")
        low = spark.read.parquet(f"{path}/texts")
        found = low.select("text", "best", F.explode(F.concat(grams(F.col("text"), 2), grams(F.col("text"), 3))).alias("gram"))
        found.groupBy("gram").agg(F.count("*").alias("n"), F.min("best").alias("best")).sortWithinPartitions("gram").write.parquet(f"{path}/grams")
        counted = spark.read.parquet(f"{path}/grams")
        common = counted.where(F.col("n") > POSTINGS_PER_KEY).select("gram", F.ceil(F.col("n") / POSTINGS_PER_KEY).cast("int").alias("shares"))
        triples = found.where("length(gram) = 3")  # a pair is answered by its own row
        # A common gram has POSTINGS_PER_KEY rows or more, so there are few beside the postings.
        shared = triples.join(F.broadcast(common) if common.count() <= BROADCAST_ROWS else common, "gram", "left")
        share = F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("text"), F.col("shares"))).cast("int")
        placed = shared.select("gram", share.alias("share"), "text", "best")
        placed.repartition("gram", "share").sortWithinPartitions("gram", "share").write.parquet(f"{path}/postings")
        return cls(spark, path)

    def _counted(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")

    def _rarest(self, candidates: DataFrame) -> DataFrame:
        """(candidate, gram, n) of candidates of more than three characters that can be found: their rarest triple."""
        long = candidates.where("length(candidate) > 3")
        asked = long.select("candidate", F.explode(grams(F.col("candidate"), 3)).alias("gram"))
        known = asked.join(self._counted().select("gram", "n"), "gram", "left")
        rare = known.groupBy("candidate").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
        return rare.where("r.n > 0").select("candidate", "r.gram", "r.n")

    def _hits(self, candidates: DataFrame) -> DataFrame:
        """(candidate, text, best) for longer candidates: the postings of their rarest triple that hold them whole."""
        shares = F.greatest(F.lit(1), F.ceil(F.col("n") / POSTINGS_PER_KEY).cast("int"))
        asked = self._rarest(candidates).select("candidate", "gram", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
        postings = self.spark.read.parquet(f"{self.path}/postings")
        return asked.join(postings, ["gram", "share"]).where(F.col("text").contains(F.col("candidate"))).select("candidate", "text", "best")

    def best(self, candidates: DataFrame) -> DataFrame:
        """(candidate, best): for each candidate (one column) the least best of all texts that hold it, whatever the case; none without one.

        Candidates of two or three characters are a gram themselves, whose best is stored.
        """
        low = candidates.select(F.lower("candidate").alias("candidate")).where("length(candidate) >= 2").distinct()
        short = low.where("length(candidate) <= 3").join(self._counted().select(F.col("gram").alias("candidate"), "best"), "candidate")
        return short.unionByName(self._hits(low).groupBy("candidate").agg(F.min("best").alias("best")))

    def matches(self, candidates: DataFrame) -> DataFrame:
        """(candidate, text): every text that holds a candidate of two characters or more, whatever the case."""
        low = candidates.select(F.lower("candidate").alias("candidate")).where("length(candidate) >= 2").distinct()
        texts = self.spark.read.parquet(f"{self.path}/texts")
        # As many rows as there are answers: short candidates stand in what their grams lead to.
        short = low.where("length(candidate) <= 3").withColumnRenamed("candidate", "gram")
        held = texts.select("text", F.explode(F.concat(grams(F.col("text"), 2), grams(F.col("text"), 3))).alias("gram"))
        found = held.join(F.broadcast(short) if short.count() <= BROADCAST_ROWS else short, "gram").select(F.col("gram").alias("candidate"), "text")
        return found.unionByName(self._hits(low).select("candidate", "text"))
