"""Persistent tables: symbols and edges by repository, and runs of impact queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_repositories(rows: DataFrame, path: str) -> None:
    """Writes rows (with repo_id) over the partitions of their repositories only; other repositories stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def append_run(affected: DataFrame, run: dict[str, str], path: str) -> None:
    """Appends a run: its description, what it found (id, depth, risk) as an array of structs, and the counts by risk.

    The array is a report of at most as many rows as the impact query's cap.
    """
    count = lambda level: F.count_if(F.col("risk") == level).alias(level)
    one = affected.agg(
        F.array_sort(F.collect_list(F.struct("depth", "id", "risk"))).alias("affected"),
        F.struct(count("high"), count("medium"), count("low"), F.count("*").alias("total")).alias("summary"),
    )
    one.select(*(F.lit(v).alias(k) for k, v in run.items()), "affected", "summary").write.mode("append").parquet(path)


def delete_repositories(spark: SparkSession, path: str, gone: DataFrame, to: str) -> None:
    """Writes the table without the repositories in gone (one column, repo_id) to another folder: its rows, and all that hang on them."""
    spark.read.parquet(path).join(gone, "repo_id", "left_anti").write.mode("overwrite").partitionBy("repo_id").parquet(to)


def with_visibility(repos: DataFrame, repo_id: str, visibility: str) -> DataFrame:
    """Repositories with one's visibility set to private or public."""
    if visibility not in ("private", "public"):
        raise ValueError("visibility is private or public")
    return repos.withColumn("visibility", F.when(F.col("id") == repo_id, visibility).otherwise(F.col("visibility")))


def allowed(rows: DataFrame, repos: DataFrame, owner: str | int) -> DataFrame:
    """Rows (repo_id) of repositories that an owner may read: their own and public ones."""
    seen = repos.where((F.col("owner_id") == owner) | (F.col("visibility") == "public")).select(F.col("id").alias("repo_id"))
    return rows.join(seen, "repo_id", "left_semi")


def broken_rules(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, n): how many rows break a key: repeated names in a repository, repeated edges, ends without a symbol."""
    names = symbols.groupBy("repo_id", "qualified_name").agg(F.count("*").alias("n")).where("n > 1")
    pairs = edges.groupBy("source_id", "target_id", "kind").agg(F.count("*").alias("n")).where("n > 1")
    ids = symbols.select("id")
    lost = [edges.join(ids, F.col(end) == F.col("id"), "left_anti") for end in ("source_id", "target_id")]
    named = (("symbol name", names), ("edge", pairs), ("source", lost[0]), ("target", lost[1]))
    out = None
    for rule, rows in named:
        counted = rows.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out
