"""Graphs derived from the relational test tables: parts call parts, users follow users."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import CodeGraph
from .adjacency import PackedAdjacency


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pk, id, file, name): each part as a function in a file of its type and brand; promotions are tests."""
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pk"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("tests/test_"), brand, F.lit(".py")))
        .otherwise(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), brand, F.lit(".py")))
        .alias("file"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"),
    )


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, t): returned parts that follow each other in an order, other ones only, each pair once."""
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return (
        read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
        .select(F.col("l_partkey").alias("s"), F.lead("l_partkey").over(in_order).alias("t"))
        .where("t is not null and s <> t").distinct()
    )


def part_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Functions call the next returned part of an order; a file imports those that its functions call into."""
    symbols = part_symbols(spark, sf_dir)
    calls = part_calls(spark, sf_dir)
    functions = symbols.select(
        "id", F.lit("function").alias("type"), "file", "name", F.lit(None).cast("int").alias("loc"), (F.col("pk") + 1_000_000).alias("seq")
    )
    files = symbols.groupBy("file").agg((F.count("*") * 7).cast("int").alias("loc"), F.min("pk").alias("seq")).select(
        F.col("file").alias("id"), F.lit("file").alias("type"), "file", F.col("file").alias("name"), "loc", "seq"
    )
    by_key = lambda side: symbols.select(F.col("pk").alias(side), F.col("file").alias(f"{side}_file"))
    imports = (
        calls.join(by_key("s"), "s").join(by_key("t"), "t")
        .where("s_file <> t_file").select(F.col("s_file").alias("source"), F.col("t_file").alias("target"), F.lit("imports").alias("type")).distinct()
    )
    named = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    edges = calls.select(named("s").alias("source"), named("t").alias("target"), F.lit("calls").alias("type"))
    return CodeGraph(functions.unionByName(files), edges.unionByName(imports))


def part_churn(spark: SparkSession, sf_dir: str, days: int = 90) -> DataFrame:
    """(id, churn): shipments of a part within so many days before the last one, as commits to a function."""
    lines = read(spark, sf_dir, "lineitem")
    latest = lines.agg(F.max("l_shipdate").alias("latest"))
    recent = lines.crossJoin(F.broadcast(latest)).where(F.col("l_shipdate") >= F.col("latest") - F.expr(f"interval {days} days"))
    named = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return recent.groupBy(named.alias("id")).agg(F.count("*").alias("churn"))


def user_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Users, with an edge where a user's error is directly followed by another's purchase."""
    events = read(spark, sf_dir, "events")
    # The next event overall, found within days; only a day's last event looks beyond its own day.
    day = F.to_date("ts")
    within = Window.partitionBy("day").orderBy("ts", "event_id")
    placed = events.select(day.alias("day"), "ts", "event_id", "user_id", "event_type").withColumn("n", F.row_number().over(within))
    following = placed.withColumn("v", F.lead("user_id").over(within)).withColumn("b", F.lead("event_type").over(within))
    first = placed.where("n = 1").select(F.col("day").alias("next_day"), F.col("user_id").alias("v1"), F.col("event_type").alias("b1"))
    days = placed.select("day").distinct().withColumn("next_day", F.lead("day").over(Window.orderBy("day")))
    lasts = following.where("v is null").join(days, "day").join(first, "next_day").select("user_id", "event_type", F.col("v1").alias("v"), F.col("b1").alias("b"))
    pairs = following.where("v is not null").select("user_id", "event_type", "v", "b").unionByName(lasts)
    edges = (
        pairs.where("user_id <> v and event_type = 'error' and b = 'purchase'")
        .select(F.col("user_id").alias("source"), F.col("v").alias("target"), F.lit("calls").alias("type")).distinct()
    )
    nodes = events.select(F.col("user_id").alias("id")).distinct().select(
        "id", F.lit("function").alias("type"), F.lit("").alias("file"), F.col("id").cast("string").alias("name"),
        F.lit(None).cast("int").alias("loc"), F.col("id").alias("seq"),
    )
    return CodeGraph(nodes, edges)


@dataclass(frozen=True)
class Prepared:
    """The stored graphs of a folder of tables: parts with their symbols, edges packed by target and by either end, and users with their links."""

    parts: CodeGraph
    symbols: DataFrame
    callers: PackedAdjacency
    around: PackedAdjacency
    users: CodeGraph
    links: PackedAdjacency


_prepared: dict[tuple[str, str], Prepared] = {}


def keep_prepared(spark: SparkSession, sf_dir: str, made: Prepared) -> Prepared:
    """From now on queries over this folder use what is stored; only who asks for it keeps anything."""
    _prepared[spark.sparkContext.applicationId, sf_dir] = made
    return made


def prepared(spark: SparkSession, sf_dir: str) -> Prepared | None:
    return _prepared.get((spark.sparkContext.applicationId, sf_dir))
