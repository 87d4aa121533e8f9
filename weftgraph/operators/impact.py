"""Change impact: what depends on a symbol, how risky that is, and which files are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import band, risk_level
from ..plans.lineage import cut
from ..sources.adjacency import PackedAdjacency
from .traverse import reach


def affected(symbols: DataFrame, edges: DataFrame | PackedAdjacency, target: DataFrame, max_depth: int = 5) -> DataFrame:
    """(id, depth, fan_in, churn, risk) of everything that reaches target by calls or imports, target left out.

    symbols has id, fan_in and churn. Order by risk_rank, depth and descending fan_in to
    list the most urgent first.
    """
    found = reach(edges, target, max_depth).where("depth > 0").join(symbols.select("id", "fan_in", "churn"), "id")
    risk = risk_level(F.col("fan_in"), F.col("churn"))
    return found.withColumn("risk", risk).withColumn("risk_rank", F.when(F.col("risk") == "high", 0).when(F.col("risk") == "medium", 1).otherwise(2))


def hard_capped(edges: DataFrame, target: DataFrame, max_depth: int = 4, cap: int = 200) -> DataFrame:
    """(id, depth, kind): what reaches target, at most cap nodes, in the order of the edges (seq) of each level.

    kind is the type of the edge a node was found by. The cap is the report's limit;
    levels after the one that reaches it are not searched.
    """
    start = target.select(F.col("id"))
    seen = frontier = cut(start.withColumn("depth", F.lit(0)).withColumn("kind", F.lit(None).cast("string")))
    left = cap
    for depth in range(1, max_depth + 1):
        into = edges.join(frontier.select(F.col("id").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("id"))
        first = into.agg(F.min(F.struct("seq", "type")).alias("by")).join(seen.select("id"), "id", "left_anti")
        frontier = cut(first.orderBy("by.seq").limit(left).select("id", F.lit(depth).alias("depth"), F.col("by.type").alias("kind")))
        found = frontier.count()
        seen, left = seen.unionByName(frontier), left - found
        if not found or left <= 0:
            break
    return seen.where("depth > 0")


def soft_capped(edges: DataFrame, target: DataFrame, max_depth: int = 5, limit: int = 101) -> DataFrame:
    """(id, depth): what reaches target; a node's callers are all taken, but no node is opened once more than limit are seen.

    Nodes are opened in the order they were found, callers in the order of their edges
    (seq). Only levels of at most limit nodes are ever opened, so ranking these is small.
    """
    frontier = cut(target.select("id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place")))
    seen, n_seen = frontier, frontier.count()
    for depth in range(1, max_depth + 1):
        if n_seen > limit:
            break
        opened = frontier.select(F.col("id").alias("target"), F.col("place").alias("parent"))
        first = edges.join(F.broadcast(opened), "target").groupBy(F.col("source").alias("id")).agg(F.min(F.struct("parent", "seq")).alias("by"))  # at most limit rows
        new = cut(first.join(seen.select("id"), "id", "left_anti"))
        given = new.groupBy(F.col("by.parent").alias("parent")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = given.select("parent", before.alias("before")).where(F.col("before") + n_seen <= limit).select("parent")
        taken = new.join(F.broadcast(kept), F.col("by.parent") == F.col("parent"), "left_semi")
        n_new = taken.count()
        if not n_new:
            break
        n_seen += n_new
        order = F.row_number().over(Window.orderBy("by")).cast("long") if n_seen <= limit else F.lit(0).cast("long")
        frontier = cut(taken.select("id", F.lit(depth).alias("depth"), order.alias("place")))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0").select("id", "depth")


def summary(found: DataFrame) -> DataFrame:
    """One row: high, medium, low, total, depth_max."""
    count = lambda level: F.count_if(F.col("risk") == level).alias(level)
    return found.agg(count("high"), count("medium"), count("low"), F.count("*").alias("total"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth_max"))


def continuous_risk(found: DataFrame) -> DataFrame:
    """Adds score (half by nearness, three tenths by fan-in, a fifth by churn; 3 digits) and level, cut before rounding."""
    top = found.agg(F.greatest(F.lit(1), F.max("fan_in")).alias("_f"), F.greatest(F.lit(1), F.max("churn")).alias("_c"))
    raw = F.lit(0.5) / F.col("depth") + F.lit(0.3) * F.col("fan_in") / F.col("_f") + F.lit(0.2) * F.col("churn") / F.col("_c")
    return (
        found.crossJoin(F.broadcast(top)).withColumn("_raw", raw)
        .withColumn("score", F.floor(F.col("_raw") * 1000 + 0.5) / 1000)
        .withColumn("level", F.when(F.col("_raw") > 0.66, "high").when(F.col("_raw") > 0.33, "medium").otherwise("low"))
        .drop("_f", "_c", "_raw")
    )


def criticality(found: DataFrame, target: DataFrame, kind: str) -> DataFrame:
    """One row (total, shallow, points, level, reasons) for a change of a kind to target (one row, fan_in).

    Centrality, nodes within two steps and reach add up, more if every caller breaks;
    such a change with a caller is moderate at least, with five critical.
    """
    breaks = kind in ("delete", "rename", "signature")
    counts = found.agg(F.count("*").alias("total"), F.count_if(F.col("depth") <= 2).alias("shallow")).crossJoin(target.select("fan_in"))  # a row each
    total, shallow, fan_in = F.col("total"), F.col("shallow"), F.col("fan_in")
    base = F.least(F.lit(40.0), 5.0 * fan_in) + F.least(F.lit(30.0), 4.0 * shallow) + F.least(F.lit(20.0), F.lit(0.8) * total)
    points = base * (1.6 if breaks else 1.0) + (10.0 if kind == "delete" else 0.0)
    level = F.when(points >= 60, "critical").when(points >= 35, "significant").when(points >= 15, "moderate").otherwise("minor")
    if breaks:
        level = F.when((fan_in >= 5) | (shallow >= 5), "critical").when((total >= 1) & (points < 15), "moderate").otherwise(level)
    says = {"delete": "deletion breaks every caller", "rename": "rename breaks every caller until updated", "signature": "signature change breaks every caller"}
    callers = (
        F.when(fan_in >= 8, F.format_string("core symbol (%d direct callers)", fan_in)).when(fan_in >= 3, F.format_string("used by %d other symbols", fan_in))
        .when(fan_in > 1, F.format_string("%d direct callers", fan_in)).when(fan_in == 1, F.lit("1 direct caller"))
    )
    reach_says = F.when(total > 1, F.format_string("%d downstream symbols affected", total)).when(total == 1, F.lit("1 downstream symbol affected"))
    reasons = F.array_compact(F.array(F.lit(says.get(kind)), callers, reach_says, F.when(shallow > 0, F.format_string("%d immediate", shallow))))
    return counts.select("total", "shallow", (F.floor(points * 1000 + 0.5) / 1000).alias("points"), level.alias("level"), reasons.alias("reasons"))


def hotspots(symbols: DataFrame, rows: int = 300, top: int = 12) -> DataFrame:
    """(file, symbols, score, share, band): files of the rows symbols with most callers, the top ones by score."""
    chosen = symbols.orderBy(F.desc("fan_in"), "id").limit(rows)
    files = chosen.groupBy("file").agg(F.max("fan_in").alias("i"), F.max("fan_out").alias("o"), F.max("churn").alias("c"), F.count("*").alias("symbols"))
    score = 3 * F.col("i") + 2 * F.col("o") + F.col("c") + F.when(F.col("symbols") > 1, F.col("symbols")).otherwise(0)
    best = files.withColumn("score", score).orderBy(F.desc("score"), "file").limit(top)
    highest = F.max("score").over(Window.partitionBy(F.lit(1)))  # top rows only
    share = F.when(highest > 0, F.col("score") / highest).otherwise(0.0)
    return best.select("file", "symbols", "score", F.round(share, 6).alias("share"), band(share).alias("band"))


def risky_files(symbols: DataFrame, top: int = 12) -> DataFrame:
    """(file, churn, symbols, max_churn, total_files): files with changes, those with most first; from 1 to 50 of them.

    max_churn and total_files are of all files with changes.
    """
    files = symbols.groupBy("file").agg(F.max("churn").alias("churn"), F.count("*").alias("symbols")).where("churn > 0")
    every = files.agg(F.max("churn").alias("max_churn"), F.count("*").alias("total_files"))
    return files.orderBy(F.desc("churn"), "file").limit(max(1, min(50, top))).crossJoin(F.broadcast(every))  # one row
