"""Places and the innermost interval around each: bins of places, a sweep in each bin, long intervals over dyadic runs of bins."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 4096
KEY = ["file", "bin"]


def _whole_runs(low, high):
    """The bins from low to high as the fewest dyadic runs: an array of (level, node), node holding 2^level bins."""
    start = F.struct(low.alias("l"), high.alias("r"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out"))

    def step(done, level):
        l, r = done["l"], done["r"]
        node = lambda x: F.struct(level.cast("int").alias("level"), x.alias("node"))
        left, right = (l <= r) & (F.pmod(l, F.lit(2)) == 1), (l <= r) & (F.pmod(r, F.lit(2)) == 0)
        out = F.concat(done["out"], F.when(left, F.array(node(l))).otherwise(F.array()), F.when(right & ~(left & (l == r)), F.array(node(r))).otherwise(F.array()))
        up = F.shiftright(F.when(left, l + 1).otherwise(l), 1), F.shiftright(F.when(right, r - 1).otherwise(r), 1)
        over = F.when(left, l + 1).otherwise(l) > F.when(right, r - 1).otherwise(r)
        return F.struct(F.when(over, F.lit(1)).otherwise(up[0]).cast("bigint").alias("l"), F.when(over, F.lit(0)).otherwise(up[1]).cast("bigint").alias("r"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, step, lambda done: done["out"])


def _sweep(places: pa.Table, spans: pa.Table) -> pa.Table:
    """The least span open at each place of a bin, by one pass over places and spans in order."""
    at = sorted(places.column("at").to_pylist())
    rows = sorted(zip(spans.column("a").to_pylist(), spans.column("b").to_pylist(), spans.column("rank").to_pylist(), spans.column("caller").to_pylist(), strict=True))
    open_, found, callers, k = [], [], [], 0
    for place in at:
        while k < len(rows) and rows[k][0] <= place:
            a, b, rank, caller = rows[k]
            heapq.heappush(open_, (rank, caller, b))
            k += 1
        while open_ and open_[0][2] <= place:
            heapq.heappop(open_)
        if open_:
            found.append(place)
            callers.append(open_[0][1])
    file = places.column("file")[0].as_py()
    return pa.table({"file": pa.array([file] * len(found), pa.string()), "at": pa.array(found, pa.int64()), "caller": pa.array(callers, pa.string())})


def enclosing(calls: DataFrame, definitions: DataFrame, *, by: str = "size", width: int = WIDTH) -> DataFrame:
    """(file, at, name, caller): each call (file, at, name) with the innermost definition (file, caller, start, end) around it.

    A definition is around a call if start <= at < end. Innermost is the shortest, or
    with by="start" the one that begins last; ties go to the shorter, then to the least
    caller. Definitions may overlap in any way; those with a null or empty range are
    around nothing, and calls outside of all are left out; repeated calls count once.

    Places are told apart once, in bins of so many. A definition takes part in the bins
    of its two ends, cut to them; the whole bins between are stated as dyadic runs, of
    which each keeps its innermost definition, so a definition around all of a file is a
    few rows. A bin holds at most width places and one definition for each pair of ends
    within it, however many calls and definitions a file has.
    """
    if by not in ("size", "start"):
        raise ValueError("by is size or start")
    size = F.col("end").cast("long") - F.col("start")
    spans = definitions.where("start < end").select(
        F.col("file").cast("string").alias("file"), F.col("caller").cast("string").alias("caller"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        F.when(F.lit(by == "size"), F.struct(size.alias("x"), F.lit(0).cast("long").alias("y"))).otherwise(F.struct((-F.col("start").cast("long")).alias("x"), size.alias("y"))).alias("rank"),
    )
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    spans = spans.withColumn("low", bin_of(F.col("start"))).withColumn("high", bin_of(F.col("end") - 1))
    best = F.min(F.struct("rank", "caller")).alias("best")
    ends = (
        spans.select("*", F.explode(F.array_distinct(F.array("low", "high"))).alias("bin"))
        .groupBy(*KEY, F.greatest("start", F.col("bin") * width).alias("a"), F.least("end", (F.col("bin") + 1) * width).alias("b")).agg(best)
    )
    runs = (
        spans.where("high - low > 1").select("file", "rank", "caller", F.explode(_whole_runs(F.col("low") + 1, F.col("high") - 1)).alias("run"))
        .groupBy("file", "run.level", "run.node").agg(best)
    )
    asked = calls.select(F.col("file").cast("string").alias("file"), F.col("at").cast("long").alias("at")).where("file is not null and at is not null").distinct()
    places = asked.withColumn("bin", bin_of(F.col("at")))
    bins = places.select(*KEY).distinct()
    above = bins.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(62))).alias("level")).withColumn("node", F.expr("shiftright(bin, level)"))
    levels = runs.select("level").distinct()  # 63 rows at most
    whole = (
        above.join(F.broadcast(levels), "level", "left_semi").join(runs, ["file", "level", "node"]).groupBy(*KEY).agg(F.min("best").alias("best"))
        .select(*KEY, (F.col("bin") * width).alias("a"), ((F.col("bin") + 1) * width).alias("b"), "best")
    )
    parts = ends.join(bins, KEY, "left_semi").unionByName(whole).select(*KEY, "a", "b", F.struct("best.rank.x", "best.rank.y").alias("rank"), "best.caller")

    def sweep(key: tuple, some_places: pa.Table, some_spans: pa.Table) -> pa.Table:
        rank = [(r["x"], r["y"]) for r in some_spans.column("rank").to_pylist()]
        if not some_places.num_rows:
            return pa.table({"file": pa.array([], pa.string()), "at": pa.array([], pa.int64()), "caller": pa.array([], pa.string())})
        order = sorted(range(len(rank)), key=rank.__getitem__)
        number = [0] * len(rank)
        for n, i in enumerate(order):  # equal ranks share a number
            number[i] = number[order[n - 1]] if n and rank[order[n - 1]] == rank[i] else n
        return _sweep(some_places, some_spans.set_column(some_spans.schema.get_field_index("rank"), "rank", pa.array(number, pa.int64())))

    answers = places.groupBy(*KEY).cogroup(parts.groupBy(*KEY)).applyInArrow(sweep, "file string, at long, caller string")
    named = calls.select("file", "at", "name").distinct()
    own = answers.select(F.col("file").alias("_file"), F.col("at").alias("_at"), "caller")
    same = (named["file"].cast("string") == own["_file"]) & (named["at"].cast("long") == own["_at"])
    return named.join(own, same).select("file", "at", "name", "caller")
