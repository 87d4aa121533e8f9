"""Packed lists: what they hold, searches and ranks by them, and that their edges never move."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.operators import metrics, traverse
from weftgraph.sources import adjacency
from weftgraph.sources.adjacency import PackedAdjacency


def graph(spark, n=60, m=220, seed=2):
    rng = random.Random(seed)
    nodes = [(f"n{k}", "function", "f.py", f"n{k}", None, k) for k in range(n)]
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n - 9)}", "calls") for _ in range(m)] + [("n1", f"n{k}", "calls") for k in range(30)]
    return CodeGraph(spark.createDataFrame(nodes, "id string, type string, file string, name string, loc int, seq long"), spark.createDataFrame(edges, "source string, target string, type string"))


@pytest.mark.parametrize("length", [10_000, 4])
@pytest.mark.parametrize("way", [{}, {"reverse": True}, {"both": True}])
def test_lists_hold_the_edges(spark, monkeypatch, length, way):
    monkeypatch.setattr(adjacency, "LIST_LENGTH", length)
    g = graph(spark)
    pairs = [(r["source"], r["target"]) for r in g.edges.collect()]
    want = sorted(pairs if not way else [(b, a) for a, b in pairs] if way.get("reverse") else pairs + [(b, a) for a, b in pairs])
    rows = PackedAdjacency.build(g.edges, **way).table().collect()
    assert sorted((r["id"], s["to"]) for r in rows for s in r["to"] for _ in range(s["times"])) == want
    assert all(r["fan"] == sum(a == r["id"] for a, _ in want) for r in rows)
    assert length > 100 or max(len(r["to"]) for r in rows) < 5 * length


@pytest.mark.parametrize("few", [256, 0])
@pytest.mark.parametrize("small", [100_000, 0])
def test_searches_are_the_same(spark, monkeypatch, few, small):
    monkeypatch.setattr(traverse, "FEW_IDS", few)
    monkeypatch.setattr(traverse, "BROADCAST_IDS", small)
    g = graph(spark, m=90)
    start = g.nodes.where("id in ('n3', 'n7')").select("id")
    for way, depth in (({"reverse": True}, 3), ({"both": True}, 2), ({}, None)):
        plain = traverse.reach(g.edges, start, depth, reverse=way.get("reverse", False), both=way.get("both", False))
        packed = traverse.reach(PackedAdjacency.build(g.edges, **way), start, depth)
        assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize(("rounds", "length"), [(1, 10_000), (10, 4), (23, 10_000), (50, 4)])
def test_ranks_equal_power_iteration(spark, monkeypatch, rounds, length):
    monkeypatch.setattr(adjacency, "LIST_LENGTH", length)
    g = graph(spark)
    ids = [r["id"] for r in g.nodes.collect()]
    out = {i: [] for i in ids}
    for r in g.edges.collect():
        out[r["source"]].append(r["target"])
    rank, n = dict.fromkeys(ids, 1 / len(ids)), len(ids)
    for _ in range(rounds):
        lost = sum(rank[i] for i in ids if not out[i])
        new = dict.fromkeys(ids, (0.15 + 0.85 * lost) / n)
        for i in ids:
            for j in out[i]:
                new[j] += 0.85 * rank[i] / len(out[i])
        rank = new
    total = sum(rank.values())
    got = {r["id"]: r["pagerank"] for r in metrics.pagerank(g, rounds).collect()}
    assert got == pytest.approx({i: v / total for i, v in rank.items()}, rel=1e-12)


def test_no_exchange_below_the_lists(spark):
    """Neither a level of a search nor a round of ranks moves edges, even where nothing is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        packed = PackedAdjacency.build(graph(spark).edges)
        ids = spark.range(50).select(F.concat(F.lit("n"), "id").alias("id"))
        plan = packed.steps_from(ids)._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("FileScan") - 400 : plan.index("FileScan")]
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Exchange" not in side.split("Filter isnotnull(id")[-1]
        assert "EqualTo(id,n1)" in packed.steps_from_few(["n1"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_queries_on_a_stored_graph_are_the_same(spark):
    from weftgraph import queries
    from weftgraph.sources import derived

    folder = "/root/testdata/sf0.001"
    names = ("g1_pagerank", "g10_covering_tests", "g17_focus", "g23_impact")
    before = {n: sorted(map(repr, queries.QUERIES[n](spark, folder).collect())) for n in names}
    queries.prepare(spark, folder)
    try:
        assert {n: sorted(map(repr, queries.QUERIES[n](spark, folder).collect())) for n in names} == before
    finally:
        derived._prepared.clear()
