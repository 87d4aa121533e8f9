"""Nodes of the same qualified name become one, against plain Python."""

import random

from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.operators.merge import merge_nodes

NODES = "id string, type string, file string, name string, loc int, seq long"
EDGES = "source string, target string, type string"


def merged(spark, nodes, edges):
    g = merge_nodes(CodeGraph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)), F.col("name"))
    return sorted(tuple(r) for r in g.nodes.select(*[c.split()[0] for c in NODES.split(", ")]).collect()), sorted(tuple(r) for r in g.edges.collect())


def test_merge_equals_plain_python(spark):
    rng = random.Random(3)
    # A third of the nodes share one name, some have none, and seq has ties.
    nodes = [(f"n{k:03}", "function", f"f{k}", rng.choice(["hot", "hot", None, f"u{k}", f"v{k % 9}", ""]), None, k // 3) for k in range(150)]
    ids = [n[0] for n in nodes] + ["unknown"]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice(["calls", "imports"])) for _ in range(900)] + [("n001", "n001", "calls")] * 2
    first = {}
    for n in sorted(nodes, key=lambda n: (n[5], n[0])):
        first.setdefault(n[3], n[0])
    kept = {n[0]: n[0] if n[3] is None else first[n[3]] for n in nodes}
    want = {(kept[s], kept[t], k) for s, t, k in edges if s in kept and t in kept and (kept[s] != kept[t] or s == t)}
    assert merged(spark, nodes, edges) == (sorted(n for n in nodes if kept[n[0]] == n[0]), sorted(want))


def test_empty_graph(spark):
    assert merged(spark, [], []) == ([], [])
