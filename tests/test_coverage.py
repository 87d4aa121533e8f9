"""Coverage of many nodes by many tests: what it counts, and how many rows it takes."""

import random

import pytest

from weftgraph.graph import CodeGraph
from weftgraph.operators import reachcount, testplan, traverse
from weftgraph.queries import QUERIES
from weftgraph.sources import derived


def test_summary_keeps_a_row_for_a_node_at_most(spark, monkeypatch):
    """Which nodes any test reaches is one search; a row for each node and 64 tests was kept before."""
    data = "/root/testdata/sf0.01"
    g, sizes = derived.part_graph(spark, data), []

    def counted(cut):
        def kept(df):
            out = cut(df)
            sizes.append(out[1] if isinstance(out, tuple) else out.count())
            return out

        return kept

    for module, name in ((testplan, "cut"), (traverse, "cut"), (traverse, "cut_counted")):
        monkeypatch.setattr(module, name, counted(getattr(module, name)))
    got = QUERIES["a9_coverage_summary"](spark, data).first()
    assert 0 < got["covered"] <= got["nodes"]
    assert sizes and sum(n > g.nodes.count() for n in sizes) <= 1  # the edges alone


def by_hand(edges, sources, depth):
    after, count = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for s in sources:
        seen = frontier = {s}
        for _ in range(depth):
            frontier = {t for a in frontier for t in after.get(a, ())} - seen
            seen = seen | frontier
        for n in seen:
            count[n] = count.get(n, 0) + 1
    return count


@pytest.mark.parametrize("limits", [{}, {"STEPS_PER_TASK": 7}, {"SMALL": 0}, {"SMALL": 40}, {"WORK": 900, "STEPS_PER_TASK": 50}, {"BYTES": 1}])
def test_counts_equal_plain_python(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(reachcount, name, value)
    rng = random.Random(3)
    ring = [(f"r{k}", f"r{(k + 1) % 150}") for k in range(150)]
    loose = [(f"a{rng.randrange(60)}", f"a{rng.randrange(60)}") for _ in range(55)]
    edges = ring + loose + [("x", "x"), ("lost", "y"), ("y", None)] + ring[:5]
    sources = [*(f"r{k}" for k in range(0, 150, 2)), *(f"a{k}" for k in range(30)), "x", "alone", "y", "y"]
    places = [(n, rng.choice([None, k])) for k, n in enumerate(sorted({n for e in edges for n in e if n and n != "lost"}))]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = reachcount.reach_counts(frame(edges, "source string, target string"), frame([(s,) for s in sources], "id string"), frame(places, "id string, seq long"), 8)
    got = [tuple(r) for r in found.collect()]
    want = by_hand([e for e in edges if e[1]], set(sources), 8)
    ends = {n for e in edges if e[1] for n in e}
    assert len(got) == len({n for n, _ in got}) and dict(got) == {n: k for n, k in want.items() if n in ends}


def test_counts_keep_no_row_for_a_node_and_some_tests(spark, monkeypatch):
    sizes = []

    def counted(keep):
        def kept(df):
            out = keep(df)
            sizes.append(out.count())
            return out

        return kept

    for module, name in ((testplan, "cut"), (reachcount, "cut"), (reachcount, "stored")):
        if hasattr(module, name):
            monkeypatch.setattr(module, name, counted(getattr(module, name)))
    rows = [(f"t{k}", "tests/test_a.py", k) for k in range(640)] + [("hub", "src/a.py", 0)] + [(f"n{k}", "src/a.py", k) for k in range(300)]
    nodes = spark.createDataFrame([(i, "function", f, i, None, seq) for i, f, seq in rows], "id string, type string, file string, name string, loc int, seq long")
    edges = spark.createDataFrame([(f"t{k}", "hub", "calls") for k in range(640)] + [("hub", f"n{k}", "calls") for k in range(300)], "source string, target string, type string")
    assert {r["tests"] for r in testplan.coverage(CodeGraph(nodes, edges)).collect()} == {640}
    assert max(sizes) <= nodes.count()  # 3650 rows before, ten for each node
