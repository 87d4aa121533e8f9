"""Coverage and plan queries follow calls for eight steps, as the reference does; compared with plain Python."""

import math
import re
from collections import defaultdict

import pytest

from weftgraph.queries import QUERIES
from weftgraph.sources import derived

DATA = "/root/testdata/sf0.001"
STEPS = 8


def is_test(file):
    return re.search(r"(?:^|/)(?:test_[^/]+\.py|[^/]+_test\.py)$|(?:^|/)(?:tests?|__tests__)/", file) is not None


def within(adjacent, start):
    """Nodes at most STEPS steps from start, with their distance."""
    far, frontier = {start: 0}, [start]
    for d in range(1, STEPS + 1):
        frontier = list({t for s in frontier for t in adjacent[s]} - set(far))
        far |= dict.fromkeys(frontier, d)
    return far


@pytest.fixture(scope="module")
def by_hand(spark):
    g = derived.part_graph(spark, DATA)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    callers = defaultdict(set)
    for r in g.edges.collect():
        callers[r["target"]].add(r["source"])
    tests = {i for i, r in nodes.items() if is_test(r["file"])}
    covered = {i: len(tests & set(within(callers, i)) - {i}) for i in nodes if i not in tests}
    return nodes, callers, tests, covered


def test_coverage_takes_eight_steps(spark, by_hand):
    got = {r["id"]: r["tests"] for r in QUERIES["g11_coverage"](spark, DATA).collect()}
    assert got == by_hand[3]


def test_coverage_summary_takes_eight_steps(spark, by_hand):
    covered = by_hand[3]
    some = sum(n > 0 for n in covered.values())
    percent = math.floor(some * 1000 / len(covered) + 0.5) / 10
    assert tuple(QUERIES["a9_coverage_summary"](spark, DATA).first()) == (len(covered), some, percent)


def test_plan_summary_sums_the_plan_of_eight_steps(spark, by_hand):
    nodes, _, tests, _ = by_hand
    seconds = lambda i: min(10.0, max(0.5, 1 + nodes[i]["loc"] * 0.01)) if nodes[i]["loc"] else 1.5
    plan = {r["id"] for r in QUERIES["g12_test_plan"](spark, DATA).collect()}
    mine, every = sum(math.floor(seconds(i) * 100 + 0.5) / 100 for i in plan), sum(map(seconds, tests))
    got = QUERIES["a10_plan_summary"](spark, DATA).first()
    assert got["tests"] == len(plan)
    assert (got["seconds"], got["all_seconds"]) == pytest.approx((mine, every), abs=1e-3)
    assert got["saved_percent"] == max(0.0, math.floor((1 - mine / every) * 1000 + 0.5) / 10)
