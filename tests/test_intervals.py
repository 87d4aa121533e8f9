"""The innermost interval around each place, against trying all."""

import random

import pytest

from weftgraph.operators.intervals import enclosing


def by_hand(calls, spans, by):
    out = set()
    for file, at, name in calls:
        around = [(e - s, 0, c) if by == "size" else (-s, e - s, c) for f, c, s, e in spans if f == file and None not in (s, e, at) and s <= at < e]
        if around:
            out.add((file, at, name, min(around)[2]))
    return out


@pytest.mark.parametrize("by", ["size", "start"])
@pytest.mark.parametrize("width", [1, 4, 64, 4096])
def test_all_intervals(spark, by, width):
    rng = random.Random(width)
    spans, calls = [], []
    for file in "ab":
        for k in range(120):
            start = rng.randint(-40, 900)
            spans.append((file, f"c{k % 90}", start, start + rng.choice([0, 1, 3, 40, 500, 1200])))
        calls += [(file, rng.randint(-60, 1500), f"n{k % 5}") for k in range(250)]
    spans += [("a", "none", None, 7), ("a", "empty", 5, 5), ("c", "far", 0, 9)]
    calls += [calls[0], ("a", None, "x"), (None, 3, "x"), ("d", 3, "x")]
    got = enclosing(spark.createDataFrame(calls, "file string, at int, name string"), spark.createDataFrame(spans, "file string, caller string, start int, end int"), by=by, width=width)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == by_hand(calls, spans, by)


def test_nested_definitions_of_one_file_are_few_rows(spark):
    """2000 definitions around each other in one file: no join row for each pair of a call and a definition."""
    n = 2000
    spans = spark.range(n).selectExpr("'a' as file", "concat('c', id) as caller", "id * 100 as start", f"{200 * n} - id * 100 as end")
    calls = spark.range(n).selectExpr("'a' as file", "id * 100 + 50 as at", "'x' as name")
    got = enclosing(calls, spans, width=1024)
    assert {(r["at"], r["caller"]) for r in got.collect()} == {(100 * k + 50, f"c{k}") for k in range(n)}
    made = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in made and "NestedLoop" not in made
