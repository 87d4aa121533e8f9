"""Symbols of a snippet's identifiers, against plain Python, and the rows that are made for them."""

import random

import pytest

from weftgraph.operators import resolve

SYMBOLS, HITS = "id string, name string, file string", "snippet int, name string, has_member boolean"


def by_hand(hits, symbols):
    out, named = set(), {}
    for s in symbols:
        if s[1] is not None:
            named.setdefault(s[1], []).append(s)
    for snippet in {h[0] for h in hits} - {None}:
        mine = {}
        for s, name, member in hits:
            if s == snippet and name is not None:
                mine[name] = mine.get(name) or bool(member)
        met = [n for n in mine if n in named and (mine[n] or n not in resolve.COMMON_NAMES)]
        anchors = {named[n][0][2] for n in met if len(named[n]) == 1} - {None}
        for n in met:
            here = [s for s in named[n] if s[2] in anchors]
            lone = len(named[n]) <= 3 and len(mine) < 4 and mine[n]
            out |= {(snippet, s[0]) for s in (named[n] if len(named[n]) == 1 else here or (named[n] if lone else []))}
    return out


def joined(plan):
    """Rows that the joins of an executed plan put out."""
    kind = plan.nodeName()
    below = plan.executedPlan() if kind == "AdaptiveSparkPlan" else plan.plan() if kind.endswith("QueryStage") else None
    parts = [below] if below is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if "Join" in kind and plan.metrics().contains("numOutputRows") else 0
    return own + sum(map(joined, parts))


@pytest.mark.parametrize("repeated", [False, True])
def test_snippets_equal_plain_python(spark, repeated):
    rng = random.Random(5)
    names = ["update", "render", None, *(f"n{k}" for k in range(30))]
    symbols = [(f"s{k % 150 if repeated else k}", rng.choice(names[: rng.choice([4, 12, 33])]), rng.choice("abcdef") if rng.random() < 0.9 else None) for k in range(160)]
    symbols += [(f"only{k}", f"only{k}", rng.choice(["a", "b", None, "zz"])) for k in range(20)]
    hits = [(rng.choice([None, *range(80)]), rng.choice([*names, "unknown", *(f"only{k}" for k in range(20))]), rng.choice([True, False, None])) for _ in range(400)]
    got = [tuple(r) for r in resolve.snippet_symbols(spark.createDataFrame(hits, HITS), spark.createDataFrame(symbols, SYMBOLS)).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(hits, symbols)


def test_a_name_of_many_symbols_makes_rows_for_answers_alone(spark):
    symbols = [(f"s{k}", "common", f"f{k % 500}") for k in range(2000)] + [(f"o{k}", f"only{k}", f"f{k}") for k in range(50)]
    hits = [(k, "common", False) for k in range(300)] + [(k, f"only{k}", False) for k in range(50)]
    found = resolve.snippet_symbols(spark.createDataFrame(hits, HITS), spark.createDataFrame(symbols, SYMBOLS))
    got = {tuple(r) for r in found.collect()}
    assert got == {(k, f"o{k}") for k in range(50)} | {(k, f"s{j}") for k in range(50) for j in range(k, 2000, 500)}
    assert joined(found._jdf.queryExecution().executedPlan()) < 5000  # 600,000 and more if each snippet met every symbol of a name
