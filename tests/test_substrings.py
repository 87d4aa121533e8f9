"""The substring index against looking at every text."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import resolve
from weftgraph.sources import substrings
from weftgraph.sources.substrings import SubstringIndex


@pytest.mark.parametrize("per_key", [10_000, 7])
def test_all_candidates(spark, tmp_path, monkeypatch, per_key):
    monkeypatch.setattr(substrings, "POSTINGS_PER_KEY", per_key)
    rng = random.Random(3)
    texts = [("".join(rng.choice("abcB_") for _ in range(rng.randint(0, 9))), k) for k in range(300)] + [("src/common/Thing.py", k) for k in range(40)] + [(None, 1), ("", 2)]
    wanted = ["".join(rng.choice("abc_") for _ in range(rng.randint(1, 6))) for _ in range(200)] + ["common", "COMMON/thing", "nowhere at all", "", None, "py", "mon"]
    index = SubstringIndex.build(spark.createDataFrame(texts, "text string, best int"), str(tmp_path / "index"))
    asked = spark.createDataFrame([(w,) for w in wanted], "candidate string")
    want_best, want_all = {}, set()
    for w in {w.lower() for w in wanted if w and len(w) > 1}:
        held = [(k, t.lower()) for t, k in texts if t and w in t.lower()]
        if held:
            want_best[w] = min(held)[0]
            want_all |= {(w, t) for _, t in held}
    assert {r["candidate"]: r["best"] for r in index.best(asked).collect()} == want_best
    got = [(r["candidate"], r["text"]) for r in index.matches(asked).collect()]
    assert len(got) == len(set(got)) and set(got) == want_all
    postings = spark.read.parquet(f"{index.path}/postings").groupBy("gram", "share").count()
    assert per_key > 100 or postings.agg(F.max("count")).first()[0] < 4 * per_key


def test_target_cascade_with_an_index(spark, tmp_path):
    rows = [
        ("m1", "src/util.py", "src.util", "module", "src/util.py", 1), ("m2", "lib/util.py", "lib.util", "module", "lib/util.py", 4), ("f1", "load", "src.util.load", "function", "src/util.py", 2),
        ("f2", "reload_all", "lib.util.reload_all", "function", "lib/util.py", 9), ("f3", "load", "lib.other.load", "function", "lib/other.py", 5),
    ]
    symbols = spark.createDataFrame(rows, "id string, name string, qualified_name string, kind string, file string, fan_in long")
    index = SubstringIndex.build(resolve.target_texts(symbols), str(tmp_path / "index"))
    asked = [(1, "delete util.py"), (2, "load"), (3, "my LOAD_ALL thing"), (4, "zzz"), (5, None), (6, "what of load")]
    got = resolve.resolve_targets(spark.createDataFrame(asked, "id int, text string"), symbols, index).collect()
    assert {r["query"]: r["id"] for r in got} == {1: "m2", 2: "f3", 3: "f2", 6: "f3"}
