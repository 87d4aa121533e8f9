"""A graph that follows changed files equals the graph of all files, and reads only what a change can touch."""

import pytest

from weftgraph.operators.build import build_graph
from weftgraph.streaming.incremental import IncrementalGraph

SCHEMA = "path string, content string, seq long"
FIRST = [
    ("src/a.py", "import src.b\ndef top():\n    helper(1)\n", 1),
    ("src/b.py", "def helper(x):\n    return deep(x)\n", 2),
    ("src/c.py", "class C:\n    def deep(self):\n        return top()\n", 3),
    ("src/d.py", "def alone():\n    nothing(1)\n", 4),
    ("web/u.ts", "export function f(x) { return g(x); }\nexport const g = (y) => { return 1; };\n", 5),
    ("web/v.ts", "import { f } from './u';\nimport { far } from './later';\nfunction h() { f(1); far(2); }\n", 6),
    ("j/Foo.java", "package j;\npublic class Foo { public int m(int a) { return n(a); } }", 7),
    ("j/Bar.java", "import j.Foo;\nimport j.Late;\npublic class Bar { public int n(int a) { return m(a); } }", 8),
    ("c/x.c", '#include "my.h"\nint main() { go(1); }\n', 9),
    ("go/p/a.go", 'package p\nimport "x/go/q"\nfunc A() { B() }\n', 10),
    ("rs/lib.rs", "use crate::util;\nfn run() { tool(1) }\n", 11),
]
BATCHES = [
    ("a change inside a body", [("src/b.py", "def helper(x):\n    return alone(x)\n", 2)], 0),
    ("a renamed function", [("src/b.py", "def helped(x):\n    return alone(x)\n", 2)], 1),
    ("a name that another file now has first", [("src/0.py", "def alone():\n    pass\n", 0)], 1),
    ("a missing script", [("web/later.ts", "export function far(x) { return 2; }\n", 12)], 1),
    ("a script that loses a name", [("web/u.ts", "export const g = (y) => { return 1; };\n", 5)], 1),
    ("classes, headers, packages, crates", [("j/Late.java", "public class Late { }", 13), ("c/inc/my.h", "int go(int);", 14), ("go/q/b.go", "package q\nfunc B() { A() }\n", 15), ("rs/util.rs", "fn tool(a: i32) { run() }\n", 16)], 4),
    ("deleted files", [("src/a.py", None, 1), ("j/Foo.java", None, 7)], 2),
    ("a file back again, and one twice in a batch", [("src/a.py", "def top():\n    deep(1)\n", 1), ("src/d.py", "def x():\n    pass\n", 4), ("src/d.py", "def alone():\n    top()\n", 17)], 2),
    ("a file that nobody knew", [("none/at/all.py", None, 99)], 0),
]


def rows(graph):
    nodes = sorted(repr(tuple(r)) for r in graph.nodes.select("id", "type", "file", "name", "loc", "seq").collect())
    return nodes, sorted(repr(tuple(r)) for r in graph.edges.select("source", "target", "type").collect())


def test_every_batch_equals_a_full_build(spark, tmp_path):
    kept = {p: (p, c, s) for p, c, s in FIRST}
    graph = IncrementalGraph(spark, str(tmp_path / "graph"), parts=4)
    graph.apply(spark.createDataFrame(FIRST, SCHEMA), "first")
    for what, batch, dependents in [("the first files", [], len(FIRST)), *BATCHES]:
        if batch:
            graph.apply(spark.createDataFrame(batch, SCHEMA), what)
            for p, c, s in batch:
                kept[p] = (p, c, s)
                if c is None:
                    del kept[p]
            told = graph.read("batches").where(f"note = '{what}'").first()
            assert told["changed"] == len({p for p, _, _ in batch}) and told["extracted"] == len({p for p, c, _ in batch if c is not None}), what
            assert told["dependents"] == dependents, what
        assert rows(graph.graph()) == rows(build_graph(spark.createDataFrame(list(kept.values()), SCHEMA))), what
    assert rows(graph.graph(1)) == rows(build_graph(spark.createDataFrame(FIRST, SCHEMA)))  # versions stay


def test_a_stream_of_changes(spark, tmp_path):
    inbox = tmp_path / "inbox"
    graph = IncrementalGraph(spark, str(tmp_path / "graph"), parts=4)
    for k in range(0, len(FIRST), 6):
        spark.createDataFrame(FIRST[k : k + 6], SCHEMA).coalesce(1).write.mode("append").json(str(inbox), ignoreNullFields=False)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(inbox))
    graph.follow(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert graph.tables.version() == 2
    spark.createDataFrame(BATCHES[1][1], SCHEMA).coalesce(1).write.mode("append").json(str(inbox))
    graph.follow(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert graph.tables.version() == 3 and graph.read("batches").count() == 3
    now = {p: (p, c, s) for p, c, s in FIRST + BATCHES[1][1]}
    assert rows(graph.graph()) == rows(build_graph(spark.createDataFrame(list(now.values()), SCHEMA)))
