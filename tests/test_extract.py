"""Extraction of declarations, imports and calls: a snippet for each language, and a graph from several files."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import build, resolve
from weftgraph.sources import store
from weftgraph.sources.extract import blanked, brace_ends, read_file

SNIPPETS = {
    ".py": (
        "import os, a.b as c\nfrom x.y import z\nclass A(B):\n    def m(self):\n        return g(1) + len(x)\n        def inner(q):\n            return h(q)\n        k(2)\n"
        "def top(a):\n    async def n():\n        p(1)\n    q(2)\nz(3)\n",
        {("import", "os", None), ("import", "a.b", None), ("import", "x.y", None), ("class", "A", None), ("function", "A.m", None), ("function", "A.inner", None),
         ("function", "top", None), ("function", "n", None), ("call", "g", "A.m"), ("call", "h", "A.inner"), ("call", "k", "A.m"), ("call", "p", "n"), ("call", "q", "top")},
    ),
    ".ts": (
        "import D, { a as b, type T } from './u'; import * as N from \"@/ns\";\nimport 'side'; // fake(1)\nexport default function f(x) { const s = \"no(1)\"; b(x); return `t ${inner(1)} no(2)`; }\n"
        "const g = async (y) => { f(y); return <Comp a={1}><Comp/></Comp> };\nclass K extends L { m(a) { g(a); if (x) { f(1) } } }\n",
        {("import", "side", None), ("import", "./u", None), ("import", "@/ns", None), ("binding", "D", "./u"), ("binding", "b", "./u"), ("binding", "T", "./u"), ("binding", "N", "@/ns"),
         ("class", "K", None), ("function", "f", None), ("function", "g", None), ("function", "K.m", None), ("call", "b", "f"), ("call", "inner", "f"), ("call", "f", "g"),
         ("call", "Comp", "g"), ("call", "g", "K.m"), ("call", "f", "K.m")},
    ),
    ".java": (
        "import java.util.List; import static com.x.Cart.add;\npublic class Foo<T> { public Foo() { bar(); } private static int bar(int x) { String s = \"no(1)\"; return baz(x) + new Item(2).get(); } /* no(3) */ }",
        {("import", "java.util.List", None), ("class", "Foo", None), ("function", "Foo.bar", None), ("call", "baz", "Foo.bar"), ("call", "Item", "Foo.bar"), ("call", "get", "Foo.bar")},
    ),
    ".go": (
        "import \"fmt\"\nimport (\n  a \"x/y\"\n  \"z/w\"\n)\nfunc (r *T) Name(a int) error { foo(1); fmt.Println(\"no(1)\"); return nil }\nfunc main() { r.Name(2) }\n",
        {("import", "fmt", None), ("import", "x/y", None), ("import", "z/w", None), ("function", "T.Name", None), ("function", "main", None), ("call", "foo", "T.Name"), ("call", "Name", "main")},
    ),
    ".rs": (
        "use crate::a::b; use std::{c}; mod q;\npub fn foo<'a>(x: &'a str) -> i32 { let c = '\"'; bar(1); baz::<u8>(2) }\nimpl T { fn m(&self) { foo(\"no(1)\") } }\n",
        {("import", "crate::a::b", None), ("import", "std", None), ("import", "q", None), ("function", "foo", None), ("function", "m", None), ("call", "bar", "foo"), ("call", "baz", "foo"), ("call", "foo", "m")},
    ),
    ".cs": (
        "using System; namespace N { class P { public P() {} public async Task<int> Run(int a) { return Foo(a) + Bar<int>(2); } } }",
        {("import", "System", None), ("class", "P", None), ("function", "P.Run", None), ("call", "Foo", "P.Run"), ("call", "Bar", "P.Run")},
    ),
    ".c": (
        "#include \"u/x.h\"\n#include <stdio.h>\nstatic int foo(int a) { if (a) { bar(a); } return 0; } // zap() {\nint main() { foo(1); printf(\"no(1)\"); }\nint open() { ",
        {("import", "u/x.h", None), ("import", "stdio.h", None), ("function", "foo", None), ("function", "main", None), ("call", "bar", "foo"), ("call", "foo", "main"), ("call", "printf", "main")},
    ),
    ".txt": ("def f(): g()", set()),
}


@pytest.mark.parametrize("end", list(SNIPPETS))
def test_snippets(end):
    text, want = SNIPPETS[end]
    assert set(read_file(end, text).rows) == want
    assert read_file(end, "").rows == []


def test_blanking_keeps_places():
    text = 'a("x // no") // "yes\n/* { \n */ b'
    assert len(blanked(text, '"[^"\n]*"')) == len(text) and blanked(text, None).startswith('a("x // no") ')
    assert blanked(text, None).count("\n") == text.count("\n")
    assert brace_ends("{a{b}{") == {2: 4, 5: 6, 0: 6}


def test_graph_of_scripts(spark):
    files = [
        ("src/a.ts", "import { help } from './lib/b';\nimport Def from '@/c';\nexport function run() { help(); Def(); local(); far(); }\nfunction local() {}\n", 1),
        ("src/lib/b.ts", "export function help() { }\nfunction local() { }\n", 2),
        ("src/c/index.tsx", "export default () => { }\n", 3),
        ("src/d.js", "function far() { }", 4),
        ("src/none.ts", None, 5),
    ]
    g = build.build_graph(spark.createDataFrame(files, "path string, content string, seq long"))
    edges = {(r["source"], r["target"], r["type"]) for r in g.edges.collect()}
    assert edges == {
        ("src/a.ts", "src/lib/b.ts", "imports"), ("src/a.ts", "src/c/index.tsx", "imports"), ("src/a.ts::run", "src/lib/b.ts::help", "calls"),
        ("src/a.ts::run", "src/c/index.tsx", "calls"), ("src/a.ts::run", "src/a.ts::local", "calls"), ("src/a.ts::run", "src/d.js::far", "calls"),
    }
    assert {r["id"]: r["loc"] for r in g.nodes.where("type = 'file'").collect()}["src/a.ts"] == 5


def test_names_first_and_last(spark):
    rows = [("a::K.go", "K.go", 1), ("b::go", "go", 2), ("c::go", "go", 3), ("d::J.run", "J.run", 4), ("e::L.run", "L.run", 5)]
    symbols = spark.createDataFrame(rows, "id string, name string, seq long").withColumn("type", F.lit("function"))
    got = {r["name"]: r["id"] for r in build.name_index(symbols).collect()}
    assert got == {"K.go": "a::K.go", "go": "c::go", "J.run": "d::J.run", "L.run": "e::L.run", "run": "d::J.run"}


def test_snippet_names(spark):
    symbols = spark.createDataFrame([("1", "alone", "f"), ("2", "twin", "f"), ("3", "twin", "g"), ("4", "pair", "x"), ("5", "pair", "y"), ("6", "update", "f")], "id string, name string, file string")
    hits = spark.createDataFrame([(1, "alone", False), (1, "twin", False), (2, "pair", True), (3, "pair", False), (4, "update", False), (5, "update", True)], "snippet int, name string, has_member boolean")
    got = {(r["snippet"], r["id"]) for r in resolve.snippet_symbols(hits, symbols).collect()}
    assert got == {(1, "1"), (1, "2"), (2, "4"), (2, "5"), (5, "6")}


def test_visibility_is_checked(spark):
    repos = spark.createDataFrame([("r", "private")], "id string, visibility string")
    assert store.with_visibility(repos, "r", "public").first()["visibility"] == "public"
    with pytest.raises(ValueError):
        store.with_visibility(repos, "r", "open")


def test_methods_need_a_type_before_their_name():
    text = (
        "public class Shop<T> extends Base {\n  @Override\n  public <K> Map<K, int[]> find(K key, int n) throws Late, Never { return look(key); }\n"
        "  Shop(int a) { init(a); }\n  private final java.util.List<T>\n  items() { return get(1); }\n  static { boot(); }\n"
        "  void run() { if (x) { go(1); } for (int i = 0; i < 9; i++) { step(i); } Runnable r = new Task() { }; }\n  int x = call(3); class In { int deep(int a) { return top(a); } }\n}"
    )
    rows = read_file(".java", text).rows
    assert {n for k, n, _ in rows if k == "function"} == {"Shop.find", "Shop.items", "Shop.run", "Shop.deep", "In.deep"}
    assert {("call", "look", "Shop.find"), ("call", "go", "Shop.run"), ("call", "step", "Shop.run")} <= set(rows)


BIG = {
    ".tsx": "export function App() { return " + "<Row/><Cell a={1}/>" * 60_000 + "; }",
    ".java": "class A { /*" + "\n  note " * 120_000 + "*/ int f() { return g(1); } }",
    ".cs": "class A { /*" + "\n  note " * 120_000 + "*/ int F() { return G(1); } }",
    ".js": "class A { /*" + "\n  note " * 120_000 + "*/ f() { g(1); } }",
    ".c": "int f() { " + "g(h(" * 200_000,
    ".go": "func f() { " + "g(1); " * 150_000 + "}",
    ".py": "def f():\n" + "    g(1)\n" * 100_000,
}


@pytest.mark.parametrize("end", list(BIG))
def test_a_megabyte_takes_linear_time(end):
    import time

    half = BIG[end][: len(BIG[end]) // 2]
    took = []
    for text in (half, BIG[end]):
        began = time.thread_time()
        read_file(end, text)
        took.append(time.thread_time() - began)
    assert took[1] < 6  # quadratic ones take minutes
