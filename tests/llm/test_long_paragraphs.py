"""Operator 9 as registered: texts without line breaks or capitals have more than one paragraph."""

import itertools
import re

import regex

from weftgraph.llm import queries

TEXTS = [
    "plain lower case prose that never ends a sentence " * 12,
    "".join(f"第{i}句话没有空格也没有大写字母。" for i in range(30)),
    " ".join(f"यह वाक्य संख्या {i} है।" for i in range(30)),
    " | ".join(f"item {i}" for i in range(80)),
    "\U0001f600" * 150 + "x" * 900,
    "Short one. Short two.\nA line of its own",
    "unbroken" * 30_000,
    None,
]


def paragraphs(text):
    marks = "。．！？｡؟۔।॥։።။។"
    out = set()
    for p in regex.split(rf"\n+|(?<=[.!?])[ \t]+(?=\p{{Lu}})|(?<=[{marks}])(?![{marks}”’」』）])[ \t]*", text, flags=regex.V1):
        ends = [0, *itertools.takewhile(lambda e: e < len(p), (120 << k for k in itertools.count())), len(p)]
        out |= {p[a:b] for a, b in itertools.pairwise(ends) if re.search(r"[^ \t\r\f]", p[a:b])}
    return out


def test_long_paragraphs_are_cut(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in queries.op9_fingerprint(spark, str(tmp_path)).collect()}
    for i, text in rows:
        text, following = text or "", TEXTS[i - 1] or ""
        half = len(text) // 2
        a, b, c = map(paragraphs, (text, text[: len(text) - half] + following[:half], following))
        assert got[i] == tuple(round(len(a & x) / len(a | x), 6) if a | x else 1.0 for x in (b, c)), i
        assert len(text) <= 240 or got[i][0] > 0
