"""Operator 13 against a brute-force alignment by the libraries themselves."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, empty

from weftgraph.llm import alignment
from weftgraph.llm.queries import op13_alignment

DATA = "/root/testdata/sf0.001"
PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
ODD = ["  a  b", "a▁b", "\x00x y", "a\tb\n c", " ", "\n", "a b c", "x" * 3000, "a <|endoftext|> b", "<s> <0x41>", "日本語 текст", "a  b " * 300, " a  b"]


def sides(text):
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = {c: i for i, c in alignment.BYTE_LETTERS.items()} | {x: x for x in range(256) if x not in alignment.BYTE_LETTERS}
    names = {i: bytes(shown[ord(c)] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}

    def of(text):
        if not text:
            return None
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = [names[i] for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
            return None
        return a_ids, b_ids, np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()

    return of


def by_hand(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    of, found = sides(None), []
    for text in texts:
        both = of(text)
        if both is None:
            found.append(None)
            continue
        a, b, ends_a, ends_b = both
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        links, p, q = [], 0, 0
        while p < len(a):
            links.append((a[p], b[q]))
            x, y = ends_a[p], ends_b[q]
            p, q = p + (x <= y), q + (y <= x)
        found.append((len(a), len(b), groups, links))
    count = Counter(pair for f in found if f for pair in set(f[3]))
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    return [
        (f[0], f[1], len(f[2]), len(f[3]), sum(count[x] == highest[x[0]] for x in f[3]), sum(count[x] for x in f[3]), ";".join(f[2])) if f else (0,) * 6 + ("",)
        for f in found
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("block_bytes", [1, 5000, 16 << 20])
def test_awkward_and_odd_rows(spark, block_bytes):
    docs = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(ODD, 100)), "doc_id long, text string"))
    rows = docs.collect()
    got = alignment.align(docs, *PATHS, block_bytes=block_bytes).collect()
    want = [(r["doc_id"], *x) for r, x in zip(rows, by_hand([r["text"] for r in rows]), strict=True)]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], *(r[c] for c in COLUMNS))) for r in got)


def test_clashing_columns_and_empty_tables(spark):
    assert alignment.align(awkward(spark), *PATHS).count() == awkward(spark).count()
    assert alignment.align(empty(spark), *PATHS).count() == 0


def test_registered_query_over_all_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: x for r, x in zip(docs, by_hand([r["text"] for r in docs]), strict=True)}
    got = {r["doc_id"]: r for r in op13_alignment(spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, x in want.items():
        shown = hashlib.sha256(x[6].encode()).hexdigest() if x[6] else ""
        assert (*x[:6], shown) == tuple(got[i][c] for c in [*COLUMNS[:6], "groups_sha256"])


def test_forgetting_and_the_library_path_change_nothing():
    texts = [t for t in ODD if "▁" not in t] + ["one two three one two", "four five six " * 50]
    full, small = alignment.Aligner(*PATHS), alignment.Aligner(*PATHS, remembered_bytes=4000)
    small.a.fast = None
    assert full.align(texts) == small.align(texts) == [small.align([t])[0] for t in texts]


def test_cuts_of_random_ends():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 3000):
        a, b = (np.unique(np.append(rng.integers(1, 6 * n, n), 6 * n)) for _ in range(2))
        known = np.array([len(a)]), np.array([len(b)])
        x, y = alignment.shared_cuts(a, b, *known)
        assert a[x - 1].tolist() == b[y - 1].tolist() == np.intersect1d(a, b).tolist()
