"""Operators 1, 3, 4, 5 and 7: awkward rows, and comparison with plain Python."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import AWKWARD, awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import byte_bpe, language_id, license_scan, quality_classifier, quality_rules
from weftgraph.llm.common import held_out

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DATA = "/root/testdata/sf0.01"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def encoders():
    ranks = byte_bpe.read_ranks(RANKS)
    own = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), dtype=np.int32).tolist()


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text(alphabet="ab é\n1", max_size=400)))
def test_bpe_equals_the_library(encoders, text):
    assert ids_of(encoders[0], text) == encoders[1].encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 9_999, "ab" * 9_000, "thethe" * 3_000, "é" * 7_000, "\x1c\x85 x"])
def test_bpe_of_long_matches(encoders, text):
    assert ids_of(encoders[0], text) == encoders[1].encode_ordinary(text)
    assert byte_bpe.decode_ids(encoders[0].tokens, ids_of(encoders[0], text)) == text.encode()


def test_bpe_of_documents_is_joined_up_the_tree(spark, encoders):
    rows = [r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    own = byte_bpe.Encoder(encoders[0].ranks, public_tokenizers.PATTERN, remembered_bytes=4 << 20)
    assert all(ids_of(own, t) == encoders[1].encode_ordinary(t) for t in rows)
    assert own.joins > 10_000 and own.known_bytes <= 4 << 20


def test_bpe_join_is_associative(encoders):
    own = encoders[0]
    a, b, c = (own.merge(x) for x in (b"unbeliev", b"ablenesslessness", b"ingthe"))
    assert own.join(own.join(a, b), c) == own.join(a, own.join(b, c)) == own.merge(b"unbelievablenesslessnessingthe")


def test_bpe_of_awkward_rows(spark, encoders):
    decoded = byte_bpe.decode(byte_bpe.encode(awkward(spark), RANKS, public_tokenizers.PATTERN), RANKS)
    got = sorted((r["doc_id"] or -1, tuple(r["ids"]), bytes(r["decoded"])) for r in decoded.collect())
    want = sorted((i or -1, tuple(encoders[1].encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in AWKWARD)
    assert got == want
    assert byte_bpe.decode(byte_bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated, places, covered = set(), 0, defaultdict(list), set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    for starts in places.values():
        if len(starts) > 1:
            covered.update(i + k for i in starts for k in range(3))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), failed


def test_rules_equal_brute_force(spark):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for docs in (awkward(spark), spark.read.parquet(f"{DATA}/documents.parquet")):
        got = sorted(map(repr, (tuple(r) for r in quality_rules.judge(docs).select(*columns).collect())))
        assert got == sorted(repr(rule_counts(r["text"] or "")) for r in docs.select("text").collect())
    assert quality_rules.judge(empty(spark)).count() == 0


def test_rules_remove_lines_and_keep_good_text(spark):
    prose = " ".join(f"Sentence{i} says{i} something{i} new{i} about{i} this{i}." for i in range(12))
    bars = " | ".join(f"link{i}" for i in range(60))
    rows = [(1, f"{prose}\nHome | News | Sport | More\nAll rights reserved."), (2, bars)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["cleaned"] == prose and got[1]["n_failed_lines"] == 2
    assert not got[2]["kept"] and not got[2]["base_failed"]


def test_good_labelled_documents_stay(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = quality_rules.judge(spark.read.parquet(f"{DATA}/documents.parquet")).join(labels.where("quality = 1"), "doc_id")
    assert judged.where("not base_failed and not kept").count() == 0


def license_counts(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(ASCII_LOWER))
    places, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses_equal_brute_force(spark):
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    extra = [(50, "MIT license mit LICENSE apache\nlicense; CC-BY cc by gnu general public license" * 2, None, None, None)]
    tricky = awkward(spark, clashing=False).union(spark.createDataFrame(extra * 2, awkward(spark, clashing=False).schema))
    for docs in (tricky, spark.read.parquet(f"{DATA}/documents.parquet")):
        got = sorted(repr(tuple(r)) for r in license_scan.scan(docs).select(*columns).collect())
        assert got == sorted(repr(license_counts(r["text"] or "")) for r in docs.select("text").collect())
    assert license_scan.scan(awkward(spark)).count() == len(AWKWARD) and license_scan.scan(empty(spark)).count() == 0


def test_licenses_with_changed_words(spark):
    text = license_scan.TEMPLATES[8][0].replace("free of charge", "without any charge").replace("copy of", "copy and part of")
    found = license_scan.scan(spark.createDataFrame([(1, f"Intro words here. {text} and more.")], "doc_id long, text string")).first()
    assert found["labels"] == "mit" and 0.6 <= found["score"] < 1 and found["n_base"] == 0


def test_language_accuracy_and_awkward_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs, ~held)
    named = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held)
    assert named.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    got = language_id.identify(awkward(spark), model, carry=["row"]).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") != has_letter and 0 <= r["score"] <= 1
    assert language_id.identify(empty(spark), model).count() == 0
    assert language_id.fit(empty(spark), F.lit(True)).languages == ()


def test_language_path_equals_plain_viterbi(spark):
    import numpy as np

    model = language_id.train([("aa", "lala lulu lala " * 30), ("bb", "kiki toto kuku " * 30)])
    labeller = language_id.Labeller(model, 5.0)
    words = labeller.words("lala lulu lala lala kiki toto kuku kiki toto lala lulu lala lala lulu")
    scores = labeller.scores[words].astype(float)
    total, back = scores[0].copy(), []
    for s in scores[1:]:
        moves = total[None, :] - 5.0 * (1 - np.eye(2))
        back.append(moves.argmax(axis=1))
        total = moves.max(axis=1) + s
    path = [int(total.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    assert labeller.path(words).tolist() == path[::-1]
    assert [s[0] for s in labeller.spans("lala lulu lala lala kiki toto kuku kiki toto lala lulu lala lala lulu")] == ["aa", "bb", "aa"]


def test_quality_held_out_accuracy_and_awkward_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = held_out(F.col("doc_id"), 5, 0)
    model = quality_classifier.fit(docs, labels.where(~held))
    scored = quality_classifier.score(docs, model).join(labels, "doc_id").where(held)
    assert scored.select(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.93
    got = quality_classifier.score(awkward(spark), model, carry=["score"]).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["row"]["score"] == "other score" for r in got)
    assert quality_classifier.score(empty(spark), model).count() == 0
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(docs.limit(3), none).collect()} == {0.5}
