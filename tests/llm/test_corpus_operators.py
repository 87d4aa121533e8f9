"""Operators 2, 6, 8, 9 and 10 and the pipeline: awkward rows, and comparison with plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import components, fingerprint, interleave, jaccard_join, lm_scoring, packing, suffix_dedup

DATA = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def copies(spark, n=120):
    """Exact and near copies of one text, and of a second group within reach of neither."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(n + i, " ".join(f"z{k}" for k in range(i, i + 40))) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def joined_by_hand(rows):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in classes.items()}
    return sorted(repr((rows[i][0], least[find(i)], links[i])) for i in range(len(rows)))


@pytest.mark.parametrize("settings", [{}, {"bucket": 4, "depth": 2, "block_rows": 16}])
def test_join_of_copies_equals_brute_force(spark, settings):
    docs = copies(spark)
    got = sorted(repr(tuple(r)) for r in jaccard_join.link(docs, **settings).select("doc_id", "class_id", "n_links").collect())
    assert got == joined_by_hand([tuple(r) for r in docs.collect()])


def test_join_of_documents_equals_brute_force(spark):
    docs = documents(spark).select("doc_id", "text").union(awkward(spark).where("doc_id is not null").select(F.col("doc_id") + 10**6, "text"))
    got = sorted(repr(tuple(r)) for r in jaccard_join.link(docs).select("doc_id", "class_id", "n_links").collect())
    assert got == joined_by_hand([tuple(r) for r in docs.collect()])


def test_join_of_awkward_rows(spark):
    got = jaccard_join.link(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    assert [r["n_links"] for r in got if r["doc_id"] == 4] == [1, 1]
    assert all(r["n_links"] == 0 for r in got if r["doc_id"] != 4)
    assert jaccard_join.link(empty(spark)).count() == 0


def test_survival_falls_with_depth():
    values = [jaccard_join.survival(0.8, d) for d in range(5)]
    assert values[0] == 1 and all(a > b for a, b in zip(values, values[1:], strict=False))
    assert values[1] == pytest.approx(0.75 * 0.8 + 0.25 * (1 - 0.2**2))


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(chain.union(spark.createDataFrame([(900, 901)], "a long, b long"))).collect()
    assert len(got) == 203 and {r["root"] for r in got} == {0, 900}


def cut_by_hand(texts, length):
    seen = Counter()
    for t in texts:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append(repr((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def cut(docs, length=200):
    done = suffix_dedup.remove_repeats(docs, length=length)
    return sorted(repr(tuple(r)) for r in done.select("n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect())


def passages(spark):
    rng = random.Random(9)
    letters = "abcdefghij é"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [some(rng.choice([90, 150, 199, 200, 201, 450])) for _ in range(5)]
    rows = [(i, some(rng.randrange(80)) + rng.choice(shared) + some(rng.randrange(300)) + rng.choice(shared)) for i in range(60)]
    return spark.createDataFrame([*rows, (60, "ab" * 400), (61, "é" * 300), (62, some(200)), (63, some(199))], "doc_id long, text string")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=120), max_size=5), st.randoms(use_true_random=False), st.sampled_from([200, 1 << 16]))
def test_merged_transforms_equal_brute_force(parts, rng, shard_bytes):
    texts = [b"".join(rng.choices(parts, k=rng.randrange(6))) for _ in range(9)] if parts else []
    seen = Counter(t[i : i + 64] for t in texts for i in range(len(t) - 63))
    want = [[i for i in range(len(t) - 63) if seen[t[i : i + 64]] > 1] for t in texts]
    assert [x.tolist() for x in interleave.repeated_windows(texts, 64, shard_bytes)] == want


@pytest.mark.parametrize(("per_group", "hot"), [(2000, 10_000), (3, 2)])
def test_cut_passages_equal_brute_force(spark, monkeypatch, per_group, hot):
    monkeypatch.setattr(suffix_dedup, "HALVES_PER_GROUP", per_group)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    docs = passages(spark)
    texts = [r["text"] for r in docs.collect()]
    assert cut(docs) == cut_by_hand(texts, 200)
    assert cut(docs, 100) == cut_by_hand(texts, 100)


def test_cut_awkward_rows(spark):
    assert cut(awkward(spark)) == cut_by_hand([r[1] for r in AWKWARD], 200)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(awkward(spark), length=40)


@pytest.mark.parametrize("capacity", [1, 2, 7, 30, 100])
def test_plans_hold_everything(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        histogram = Counter(rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 3, 200])))
        placed = Counter()
        n = 0
        for p in packing.plan(dict(histogram), capacity):
            assert p.sequences > 0 and 0 < sum(a * b for a, b in p.filling) <= capacity
            n += p.sequences
            for length, times in p.filling:
                placed[length] += times * p.sequences
        assert placed == histogram
        assert n >= math.ceil(sum(a * b for a, b in histogram.items()) / capacity)


def fewest(items, capacity):
    """The least number of sequences, by trying all placements."""
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            place(i + 1, [r - items[i] if j == k else r for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_dominance_never_costs_a_sequence():
    rng = random.Random(1)
    for _ in range(150):
        items = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = [0] * 13
        for x in items:
            counts[x] += 1
        fixed = sum(p.sequences for p in packing.reduce_by_dominance(counts, 12))
        rest = [x for x in range(12, 0, -1) for _ in range(counts[x])]
        assert fixed + (fewest(rest, 12) if rest else 0) == fewest(items, 12)


@pytest.mark.parametrize("lengths", [{1365: 300_000}, {1365: 300_001, 900: 7}, {1500: 100_000, 1296: 100_000, 1300: 100_000, 1000: 50_000}])
def test_number_of_patterns_does_not_grow_with_the_documents(lengths):
    many, few = packing.plan(lengths, 4096), packing.plan({x: -(-n // 1000) for x, n in lengths.items()}, 4096)
    assert len(many) <= len(few) + 8 and len(many) <= 40
    assert sum(p.sequences * k for p in many for x, k in p.filling) == sum(lengths.values())


def test_packed_awkward_rows(spark):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    rows = packing.pack(packing.tokenize(awkward(spark), WORD_BPE)).collect()
    want = []
    for i, text, *_ in AWKWARD:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want += [repr((i, a // 4096, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()))) for a in range(0, len(ids), 4096)]
    assert sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"]))) for r in rows) == sorted(want)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack(packing.tokenize(empty(spark), WORD_BPE)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 5000)], "doc_id long, length long"))


def test_hot_lengths_are_packed_in_parts(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40 + 1).alias("length"))
    rows = packing.pack(pieces, capacity=64, rows_per_task=100).collect()
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        assert [o for o, _ in sorted(places)] == [0, *np.cumsum([n for _, n in sorted(places)])[:-1].tolist()]
    assert len(rows) == 5000 and len(used) <= 1.02 * sum(r["length"] for r in rows) / 64 + 1


def paragraphs(text):
    import regex

    return {p for p in regex.split(r"\n+|(?<=[.!?])[ \t]+(?=\p{Lu})", text) if re.search(r"[^ \t\r\f]", p)}


def compared_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = map(paragraphs, (text, changed, following))
        near = [round(len(a & x) / len(a | x), 6) if a | x else 1.0 for x in (b, c)]
        out.append(repr((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), *near)))
    return sorted(out)


@pytest.mark.parametrize("which", ["documents", "awkward", "one"])
def test_fingerprints_equal_brute_force(spark, which):
    docs = {"documents": documents(spark), "awkward": awkward(spark), "one": awkward(spark).where("doc_id = 9")}[which]
    done = fingerprint.compare_versions(docs)
    got = sorted(repr(tuple(r)) for r in done.select("doc_id", "n_chars", F.sha2("edited", 256), "near_edited", "near_next").collect())
    assert got == compared_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert fingerprint.compare_versions(empty(spark)).count() == 0


def test_equal_texts_have_equal_fingerprints(spark):
    got = fingerprint.compare_versions(awkward(spark)).where("doc_id = 4").select("fingerprint").distinct().count()
    assert got == 1


def test_next_rows_across_buckets(spark):
    docs = spark.range(500).select((F.col("id") * F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    got = {r["text"]: r["next_text"] for r in fingerprint.with_next(docs, rows_per_bucket=3, segments=16).collect()}
    assert got == {f"t{i}": f"t{(i - 1) % 500}" for i in range(500)}


def scored_by_hand(rows, order):
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    texts = [words_of(t) for _, t in rows]
    own = [grams(w) for w in texts]
    every, n_words = sum(own, Counter()), sum(map(len, texts))
    out = []
    for (i, _), w, mine in zip(rows, texts, own, strict=True):
        score = 0.0
        for k in range(len(w)):
            for n in range(min(k + 1, order), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                c = every[g] - mine[g]
                if n == 1:
                    value = max(c, 1) / max(1, n_words - len(w))
                elif c > 0:
                    value = c / (every[g[:-1]] - mine[g[:-1]])
                else:
                    continue
                score += math.log(value * 0.4 ** (min(k + 1, order) - n))
                break
        out.append((i if i is not None else -1, len(w), score))
    return sorted(out)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_brute_force(spark, order):
    docs = documents(spark).select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    done = lm_scoring.score(docs, order=order, block_bytes=20_000).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["log_score"]) for r in done)
    want = scored_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], order)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in done)
    assert lm_scoring.score(empty(spark), order=order).count() == 0


def test_packing_splits_only_where_ranks_give_the_same_ids(tmp_path):
    import json

    library = packing.Tokenizer(WORD_BPE, 1, None).library
    ranks = packing.byte_ranks(WORD_BPE)
    assert len(ranks) == library.get_vocab_size(with_added_tokens=False)
    rng = random.Random(8)
    letters = "aeinorst" * 4 + "ABZéüßñ'sstrellvedm0189.,!?$&-_ \n\t\u00a0\x00\x1f\x85<|>日ж"
    several = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)] + ["", "it's WE'LL 'd've", "x" * 3000]
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in several]
    for tokenizer in (packing.Tokenizer(WORD_BPE, 1, ranks, remembered=50), packing.Tokenizer(WORD_BPE, 1, None)):
        for start in range(0, len(several), 100):
            found = tokenizer.encode(several[start : start + 100])
            assert [memoryview(x).cast("I").tolist() for x in found] == want[start : start + 100]
    # Remembered stretches stay bounded: a generation and one call's new ones.
    bounded = packing.Tokenizer(WORD_BPE, 1, ranks, remembered=50)
    for k in range(20):
        bounded.encode([" ".join(f"w{k}x{i}" for i in range(40))])
        assert len(bounded.young) <= 90 and len(bounded.old) <= 90

    # A token that another merge than its own makes up too: ids by rank would differ.
    with open(WORD_BPE, encoding="utf-8") as file:
        other = json.load(file)
    model = other["model"]
    singles = [t for t, i in sorted(model["vocab"].items(), key=lambda x: x[1])][:512]
    model["merges"] = [["b", "c"], ["a", "b"], ["ab", "c"]]
    model["vocab"] = {t: i for i, t in enumerate([*singles, "bc", "ab", "abc"])}
    changed = tmp_path / "other.json"
    changed.write_text(json.dumps(other))
    assert packing.byte_ranks(str(changed)) is None


def test_packing_keeps_a_worker_s_tokenizer():
    assert packing.tokenizer_of(WORD_BPE, 1) is packing.tokenizer_of(WORD_BPE, 1)
