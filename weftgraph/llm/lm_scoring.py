"""Operator 10: stupid-backoff scores of texts, from n-gram counts of the whole corpus.

A relational plan. Texts are dealt to blocks of a few megabytes, and each block is
exploded to its n-grams, a row each with its hash and how often the block has it. The
rows are partitioned by hash and summed: the count tables, which are joined back to
the n-grams. Each block's texts meet the joined rows; the terms of a text's words, a
row for each length of n-gram that was found, are summed per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import joined, mix, word_hashes, word_starts
from .common import release, slices

SLICE_BYTES = 1 << 20

# Fixed value of the scheme: what a step to a shorter n-gram multiplies the score by.
BACKOFF = 0.4
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def ngrams(data: np.ndarray, rows: np.ndarray, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The row of each word, and for n from 1 to order the words that end an n-gram within their row and its hash."""
    words, row = word_hashes(data, rows)
    out = []
    total = np.zeros(len(words), dtype=np.uint64)
    for n in range(1, order + 1):
        # The hash of n words: each shorter one is continued by the next word.
        total = words.copy() if n == 1 else np.concatenate([total[:1], total[:-1] * _PLACE + words[1:]])
        at = np.arange(n - 1, len(words))
        at = at[row[at] == row[at - (n - 1)]]
        out.append((at, mix(total[at] + np.uint64(n))))
    return row, out


def words_in(docs: DataFrame) -> DataFrame:
    """(words, bytes) of the texts of a batch: a row each, to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
            data, rows = joined(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([int(word_starts(data, rows).sum())]), pa.array([len(data)])], names=["words", "bytes"])

    return docs.select("text").mapInArrow(run, "words long, bytes long")


def added(gram: np.ndarray, n: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted n-grams and their counts, with further occurrences counted in."""
    new, times = np.unique(np.concatenate(more), return_counts=True)
    at = np.searchsorted(gram, new)
    known = np.zeros(len(new), dtype=bool)
    inside = at < len(gram)
    known[inside] = gram[at[inside]] == new[inside]
    n[at[known]] += times[known].astype(np.int32)
    return np.insert(gram, at[~known], new[~known]), np.insert(n, at[~known], times[~known].astype(np.int32))


def packed(docs: DataFrame, n_blocks: int) -> DataFrame:
    """(block, key, doc_id, text): rows dealt to blocks by a hash of their content, texts compressed for the shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in (part for whole in batches for part in slices(whole, 3, SLICE_BYTES)):
            small = [compressor.compress(t or b"") for t in batch.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(small, pa.binary())], names=batch.schema.names)

    key = F.xxhash64("doc_id", "text")
    dealt = docs.select(F.pmod(key, F.lit(n_blocks)).cast("int").alias("block"), key.alias("key"), "doc_id", "text")
    return dealt.mapInArrow(run, f"block int, key long, doc_id {kind}, text binary")


def unpacked(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of a block's rows a slice at a time: the number of its first row, all bytes, and where each row begins."""
    decompress = zstandard.ZstdDecompressor().decompress
    first, held, size = 0, [], 0
    for small in rows.column("text").to_pylist():
        held.append(decompress(small))
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield first, *joined(pa.array(held, pa.large_binary()))
            first, held, size = first + len(held), [], 0
    yield first, *joined(pa.array(held, pa.large_binary()))


def own_counts(row: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """How often the text itself has each n-gram: the length of its run, sorted by text and n-gram."""
    ordered = np.lexsort((gram, row))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(gram[ordered]) != 0) | (np.diff(row[ordered]) != 0)]))
    runs = np.diff(np.append(new, len(ordered)))
    own = np.empty(len(gram))
    own[ordered] = np.repeat(runs, runs)
    return own


def score(docs: DataFrame, *, order: int = 2, leave_out: bool = True, block_bytes: int = 40 << 20) -> DataFrame:
    """Stupid-backoff score of every row's whole text under the counts of all rows.

    Returns doc_id, n_words, n_found (words whose longest n-gram was found), log_score
    (natural logarithm, summed over the words) and mean_log_score. A word's score is
    count(n-gram) / count(n-gram without it) for the longest n-gram with a count, times
    0.4 for each step to a shorter one; the shortest is count(word) / all words, with a
    count of one for a word that has none. With leave_out a text's own n-grams don't
    count for it. Words are lower-cased runs of ASCII letters, digits and characters
    beyond ASCII; n-grams are told apart by a 64-bit hash. A text without words (null,
    empty) has n_words 0, log_score 0 and a null mean. One row out for each row in,
    repeated rows included, none for an empty table; only doc_id and text are read. A
    block holds about block_bytes of text, or one longer text; a task holds the block's
    distinct n-grams and a slice of a megabyte, or one longer text with some hundred
    bytes for each of its words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = words_in(docs).agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    all_words, n_blocks = int(size[0]), max(1, math.ceil(size[1] / block_bytes))
    blocked = packed(docs, n_blocks)

    def explode(key: tuple, rows: pa.Table) -> pa.Table:
        gram, n, waiting = np.empty(0, np.uint64), np.empty(0, np.int32), []
        for k, (_, data, at) in enumerate(unpacked(rows), 1):
            waiting += [h for _, h in ngrams(data, at, order)[1]]
            if k % 4 == 0:
                gram, n = added(gram, n, waiting)
                waiting = []
        if waiting:
            gram, n = added(gram, n, waiting)
        waiting = []
        release()
        return pa.table({"block": np.full(len(gram), key[0].as_py(), np.int32), "gram": gram.view(np.int64), "n": n})

    def terms_of(first: int, data: np.ndarray, begins: np.ndarray, gram: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, length, found, words, term) for the texts of a slice and each length of n-gram, by the joined n-grams of the block."""
        row, grams = ngrams(data, begins, order)
        own_words = np.bincount(row, minlength=len(begins) - 1)
        counts = np.zeros((order, len(row)), dtype=np.float64)
        for n, (at, h) in enumerate(grams):
            if len(gram):
                place = np.minimum(np.searchsorted(gram, h), len(gram) - 1)
                counts[n, at] = np.where(gram[place] == h, total[place], 1)  # an n-gram without a row occurs once in all
            else:
                counts[n, at] = 1
            if leave_out and len(at):
                counts[n, at] -= own_counts(row[at], h)
        others = np.maximum(1.0, all_words - (own_words[row] if leave_out else 0))
        longest = np.zeros(len(row), dtype=np.int64)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        term = np.log(np.maximum(counts[0], 1.0) / others) + np.minimum(place, order - 1) * math.log(BACKOFF)
        for n in range(1, order):
            at = np.flatnonzero(counts[n] > 0)
            steps = np.minimum(place[at], order - 1) - n
            term[at] = np.log(counts[n, at] / counts[n - 1, at - 1]) + steps * math.log(BACKOFF)
            longest[at] = n
        found = (counts[0] > 0) & (longest == np.minimum(place, order - 1))
        # Summed for each text and length of the n-gram found; a text without words has a row too.
        slot = row * order + longest
        n = order * (len(begins) - 1)
        words, hits, terms = (np.bincount(slot, weights=w, minlength=n) for w in (None, found, term))
        some = np.flatnonzero((words > 0) | ((np.arange(n) % order == 0) & (np.repeat(own_words, order) == 0)))
        return some // order + first, some % order + 1, hits[some].astype(np.int64), words[some].astype(np.int64), terms[some]

    def look_up(key: tuple, rows: pa.Table, counted: pa.Table) -> pa.Table:
        # A place among the block's rows tells rows of one id apart; sorted, so that a retry gives the same.
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("key", "ascending"), ("doc_id", "ascending")]))
        gram = counted.column("gram").to_numpy().view(np.uint64)
        by_gram = np.argsort(gram)
        gram, total = gram[by_gram], counted.column("total").to_numpy()[by_gram]
        del by_gram
        parts = [terms_of(*part, gram, total) for part in unpacked(rows)]
        at, level, found, words, term = (np.concatenate(x) for x in zip(*parts, strict=True))
        del gram, total, parts
        release()
        return pa.table(
            {
                "block": np.full(len(at), key[0].as_py(), np.int32),
                "place": at.astype(np.int32),
                "doc_id": rows.column("doc_id").take(pa.array(at)),
                "level": level.astype(np.int32),
                "words": words,
                "found": found,
                "term": term,
            }
        )

    grams = blocked.groupBy("block").applyInArrow(explode, "block int, gram long, n int")
    # The count tables, partitioned by hash, joined to the n-grams they count: a row a block at most, so no key is hot.
    counted = grams.withColumn("total", F.sum("n").over(Window.partitionBy("gram"))).where("total > 1").select("block", "gram", "total")
    terms = (
        blocked.groupBy("block")
        .cogroup(counted.groupBy("block"))
        .applyInArrow(look_up, f"block int, place int, doc_id {kind}, level int, words long, found long, term double")
    )
    n_words, total = F.sum("words"), F.sum("term")
    return terms.groupBy("block", "place", "doc_id").agg(
        n_words.alias("n_words"), F.sum("found").alias("n_found"), total.alias("log_score"), F.when(n_words > 0, total / n_words).alias("mean_log_score")
    ).drop("block", "place")
