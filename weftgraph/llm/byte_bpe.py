"""Operator 4: byte-level BPE as a tree reduction.

Encoded byte strings form a monoid: two neighbours are joined by re-encoding a window
around their boundary, which grows until the tokens outside provably stay. The proof
is local: a token sequence is the encoding of its bytes exactly if each pair of
adjacent tokens is the encoding of the pair's bytes. So a join is done once the
window's first and last token are such pairs with the tokens outside. A match is
encoded by halves up the tree, from leaves of LEAF_BYTES; decoding concatenates
neighbours up a tree of the same kind, level by level.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import carried, carried_kind, slices, texts

LEAF_BYTES = 6
SLICE_BYTES = 1 << 20
REMEMBERED_BYTES = 96 << 20  # what a task remembers of stretches and of pairs
ENTRY_BYTES = 160  # a remembered entry besides its content
NEVER = 1 << 60
STAYS = [-1]  # stands for a pair of tokens that is the encoding of its own bytes
# Each match of the pattern begins at a single space between two characters that are no white space, or doesn't
# touch it: texts are cut there. Python's white space holds all that the pattern's does.
STRETCH_END = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes byte strings by merge ranks; stretches it has seen are remembered within a budget of bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered_bytes: int = REMEMBERED_BYTES):
        self.ranks, self.pattern, self.budget = ranks, regex.compile(pattern), remembered_bytes
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.leaves: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], list[int]] = {}
        self.joins = 0

    def merge(self, data: bytes) -> list[int]:
        """Plain merging of a leaf or a window: the lowest rank first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        near = [rank(a + b, NEVER) for a, b in pairwise(parts)]
        while near:
            best = min(near)
            if best == NEVER:
                break
            i = near.index(best)
            both = parts[i] + parts.pop(i + 1)
            parts[i] = both
            del near[i]
            if i < len(near):
                near[i] = rank(both + parts[i + 1], NEVER)
            if i:
                near[i - 1] = rank(parts[i - 1] + both, NEVER)
        return [self.ranks[p] for p in parts]

    def leaf(self, data: bytes) -> list[int]:
        """Encoding of a few bytes, remembered."""
        found = self.leaves.get(data)
        if found is None:
            if len(self.leaves) * ENTRY_BYTES > self.budget // 4:
                self.leaves.clear()
            found = self.leaves[data] = self.merge(data)
        return found

    def pair(self, key: tuple[int, int]) -> list[int]:
        """Encoding of the bytes of two tokens; the tokens themselves if they stay."""
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) * ENTRY_BYTES > self.budget // 4:
                self.pairs.clear()
            a, b = key
            found = self.merge(self.tokens[a] + self.tokens[b])
            self.pairs[key] = found = STAYS if found == [a, b] else found
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings."""
        self.joins += 1
        pairs = self.pairs.get
        key = (left[-1], right[0])
        middle = pairs(key) or self.pair(key)
        if middle is STAYS:
            return left + right
        a, b = len(left) - 1, 1  # the window: left[a:] and right[:b]
        while True:
            before = after = True
            if a > 0:
                key = (left[a - 1], middle[0])
                before = (pairs(key) or self.pair(key)) is STAYS
            if b < len(right):
                key = (middle[-1], right[b])
                after = (pairs(key) or self.pair(key)) is STAYS
            if before and after:
                return left[:a] + middle + right[b:]
            # The side that doesn't stay gives the window as many tokens as it has from there already.
            a = a if before else max(0, 2 * a - len(left))
            b = b if after else 2 * b
            window = b"".join([self.tokens[t] for t in left[a:] + right[:b]])
            middle = self.leaf(window) if len(window) <= 2 * LEAF_BYTES else self.merge(window)

    def reduce(self, data: bytes) -> list[int]:
        """Encoding of a byte string, by halves down to the leaves."""
        n = len(data)
        if n <= LEAF_BYTES:
            return self.leaves.get(data) or self.leaf(data)
        half = n // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def stretch(self, text: str) -> bytes:
        """Packed ids of a stretch: each match of the pattern for itself; one that is a token stays whole, as in the library."""
        out = array("i")
        for piece in self.pattern.findall(text):
            data = piece.encode("utf-8")
            token = self.ranks.get(data)
            if token is not None:
                out.append(token)
            else:
                out.extend(self.reduce(data))
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Packed 32-bit ids of a text, put together from its stretches."""
        first, *others = STRETCH_END.split(text)
        found = [first, *[" " + s for s in others]]
        known = self.known
        at = list(map(known.get, found))
        if None in at:
            for k, ids in enumerate(at):
                if ids is None:
                    s = found[k]
                    ids = known.get(s)
                    if ids is None:
                        ids = self.stretch(s)
                        cost = ENTRY_BYTES + 4 * len(s) + len(ids)
                        if self.known_bytes + cost > self.budget:
                            known.clear()
                            self.known_bytes = 0
                        if cost <= self.budget // 64:  # a very long stretch isn't kept
                            known[s] = ids
                            self.known_bytes += cost
                    at[k] = ids
        return b"".join(at)


def decode_ids(tokens: list[bytes], ids: list[int]) -> bytes:
    """Bytes of tokens: neighbours are concatenated, level by level, up to the root."""
    level = [tokens[i] for i in ids]
    while len(level) > 1:
        level = [a + b for a, b in zip(level[::2], level[1::2])] + level[len(level) & ~1 :]
    return level[0] if level else b""


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, *, carry: list[str] | None = None) -> DataFrame:
    """Token ids of every row's whole text, and the bytes these decode to: (doc_id, ids array<int>, decoded binary).

    With columns to carry there is also a struct of these, named row. Null and empty
    texts give no ids and no bytes. One row out for each row in, equal ones for repeated
    rows; only doc_id and text are read, so further columns can't clash; an empty table
    gives an empty one. A task holds a slice of about a megabyte of text, or one longer
    text with its ids and bytes (about ten times its size), and remembers encoded
    stretches within REMEMBERED_BYTES. ranks_path must be readable on each executor.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(ranks_path), pattern)
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            packed = [encoder.encode(t) for t in texts(batch.column(1))]
            decoded = [decode_ids(encoder.tokens, np.frombuffer(p, dtype=np.int32).tolist()) for p in packed]
            offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(packed), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(decoded, pa.binary()), *batch.columns[2:]],
                names=["doc_id", "ids", "decoded", *batch.schema.names[2:]],
            )

    read = docs.select("doc_id", "text", *carried(docs, carry))
    return read.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary" + carried_kind(read))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Token ids of every row's whole text: (doc_id, ids array<int>). Rows, nulls and sizes as in encode_and_decode."""
    return encode_and_decode(docs, ranks_path, pattern).select("doc_id", "ids")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Bytes of every row's ids: (doc_id, ids, decoded binary); null ids decode to no bytes, repeated rows to equal ones."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Encoder(read_ranks(ranks_path), "").tokens
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                decoded = [decode_ids(tokens, ids or []) for ids in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")
