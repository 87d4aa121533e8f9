"""Operator 13: alignment of two tokenizers' tokens of one text, by divide and conquer at shared cuts.

Both token sequences cover the same bytes. Where a token of either side ends at the same
byte, both can be cut. An interval is divided at a shared end near its middle, found by
bisection, and both halves are treated alike; an interval without a shared end inside is
a group. The first cuts are known beforehand: no token of either side spans a single
space between two characters that are no white space, so texts fall into stretches
there. New stretches are divided many at a time, and what one divides into is remembered.

Texts are tokenized once. A task writes for each block of its texts the different id
pairs of the links, and for each text the numbers of its pairs in that list. Spark counts
the pairs of all blocks and gives the counts back to the blocks, where texts look them up.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, stored
from .packing import BYTE_LETTERS

SLICE_BYTES = 1 << 20
REMEMBERED_BYTES = 128 << 20  # what a Python worker remembers of stretches
ENTRY_BYTES = 400  # a remembered stretch besides its texts
STRETCH_END = re.compile(r"(?<=\S) (?=\S)")
FEW = 64  # so few intervals are divided one by one
BROADCAST_ROWS = 200_000  # a table of id pairs with more rows is joined by a shuffle
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def common_end(a: np.ndarray | list, b: np.ndarray | list, i: int, k: int, j: int, m: int) -> tuple[int, int] | None:
    """The shared end nearest to the middle of tokens i..k of a and j..m of b, as the places behind it; the outer end is none."""
    last = k - 1
    middle = (i + last - 1) // 2
    for step in range(max(middle - i, last - 1 - middle) + 1):
        for p in (middle - step, middle + step):
            if i <= p < last:
                q = bisect_left(b, a[p], j, m - 1)
                if q < m - 1 and b[q] == a[p]:
                    return p + 1, q + 1
    return None


def shared_cuts(a: np.ndarray, b: np.ndarray, behind_a: np.ndarray, behind_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shared cuts of two ascending lists of ends, as places behind tokens of each side, in order.

    behind_a and behind_b are the cuts known beforehand, the last ones included. All
    intervals between them are divided at once: each round bisects for one end of each,
    from its middle outwards.
    """
    i, k = np.concatenate([[0], behind_a[:-1]]), np.asarray(behind_a)
    j, m = np.concatenate([[0], behind_b[:-1]]), np.asarray(behind_b)
    step = np.zeros(len(k), np.int64)
    found_a, found_b = [k], [m]
    while True:
        more = (k - i > 1) & (m - j > 1)
        i, k, j, m, step = (x[more] for x in (i, k, j, m, step))
        if len(i) <= FEW:
            break
        last = k - 1
        middle = (i + last - 1) // 2
        p = middle + np.where(step % 2 == 1, (step + 1) // 2, -(step // 2))
        inside = (p >= i) & (p < last)
        q = np.searchsorted(b, a[np.where(inside, p, i)])
        hit = inside & (b[q] == a[np.where(inside, p, i)])
        open_still = ~hit & (step < 2 * np.maximum(middle - i, last - 1 - middle) + 1)
        p, q = p[hit] + 1, q[hit] + 1
        found_a.append(p)
        found_b.append(q)
        i, k = np.concatenate([i[open_still], i[hit], p]), np.concatenate([k[open_still], p, k[hit]])
        j, m = np.concatenate([j[open_still], j[hit], q]), np.concatenate([m[open_still], q, m[hit]])
        step = np.concatenate([step[open_still] + 1, np.zeros(2 * len(p), np.int64)])
    ends_a, ends_b = a.tolist() if len(i) else [], b.tolist() if len(i) else []
    todo, late = [tuple(map(int, x)) for x in zip(i, k, j, m, strict=True)], []
    while todo:
        i, k, j, m = todo.pop()
        cut = common_end(ends_a, ends_b, i, k, j, m) if k - i > 1 and m - j > 1 else None
        if cut:
            late.append(cut)
            todo += [(i, cut[0], j, cut[1]), (cut[0], k, cut[1], m)]
    found_a.append(np.array([x for x, _ in late], np.int64))
    found_b.append(np.array([x for _, x in late], np.int64))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


class ByteBpe:
    """Ids of side a, by a tokenizers file with byte-level letters; by tiktoken if its ids are in the order of its merges."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        import tiktoken
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are plain text
        letters = {chr(letter): byte for byte, letter in BYTE_LETTERS.items()} | {chr(x): x for x in range(256) if x not in BYTE_LETTERS}
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        plain = {bytes(letters[c] for c in token): i for token, i in self.library.get_vocab().items() if token not in special}
        self.bytes_of = [b""] * (max(plain.values()) + 1)
        for token, i in plain.items():
            self.bytes_of[i] = token
        with open(path, encoding="utf-8") as f:
            merges = [m.split(" ") if isinstance(m, str) else m for m in json.load(f)["model"]["merges"]]
        merged = [plain[bytes(letters[c] for c in "".join(m))] for m in merges]
        in_order = merged == sorted(merged) and set(plain.values()) == set(range(len(plain)))
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=plain, special_tokens={}) if in_order else None

    def encode(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if self.fast else self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of side b, by a sentencepiece model, which sets a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # A piece with a space behind another character would span the end of a stretch.
        self.by_stretch = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


class Aligner:
    """What both tokenizers make of a text.

    Stretches it has seen are remembered within a budget of bytes: when the young ones
    take half of it, those not asked for since the last time are forgotten.
    """

    def __init__(self, byte_path: str, piece_path: str, pattern: str, remembered_bytes: int = REMEMBERED_BYTES):
        self.a, self.b, self.budget = ByteBpe(byte_path, pattern), Pieces(piece_path), remembered_bytes
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side.bytes_of]) for side in (self.a, self.b))
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.young_bytes = 0

    def divided(self, several: list[str]) -> list[tuple | None]:
        """For stretches that stand behind one another, each behind a space: (groups as text, tokens of a, of b, groups, id pairs of the links).

        None for one whose bytes a side changes.
        """
        text = " ".join(several)
        whole = b" " + text.encode()
        a_ids, b_ids = self.a.encode(" " + text), self.b.encode(text)
        a_bytes, b_bytes = self.a.bytes_of, self.b.bytes_of
        if b"".join([a_bytes[i] for i in a_ids]) != whole or b"".join([b_bytes[i] for i in b_ids]) != whole:
            return [None] if len(several) == 1 else [self.divided([s])[0] for s in several]
        a_id, b_id = np.array(a_ids), np.array(b_ids)
        a, b = np.cumsum(self.a_sizes[a_id]), np.cumsum(self.b_sizes[b_id])
        ends = np.cumsum([1 + len(s.encode()) for s in several])
        cut_a, cut_b = shared_cuts(a, b, np.searchsorted(a, ends) + 1, np.searchsorted(b, ends) + 1)
        # Between two neighbouring ends of either side lies one overlap of a token of a with one of b.
        between = np.union1d(a, b)
        pair = (a_id[np.searchsorted(a, between)].astype(np.uint64) << np.uint64(32)) | b_id[np.searchsorted(b, between)].astype(np.uint64)
        links = np.searchsorted(between, ends) + 1
        packed = pair.tobytes()
        a_shown, b_shown = list(map(str, a_ids)), list(map(str, b_ids))
        shown, i, j = [], 0, 0
        for k, m in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
            shown.append(f"{','.join(a_shown[i:k])}|{','.join(b_shown[j:m])}")
            i, j = k, m
        out = []
        g = x = i = j = 0
        behind = (np.searchsorted(a[cut_a - 1], ends) + 1, np.searchsorted(a, ends) + 1, np.searchsorted(b, ends) + 1, links)
        for h, k, m, y in zip(*(v.tolist() for v in behind), strict=True):
            out.append((";".join(shown[g:h]), k - i, m - j, h - g, packed[8 * x : 8 * y]))
            g, i, j, x = h, k, m, y
        return out

    def keep(self, stretch: str, found: tuple | None) -> None:
        cost = ENTRY_BYTES + 2 * len(stretch) + (len(found[0]) + len(found[4]) if found else 0)
        if found is None or cost > self.budget // 64:  # a very long stretch isn't kept
            return
        if self.young_bytes + cost > self.budget // 2:
            self.old, self.young, self.young_bytes = self.young, {}, 0
        self.young[stretch] = found
        self.young_bytes += cost

    def align(self, several: list[str]) -> list[list[tuple] | None]:
        """What the stretches of each text divide into; None for an empty text or one whose bytes a side changes."""
        split = [(STRETCH_END.split(t) if self.b.by_stretch else [t]) if t else [] for t in several]
        wanted, fresh, asked = set().union(*split), {}, []
        for s in wanted:
            found = self.young.get(s)
            if found is None:
                found = self.old.get(s)
                if found is None:
                    asked.append(s)
                    continue
                self.keep(s, found)
            fresh[s] = found
        inner = [s for s in asked if not s[0].isspace() and not s[-1].isspace()]
        for s in set(asked).difference(inner):
            fresh[s] = self.divided([s])[0]
        batch, size = [], 0
        for n, s in enumerate(inner, 1):
            batch.append(s)
            size += len(s)
            if size > 1 << 17 or n == len(inner):
                fresh.update(zip(batch, self.divided(batch), strict=True))
                batch, size = [], 0
        for s in asked:
            self.keep(s, fresh[s])
        out = [list(map(fresh.__getitem__, x)) for x in split]
        return [x if x and None not in x else None for x in out]


_aligners: dict[tuple, Aligner] = {}


def aligner(*paths: str) -> Aligner:
    """One for all tasks of a Python worker."""
    if paths not in _aligners:
        _aligners.clear()
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def gathered(pair: np.ndarray, n: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different sorted pairs and their counts, with further occurrences counted in."""
    every, weight = np.concatenate([pair, *more]), np.concatenate([n, np.ones(sum(map(len, more)), np.int64)])
    pair, at = np.unique(every, return_inverse=True)
    return pair, np.bincount(at, weights=weight, minlength=len(pair)).astype(np.int64)


def align(docs: DataFrame, byte_path: str, piece_path: str, pattern: str, *, digests: bool = False, block_bytes: int = 16 << 20) -> DataFrame:
    """Groups and links of every row's tokens by two tokenizers, with the links' counts over all rows.

    byte_path is a tokenizers file with byte-level letters and pattern how it splits
    (side a), piece_path a sentencepiece model (side b); both must be readable on each
    executor. A row's bytes are a space and its text. Returns doc_id, n_a, n_b (tokens),
    n_groups (between bytes where tokens of both sides end), n_links (pairs of tokens with
    overlapping bytes), n_best (links whose id pair is in as many rows as any pair of its
    a id), count_sum (over the links, how many rows hold their id pair linked) and groups
    (`a1,a2|b1;a3|b2`), or with digests their SHA-256 in its place. Null and empty texts,
    and those whose bytes a tokenizer changes, have no tokens: zeros and an empty string.
    One row out for each row in; repeated rows are rows of their own and count as such; an
    empty table gives an empty one. Only doc_id and text are read, so further columns
    can't clash. A task holds a slice of a megabyte of text, or one longer text with some
    hundred bytes for each of its bytes, and the id pairs of a block of block_bytes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    doc_type = docs.select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(byte_path, piece_path, pattern)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        first = TaskContext.get().partitionId() << 32
        block, size, pair, n, waiting = 0, 0, np.empty(0, np.uint64), np.empty(0, np.int64), []
        rows: list[tuple] = []
        ids: list[pa.Array] = []

        def close() -> Iterator[pa.RecordBatch]:
            """The rows of a block, and behind them its pairs."""
            nonlocal block, size, pair, n, waiting, rows, ids
            pair, n = gathered(pair, n, waiting)
            for k in range(0, len(rows), 1000):
                part = rows[k : k + 1000]
                links = []
                for _, _, own, times in part:
                    at = np.searchsorted(pair, own).astype(np.uint32)
                    links.append(squeeze(np.concatenate([np.diff(at, prepend=np.uint32(0)), times]).astype(np.uint32).tobytes()))
                counts = np.array([r[0] for r in part], np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), first + block)), pa.array(np.zeros(len(part), bool)), ids_of(k, len(part)), *map(pa.array, counts),
                        pa.array([r[1] for r in part], pa.string()), pa.array(links, pa.binary()),
                    ],
                    names=names,
                )
            if len(pair):
                both = np.stack([pair.view(np.int64), n]).tobytes()
                none = pa.nulls(1, ids[0].type)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first + block]), pa.array([True]), none, *(pa.array([0]) for _ in COUNTS), pa.array([""]), pa.array([both], pa.binary())], names=names
                )
            block, size, pair, n, waiting, rows, ids = block + 1, 0, pair[:0], n[:0], [], [], []

        def ids_of(k: int, count: int) -> pa.Array:
            joined = pa.concat_arrays(ids) if len(ids) > 1 else ids[0]
            ids[:] = [joined]
            return joined.slice(k, count)

        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for parts in one.align(texts):
                if not parts:
                    rows.append(((0, 0, 0, 0), "", pair[:0], np.empty(0, np.int64)))
                    continue
                shown, n_a, n_b, n_groups, packed = zip(*parts, strict=True)
                links = np.frombuffer(b"".join(packed), np.uint64)
                own, times = np.unique(links, return_counts=True)
                whole = ";".join(shown)
                rows.append(((sum(n_a), sum(n_b), sum(n_groups), len(links)), digest(whole) if digests else whole, own, times))
                waiting.append(own)
            ids.append(batch.column(0))
            size += batch.get_total_buffer_size() if batch.num_rows == 1 else sum(map(len, texts))
            if sum(map(len, waiting)) > 1 << 20:
                pair, n = gathered(pair, n, waiting)
                waiting = []
            if size >= block_bytes:
                yield from close()
                release()
        if rows:
            yield from close()
        release()

    names = ["block", "summary", "doc_id", *COUNTS, "groups", "links"]
    counts = ", ".join(f"{c} long" for c in COUNTS)
    written = stored(docs.select(doc_type["doc_id"], "text").mapInArrow(run, f"block long, summary boolean, doc_id {kind}, {counts}, groups string, links binary"))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, both in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pair, n = np.frombuffer(both, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block)), pa.array(pair), pa.array(n)], names=["block", "pair", "n"])

    def look_up(key: tuple, rows: pa.Table, counted: pa.Table) -> pa.Table:
        order = np.argsort(counted.column("pair").to_numpy())
        total, best = (counted.column(c).to_numpy()[order] for c in ("total", "best"))
        expand = zstandard.ZstdDecompressor().decompress
        n_best, count_sum = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
        for r, small in enumerate(rows.column("links")):
            at, times = np.frombuffer(expand(small.as_py()), np.uint32).reshape(2, -1)
            at, times = np.cumsum(at, dtype=np.int64), times.astype(np.int64)
            n_best[r], count_sum[r] = best[at] @ times, total[at] @ times
        return pa.table([rows.column("doc_id"), *(rows.column(c) for c in COUNTS), n_best, count_sum, rows.column("groups")], names=["doc_id", *COUNTS, "n_best", "count_sum", "groups"])

    mine = written.where("summary").select("block", "links").mapInArrow(unfold, "block long, pair long, n long")
    totals = stored(mine.groupBy("pair").agg(F.sum("n").alias("total")))
    a_id = F.shiftright("pair", 32).alias("a_id")
    highest = totals.groupBy(a_id).agg(F.max("total").alias("highest"))  # a row for each id of side a at most
    marked = totals.select("*", a_id).join(F.broadcast(highest), "a_id").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    small = totals.count() <= BROADCAST_ROWS
    counted = mine.select("block", "pair").join(F.broadcast(marked) if small else marked, "pair")
    texts = written.where("not summary").drop("summary")
    return texts.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(look_up, f"doc_id {kind}, {counts}, n_best long, count_sum long, groups string")


def digest(groups: str) -> str:
    """The digest of a row's groups; an empty string stays."""
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""
