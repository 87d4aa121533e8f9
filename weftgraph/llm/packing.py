"""Operator 8: packing documents into sequences of fixed capacity.

Lengths are integers up to the capacity, so an instance is a histogram of bounded
size. Martello-Toth dominance fixes document sets that no alternative can beat and
shrinks the histogram; best fit decreasing packs the remainder, many equal sequences
at a time. What comes out is a bounded list of sequence patterns; each document finds
its place in them by its rank among the documents of its length.
"""

from __future__ import annotations

import json
import os
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, slices, texts

SLICE_BYTES = 1 << 20
REMEMBERED = 100_000  # stretches a generation
MARK = "\x1f"  # ends a word; no text that is split here has it

# How the vocabulary file splits lower-cased text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


BYTE_LETTERS = _byte_letters()


@dataclass
class Pattern:
    """So many equal sequences, each filled with (length, copies) in this order."""

    sequences: int
    filling: list[tuple[int, int]] = field(default_factory=list)


def reduce_by_dominance(counts: list[int], capacity: int) -> list[Pattern]:
    """Fixes sets that dominate every other set with the same document; lowers counts accordingly.

    A set dominates another if the other's documents can be put, several in one place
    too, into the places its own leave. Every length is tried, from the longest on; one
    that can't be settled is passed over.

    * A document that fills a sequence, or that even the shortest other one overfills, is alone.
    * Two documents that fill a sequence exactly: whatever else could stand beside the one
      fits into the other's place.
    * If at most one other document fits beside it, the longest that fits is best.
    * If at most two fit, so are the longest that fits and the longest beside these two,
      unless two documents longer than the latter fit together.
    """
    fixed: list[Pattern] = []
    present = [x for x in range(1, capacity + 1) if counts[x]]

    def fix(sequences: int, *lengths: int) -> None:
        if sequences:
            filling = [(x, lengths.count(x)) for x in dict.fromkeys(lengths)]
            fixed.append(Pattern(sequences, filling))
            for x in lengths:
                counts[x] -= sequences
            for x in dict.fromkeys(lengths):
                if not counts[x]:
                    present.pop(bisect_left(present, x))

    def least(n: int, above: int = 0) -> list[int]:
        """The n least lengths above one, repeated as often as they occur."""
        out: list[int] = []
        for x in present[bisect_right(present, above) :]:
            out += [x] * min(counts[x], n - len(out))
            if len(out) == n:
                break
        return out

    def longest(room: int) -> int:
        i = bisect_right(present, room)
        return present[i - 1] if i else 0

    if counts[capacity]:
        fix(counts[capacity], capacity)
    for x in range(capacity - 1, (capacity - 1) // 2, -1):
        y = capacity - x
        fix(counts[x] // 2 if x == y else min(counts[x], counts[y]), x, y)
    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            room = capacity - length
            counts[length] -= 1  # the others
            if not counts[length]:
                present.pop(bisect_left(present, length))
            few, one = least(3), longest(room)
            two = 0
            if one:
                counts[one] -= 1
                two = longest(room - one) if counts[one] else max((x for x in present[: bisect_right(present, room - one)] if x != one), default=0)
                counts[one] += 1
            pair_above = least(2, two) if two else []
            if not counts[length]:
                present.insert(bisect_left(present, length), length)
            counts[length] += 1
            if not one:
                fix(counts[length], length)
            elif len(few) < 2 or few[0] + few[1] > room or one == room:
                fix(counts[length] // 2 if one == length else min(counts[length], counts[one]), length, one)
            elif two and (len(few) < 3 or few[0] + few[1] + few[2] > room) and (len(pair_above) < 2 or sum(pair_above) > room):
                # Each such triple leaves the conditions true: what is least can only rise, and the longest are still there.
                wanted = Counter((length, one, two))
                fix(min(counts[x] // n for x, n in wanted.items()), length, one, two)
            else:
                break
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[Pattern]:
    """Best fit decreasing over a histogram; sequences that look alike are filled together."""
    open_by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, room: int) -> None:
        if pattern.sequences:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append(pattern)

    for length in range(capacity, 0, -1):
        left = counts[length]
        counts[length] = 0
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                put(Pattern(max(1, left // (capacity // length))), capacity)
                continue
            room = rooms[i]
            pattern = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(i)
            copies = min(room // length, left)
            filled = min(pattern.sequences, left // copies)
            put(Pattern(pattern.sequences - filled, list(pattern.filling)), room)
            left -= filled * copies
            pattern.sequences = filled
            pattern.filling.append((length, copies))
            put(pattern, room - copies * length)
    return [p for several in open_by_room.values() for p in several if p.filling]


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every document of the histogram; their number depends on the capacity, not on the documents."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    return reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Ids by the bytes of tokens, with MARK for the end of a word; None unless merging by least id gives what the file's merges give.

    That is so if ids are in the order of the merges, and each token's own bytes are merged to it alone:
    two neighbours that make up a token by another merge than its own would then be met in it too.
    """
    import tokenizers

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    byte_of = {chr(BYTE_LETTERS.get(b, b)): b for b in range(256)}
    letters = [x + end for end in ("", suffix) for x in byte_of]
    if sorted(vocabulary, key=vocabulary.get) != [*sorted(letters, key=lambda x: vocabulary.get(x, -1)), *(a + b for a, b in pairs)]:
        return None
    inner = tokenizers.models.BPE(vocabulary, pairs).tokenize
    whole = tokenizers.models.BPE(vocabulary, pairs, end_of_word_suffix=suffix).tokenize
    ranks = {}
    for token, i in vocabulary.items():
        ends = token.endswith(suffix)
        plain = token.removesuffix(suffix)
        if [t.id for t in (whole if ends else inner)(plain)] != [i]:
            return None
        ranks[bytes(byte_of[x] for x in plain) + MARK.encode() * ends] = i
    return ranks


class Tokenizer:
    """Ids of texts by a tokenizer file.

    No match of the vocabulary's pattern spans white space, so texts are split there and
    each distinct stretch is encoded once, as long as it is remembered: those not seen
    for a generation of `remembered` new ones are forgotten. ranks are those of the file;
    without them all texts are left to the tokenizers library.
    """

    def __init__(self, path: str, end: int, ranks: dict[bytes, int] | None, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        import tiktoken
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        # Added tokens in a text are tokens, as by the library's defaults; such texts are left to it.
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.match, self.remembered = regex.compile(WORDS), remembered
        self.end = array("I", [end]).tobytes()
        # Below U+0250 (without the dotted capital I, and the separators that only Python's split takes for
        # white space, MARK among them) text is in normal form, and lower() maps letter by letter.
        self.plain = regex.compile("[\u0000-\u001b\u0020-\u012f\u0131-\u024f]*" if ranks else "(?!)")
        self.merges = tiktoken.Encoding("words", pat_str=f"[^ {MARK}]+{MARK}| ", mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.space = ranks[b" "] if ranks else 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, stretches: list[str]) -> None:
        """Encodes new stretches, all in one text: each word ends in MARK, each stretch in a space, which is a token by itself."""
        marked = self.match.sub(rf"\g<0>{MARK}", " ".join(stretches)) + " "
        ids = self.merges.encode_to_numpy(marked)
        data, at = ids.astype("<u4").tobytes(), 0
        for s, to in zip(stretches, (4 * np.flatnonzero(ids == self.space)).tolist(), strict=True):
            self.young[s] = data[at:to]
            at = to + 4

    def encode(self, several: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of texts, the end id last."""
        split = []
        for t in several:
            low = t.lower() if self.plain.fullmatch(t) else None
            split.append(None if low is None or any(a in low for a in self.added) else low.split())
        asked = set().union(*(s for s in split if s)).difference(self.young)
        if asked:
            if len(self.young) > self.remembered:
                self.old, self.young = self.young, {}
                asked = set().union(*(s for s in split if s))
            new = asked.difference(self.old)
            self.young.update((w, self.old[w]) for w in asked.difference(new))
            if new:
                self.learn(list(new))
        get = self.young.__getitem__
        return [
            array("I", self.library.encode(t, add_special_tokens=False).ids).tobytes() + self.end
            if s is None
            else b"".join(map(get, s)) + self.end
            for t, s in zip(several, split, strict=True)
        ]


@lru_cache(maxsize=1)
def tokenizer_of(path: str, end: int) -> Tokenizer:
    """A file's tokenizer with the stretches it remembers, kept by a Python worker for its next task."""
    return Tokenizer(path, end, byte_ranks(path))


def tokenize(docs: DataFrame, path: str, *, end: int = 1, capacity: int = 4096) -> DataFrame:
    """Pieces of every row's token ids: (doc_id, piece, start, length, ids binary of little-endian 32-bit ids).

    A document is its text's ids and the end id (null and empty texts: the end id
    alone); only one longer than capacity is cut, into pieces of capacity and a rest.
    Added tokens of the vocabulary that a text spells out are tokens. Repeated rows give
    repeated pieces, an empty table none; only doc_id and text are read. A task holds a
    slice of about a megabyte of text, or one longer text with its ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path, end)
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            row, piece, ids = [], [], []
            for i, data in enumerate(tokenizer.encode(texts(batch.column(1)))):
                for k, a in enumerate(range(0, len(data), 4 * capacity)):
                    row.append(i)
                    piece.append(k)
                    ids.append(data[a : a + 4 * capacity])
            piece_at = np.array(piece, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece_at.astype(np.int32)), pa.array(piece_at * capacity),
                    pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, *, capacity: int = 4096, rows_per_task: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length from 1 to capacity.

    The columns sequence_id, offset and any named _size, _part, _rank or _first must not be
    there before. pieces is read three times, so it should be a checkpoint or a table. Ranks
    among equal lengths are taken in hash parts, so that a frequent length is no hot key; equal rows
    share a part in any order. An empty table gives an empty one.
    """
    columns = pieces.columns
    sized = pieces.withColumn("_size", F.col("length").cast("int"))
    bad = sized.where(f"not coalesce(_size between 1 and {capacity}, false)").limit(1).count()
    if bad:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    histogram = {r["_size"]: r["n"] for r in sized.groupBy("_size").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    parts = max(1, max(histogram.values(), default=0) // rows_per_task)
    # Places by length: ranks from..to stand in sequences from first on, copies in each, from offset on.
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for p in plan(histogram, capacity):
        at = 0
        for length, copies in p.filling:
            places.setdefault(length, []).append((taken.get(length, 0), sequence, copies, at))
            taken[length] = taken.get(length, 0) + p.sequences * copies
            at += length * copies
        sequence += p.sequences
    order = sorted((length, *place) for length, several in places.items() for place in several)
    size_key, rank_key, first_sequence, copies_of, offset_of = (np.array([o[k] for o in order], dtype=np.int64) for k in range(5))
    size_starts = np.searchsorted(size_key, np.arange(capacity + 2))

    parted = sized.withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int"))
    in_order = Window.partitionBy("_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        parted.groupBy("_size", "_part").agg(F.count("*").alias("n"))
        .select("_size", "_part", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("_first"))
    )
    sortable = [c for c, kind in pieces.dtypes if not kind.startswith("map")]
    ranked = (
        parted.withColumn("_rank", F.row_number().over(Window.partitionBy("_size", "_part").orderBy(*sortable)) - 1)
        .join(firsts, ["_size", "_part"])
        .select(*columns, "_size", (F.col("_rank") + F.col("_first")).cast("long").alias("_rank"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.asarray(batch.column(len(columns) + k), dtype=np.int64) for k in (0, 1))
            at = np.empty(len(size), dtype=np.int64)
            for s in np.unique(size):  # the last place that begins at or before the rank
                a, b = size_starts[s], size_starts[s + 1]
                mine = size == s
                at[mine] = a + np.searchsorted(rank_key[a:b], rank[mine], side="right") - 1
            within = rank - rank_key[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(columns)], pa.array(first_sequence[at] + within // copies_of[at]),
                    pa.array(offset_of[at] + within % copies_of[at] * size),
                ],
                names=[*columns, "sequence_id", "offset"],
            )

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)
