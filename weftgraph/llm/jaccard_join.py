"""Operator 2: self-join of texts on the Jaccard similarity of their word shingles, by chosen paths.

Texts with equal shingle sets are one set. Each set gets a MinHash sketch, and a run
splits the sets recursively: a bucket chooses coordinates of the sketch at random
(1/threshold of them on average, so that a pair at the threshold is expected to share
one child), and sets with the same value there go to the same child. Small buckets are
brute-forced on the sketches; runs are repeated until a pair at the threshold is found
with the wanted recall. Sets tied together this way are then compared exactly, each
pair once, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import joined, mix, word_hashes
from .common import checkpoint, slices
from .components import components

COORDINATES = 128
SLICE_BYTES = 1 << 20
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _SHIFTS = _SEEDS[:COORDINATES] | np.uint64(1), _SEEDS[COORDINATES:]


def shingle_sets(data: np.ndarray, rows: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, sorted; a row of fewer words than width is one shingle."""
    words, row = word_hashes(data, rows)
    starts = np.searchsorted(row, np.arange(len(rows)))
    place = np.uint64(0x9E3779B97F4A7C15)
    n = max(0, len(words) - width + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = total * place + words[k : k + n]
    total = mix(total)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            short = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    short = short * place + w
            out.append(mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit name for a set, as a signed number."""
    plain = shingles.sum(dtype=np.uint64, keepdims=True)
    mixed = mix(shingles ^ np.uint64(len(shingles))).sum(dtype=np.uint64, keepdims=True)
    return int(mix(plain + mixed)[0].view(np.int64))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets, a row each."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(((flat ^ _SHIFTS[k]) * _FACTORS[k]) >> np.uint64(32), starts)
    return out


def survival(threshold: float, depth: int, alike: float | None = None) -> float:
    """Probability that a pair that agrees in a share of its coordinates (the threshold) shares a bucket of this depth in one run."""
    most = 1 / threshold
    low, share = math.floor(most), most - math.floor(most)
    p = 1.0
    for _ in range(depth):
        miss = 1 - (threshold if alike is None else alike) * p
        p = 1 - ((1 - share) * miss**low + share * miss ** (low + 1))
    return p


def runs_needed(threshold: float, depth: int, recall: float) -> int:
    """How many runs find a pair at the threshold with this probability.

    All runs draw from the same coordinates, of which a pair at the threshold has equal a
    binomial number: the chance to miss it in every run is averaged over that number.
    """
    missed = [1 - survival(threshold, depth, k / COORDINATES) for k in range(COORDINATES + 1)]
    weight = [math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in range(COORDINATES + 1)]
    runs = 1
    while sum(w * m**runs for w, m in zip(weight, missed, strict=True)) > 1 - recall:
        runs += 1
    return runs


def children(paths: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Child buckets of rows in buckets: (row, path). The choice of coordinates depends on the bucket alone."""
    most = 1 / threshold
    low, share = math.floor(most), most - math.floor(most)
    rows, out = [], []
    for k in range(low + 1):
        chosen = (mix(paths + np.uint64(2 * k + 1)) % np.uint64(COORDINATES)).astype(np.int64)
        at = np.arange(len(paths))
        if k == low:
            at = at[mix(paths + np.uint64(2 * k + 2)) < np.uint64(int(share * 2**64))]
        value = sketches[at, chosen[at]].astype(np.uint64) | (chosen[at].astype(np.uint64) << np.uint64(32))
        rows.append(at)
        out.append(mix(paths[at] ^ mix(value + np.uint64(k << 48))))
    return np.concatenate(rows), np.concatenate(out)


def _column(batch: pa.RecordBatch, k: int, kind: type) -> np.ndarray:
    return np.asarray(batch.column(k)).view(kind)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and links between them, the least node of each one's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def bucket_links(cutoff: float):
    """Links between sets of a bucket that look alike: each set to the least one it is tied to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None

        def links(batch: pa.RecordBatch) -> pa.RecordBatch:
            path, ids = _column(batch, 0, np.int64), _column(batch, 1, np.int64)
            short = _matrix(batch.column(2), np.uint8)
            a, b = [], []
            at = np.arange(len(path))
            for gap in range(1, len(path)):
                at = at[at + gap < len(path)]
                at = at[path[at] == path[at + gap]]
                if not len(at):
                    break
                alike = at[(short[at] == short[at + gap]).mean(axis=1) >= cutoff]
                a.append(alike)
                b.append(alike + gap)
            if not a:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
            a, b = np.concatenate(a), np.concatenate(b)
            root = least_linked(a, b, len(path))
            moved = np.flatnonzero(root != np.arange(len(path)))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])

        for batch in batches:
            if rest is not None and rest.num_rows:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            path = _column(batch, 0, np.int64)
            cut = int(np.flatnonzero(path != path[-1])[-1]) + 1 if (path != path[-1]).any() else 0
            rest = batch.slice(cut)  # the last bucket may go on in the next batch
            if cut:
                yield links(batch.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield links(rest)

    return run


def block_links(threshold: float):
    """Exact links of the sets of one task: (node, links counted with copies, root of the tie within the task)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        root = table.column("root").to_numpy()
        block, ids, copies = (table.column(c).to_numpy() for c in ("block", "set_id", "copies"))
        raw = table.column("shingles").to_pylist()
        nodes, counts, ties = [], [], []
        order = np.argsort(root, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            part = part[np.unique(ids[part], return_index=True)[1]]
            if len(part) < 2:
                continue
            sets = [np.frombuffer(raw[k], dtype=np.uint64) for k in part]
            sizes = np.array([len(s) for s in sets])
            values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(part)), sizes)
            useful = np.cumsum(times > 1) - 1
            shared = times[where] > 1
            owner, column = owner[shared], useful[where[shared]]
            inter = np.zeros((len(part), len(part)), dtype=np.float64)
            step = max(64, (1 << 22) // len(part))
            by = np.argsort(column, kind="stable")
            owner, column = owner[by], column[by]
            for first in range(0, int((times > 1).sum()), step):
                a, b = np.searchsorted(column, [first, first + step])
                m = np.zeros((len(part), step), dtype=np.float32)
                m[owner[a:b], column[a:b] - first] = 1
                inter += m @ m.T
            union = sizes[:, None] + sizes[None, :] - inter
            linked = inter >= threshold * union - 1e-9
            np.fill_diagonal(linked, False)
            if i != j:  # pairs within a block are another task's
                linked &= block[part][:, None] != block[part][None, :]
            a, b = np.nonzero(np.triu(linked))
            tied = least_linked(a, b, len(part))
            n = (linked * copies[part][None, :]).sum(axis=1)
            some = np.flatnonzero(n)
            nodes.append(ids[part][some])
            counts.append(n[some])
            ties.append(ids[part][tied[some]])
        joined_up = [np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (nodes, counts, ties)]
        return pa.table(dict(zip(("node", "links", "tie"), map(pa.array, joined_up), strict=True)))

    return run


def link(
    docs: DataFrame, *, threshold: float = 0.8, width: int = 5, recall: float = 0.9999,
    bucket: int = 64, depth: int = 3, block_rows: int = 512, block_shingles: int = 400_000,
) -> DataFrame:
    """Classes of similar texts: (doc_id, class_id, n_links, class_key, text_key), a row for each row of docs.

    Two rows are linked if the Jaccard similarity of their sets of width-word shingles
    is at least threshold (rows with equal sets always). n_links counts a row's links;
    class_id is the least doc_id of all rows tied to it by links, its own if there are
    none. Words are lower-cased runs of ASCII letters, digits and characters beyond
    ASCII; class_key names the class also where ids repeat, text_key is xxhash64 of the
    text, to tell rows of one id apart. Fewer than width words are one shingle; a text without words (null, empty)
    links to nothing and has no class_key. No links are dropped and no bucket is capped: one larger than
    bucket is split further, and at the greatest depth its sets are tied as they are;
    the exact comparison runs over blocks of every tie. Only doc_id and text are read.
    """
    doc_kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                sets = shingle_sets(*joined(batch.column(1)), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                ids: list[int | None] = [None] * len(sets)
                sketches: list[bytes | None] = [None] * len(sets)
                shorts: list[bytes | None] = [None] * len(sets)
                if full:
                    values = sketch([sets[i] for i in full])
                    for i, row in zip(full, values, strict=True):
                        ids[i], sketches[i], shorts[i] = set_id(sets[i]), row.tobytes(), row.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(2), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(sketches, pa.binary()), pa.array(shorts, pa.binary()),
                    ],
                    names=["doc_id", "text_key", "set_id", "size", "sketch", "short"],
                )

    described = checkpoint(
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
            describe, f"doc_id {doc_kind}, text_key long, set_id long, size int, sketch binary, short binary"
        )
    )
    sets = checkpoint(
        described.where("set_id is not null").groupBy("set_id").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.first("size").alias("size"),
            F.first("sketch").alias("sketch"), F.first("short").alias("short"),
        )
    )
    runs = runs_needed(threshold, depth, recall)
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0).to_numpy(), _matrix(batch.column(1), np.uint32) if batch.num_rows else None
            for root in roots if batch.num_rows else ():
                row, path = children(np.full(len(ids), root), values, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[row])], names=["path", "set_id"])

    def next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(1).to_numpy()
                row, path = children(_column(batch, 0, np.uint64), _matrix(batch.column(2), np.uint32), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[row])], names=["path", "set_id"])

    level_kind = "path long, set_id long"
    level = sets.select("set_id", "sketch").mapInArrow(first_level, level_kind)
    leaves: list[DataFrame] = []
    for at in range(1, depth + 1):
        level = checkpoint(level)
        counts = level.groupBy("path").agg(F.count("*").alias("n"), F.min("set_id").alias("least")).where("n > 1")
        counted = level.join(counts, "path")
        leaves.append(counted.where(F.col("n") <= bucket).select("path", "set_id"))
        large = counted.where(F.col("n") > bucket)
        level = large.join(sets.select("set_id", "sketch"), "set_id").select("path", "set_id", "sketch").mapInArrow(next_level, level_kind)
    crowded = large.select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    small = leaves[0]
    for leaf in leaves[1:]:
        small = small.unionByName(leaf)
    look_alikes = (
        small.join(sets.select("set_id", "short"), "set_id")
        .select("path", "set_id", "short")
        .repartition("path")
        .sortWithinPartitions("path")
        .mapInArrow(bucket_links(threshold - 4 * math.sqrt(threshold * (1 - threshold) / COORDINATES)), "a long, b long")
    )
    tied = look_alikes.unionByName(crowded)
    clusters = checkpoint(components(tied))

    members = clusters.join(sets.select("set_id", "copies", "first", "size"), clusters["node"] == sets["set_id"]).drop("node")
    blocks = members.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") / block_shingles)).cast("int").alias("n_blocks")
    )
    groups = max(16, clusters.count() // 1000)
    members = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("n_blocks")).cast("int"))

    def shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, SLICE_BYTES):
                sets_here = shingle_sets(*joined(batch.column(0)), width)
                expected = batch.column(2).to_numpy()
                right = [i for i, s in enumerate(sets_here) if len(s) and set_id(s) == expected[i]]
                taken = pa.array(right, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(taken) for k in range(1, 6)), pa.array([sets_here[i].tobytes() for i in right], pa.binary())],
                    names=["root", "set_id", "copies", "n_blocks", "block", "shingles"],
                )

    with_sets = (
        docs.select("doc_id", "text").join(members, F.col("doc_id").eqNullSafe(F.col("first")))
        .select("text", "root", "set_id", "copies", "n_blocks", "block")
        .mapInArrow(shingles_of, "root long, set_id long, copies long, n_blocks int, block int, shingles binary")
    )
    b, other = F.col("block"), F.col("other")
    tasks = with_sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.col("root")).alias("g"),
        F.least(b, other).alias("i"), F.greatest(b, other).alias("j"), "root", "block", "set_id", "copies", "shingles",
    )
    verified = checkpoint(tasks.groupBy("g", "i", "j").applyInArrow(block_links(threshold), "node long, links long, tie long"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("tie").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = sets.select("set_id", "copies", "first").join(classes, F.col("set_id") == F.col("node"), "left").drop("node")
    known = known.withColumn("root", F.coalesce("root", "set_id"))
    named = known.groupBy("root").agg(F.min("first").alias("class_first"))
    info = (
        known.join(named, "root").join(links, F.col("set_id") == F.col("node"), "left")
        .select("set_id", "root", "class_first", F.coalesce("links", F.lit(0)).alias("links"), "copies")
    )
    return described.select("doc_id", "set_id", "text_key").join(info, "set_id", "left").select(
        "doc_id",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_first")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.col("root").alias("class_key"),
        "text_key",
    )
