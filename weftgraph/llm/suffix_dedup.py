"""Operator 6: removal of byte strings that occur more than once.

Strings are found by merging Burrows-Wheeler transforms of shards (interleave.py). All
suffixes of the corpus would each be touched once for every byte of context, so a sound
prefilter comes first, which sets aside what can be settled by equal blocks alone:

An anchor is the 32-byte run with the least hash among all runs in a window of the
wanted length. Two equal windows choose the same anchor, so each window can be settled
among those of its anchor's run.

1. Runs that occur once: their windows do too.
2. Blocks, the text of all windows that chose an anchor, by hash. Equal blocks: all
   their windows occur more than once.
3. The different blocks of a run in two halves: a window reaches at least `context`
   bytes beyond the run to its left or to its right. A half whose run with these bytes
   occurs once is out.
4. The bytes of the remaining halves are dealt to groups by run and context. In a group
   they make up shards, whose transforms are merged; intervals that share the wanted
   length are the windows that occur more than once.

Runs, contexts and blocks are compared by 64-bit hashes (contexts by 32 bits of one, as
they only set aside), the windows of step 4 by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import RollingHash, joined, mix
from .common import carried, carried_kind, release, slices, stored
from .interleave import repeated_windows

RUN = 32
SLICE_BYTES = 256 << 10
HALVES_PER_GROUP = 2000
HOT_ROWS = 10_000  # a key with more rows is split ...
HOT_KEYS = 2000  # ... if it is among the at most so many largest


def anchors(data: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of length bytes: (row, first window, last window, anchor, run, block, left, right).

    Places are numbered within their row; each window belongs to the one anchor of its
    least run hash (the leftmost of equals). run, block, left and right are hashes of the
    run, the block, and the run with the context to its left or right (0 beyond the block).
    """
    width = length - RUN + 1
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int32, np.int32)
    none = tuple(np.empty(0, t) for t in kinds)
    sizes = np.diff(rows)
    long = sizes >= length
    if not long.any():
        return none
    rolling = RollingHash(data)
    grams = rolling.grams(RUN)
    n = len(grams)
    bits = np.uint64(max(1, n.bit_length()))
    # Least hash, then least place: the hash's upper bits before the place. Equal windows have equal runs, so they agree.
    keyed = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    keyed[:n] = ((grams >> bits) << bits) | np.arange(n, dtype=np.uint64)
    blocks = keyed.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    last = len(data) - length + 1
    at = (np.minimum(behind[:last], ahead[width - 1 : width - 1 + last]) & np.uint64((1 << int(bits)) - 1)).astype(np.int32)
    del keyed, blocks, ahead, behind
    valid = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(valid, rows[:-1][long], 1)
    np.add.at(valid, rows[1:][long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(valid, dtype=np.int8)[:last])
    at = at[window]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(window, prepend=-2) != 1))
    first, final = window[new], window[np.append(new[1:], len(window)) - 1]
    at = at[new].astype(np.int64)
    row = np.searchsorted(rows, first, side="right") - 1
    inside = mix((at - first).astype(np.uint64) + np.uint64(1))
    context = context_of(length)
    left, right = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
    to_left, to_right = at - first >= context, final > at - context
    left[to_left] = rolling.ranges(at[to_left] - context, at[to_left] + RUN).astype(np.int32)
    right[to_right] = rolling.ranges(at[to_right], at[to_right] + length - context + 1).astype(np.int32)
    block = mix(rolling.ranges(first, final + length) ^ inside)
    return row, first - rows[row], final - rows[row], at - rows[row], grams[at], block, left, right


def context_of(length: int) -> int:
    """How far a window reaches beyond its run on one side at least: windows that begin so far before it are its left half."""
    return (length - RUN) // 2


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def split_hot(rows: DataFrame, counted: DataFrame, key: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key is in counted (key, n): a semi-join in which keys with very many rows are dealt to shares.

    As a left join it returns all rows, marked by n (2, else null). Keys above HOT_ROWS and
    above the HOT_KEYS-th part of all rows are at most HOT_KEYS, so their list is broadcast.
    """
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share_rows = max(HOT_ROWS, total // HOT_KEYS)
    hot = counted.where(F.col("n") > share_rows).select(*key, F.ceil(F.col("n") / share_rows).cast("int").alias("_shares"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_share", F.when(F.col("_shares").isNotNull(), F.pmod(F.hash("_h1", "first"), F.col("_shares"))).otherwise(0)
    )
    shares = F.when(F.col("n") > share_rows, F.ceil(F.col("n") / share_rows).cast("int")).otherwise(1)
    wanted = counted.select(*key, F.explode(F.sequence(F.lit(0), shares - 1)).alias("_share"))
    if how == "left":
        wanted = wanted.withColumn("n", F.lit(2))
    return dealt.join(wanted, [*key, "_share"], how).drop("_share", "_shares")


def repeated_spans(keyed: DataFrame, length: int) -> DataFrame:
    """Windows that occur more than once: (_h1, _h2, spans) with runs of first bytes, one row for each text that has any."""
    context = context_of(length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                row, first, last, at, run, block, left, right = anchors(*joined(batch.column(1)), length)
                where = pa.array(row)
                narrow = [pa.array(x.astype(np.int32)) for x in (first, last, at)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).take(where), batch.column(3).take(where), *narrow, signed(run), signed(block), pa.array(left), pa.array(right)],
                    names=["_h1", "_h2", "first", "last", "at", "run", "block", "left", "right"],
                )
            release()

    found = keyed.mapInArrow(find, "_h1 long, _h2 int, first int, last int, at int, run long, block long, left int, right int")
    intervals = stored(found.groupBy("run").agg(F.count("*").alias("n")).where("n > 1"))
    shared = stored(split_hot(found, intervals, ["run"]))
    # Equal blocks are marked. The marked anchors are repeated whole; the others, with one for all equal ones, go on.
    place = ["_h1", "_h2", "first", "last", "at", "left", "right"]
    several = stored(shared.groupBy("run", "block").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("one")).where("n > 1"))
    marked = stored(split_hot(shared, several.select("run", "block", "n"), ["run", "block"], "left"))
    span = F.struct("first", "last")
    wholes = marked.where("n is not null").select("_h1", "_h2", span.alias("span"))
    members = marked.where("n is null").select("run", F.lit(False).alias("several"), *place).unionByName(
        several.select("run", F.lit(True).alias("several"), "one.*")
    )

    # The halves of blocks that differ: windows that begin at least `context` before the anchor, and the others.
    mixed = members.groupBy("run").agg(F.count("*").alias("blocks")).where("blocks > 1").select("run")
    near = F.col("at") - context
    halves = F.array(
        F.when(F.col("first") <= near, F.struct(F.lit(0).alias("side"), F.col("left").alias("context"), F.col("first").alias("from"), F.least("last", near).alias("to"))),
        F.when(F.col("last") > near, F.struct(F.lit(1).alias("side"), F.col("right").alias("context"), F.greatest("first", near + 1).alias("from"), F.col("last").alias("to"))),
    )
    cut_up = (
        members.join(mixed, "run", "left_semi")
        .select("run", "several", "_h1", "_h2", F.explode(F.array_compact(halves)).alias("h")).select("run", "several", "_h1", "_h2", "h.*")
    )
    key = ["run", "side", "context"]
    alike = cut_up.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    candidates = stored(cut_up.join(alike, key).select("_h1", "_h2", "several", "from", "to", "n", F.xxhash64(*key).alias("key")))
    n_groups = max(1, candidates.count() // HALVES_PER_GROUP)
    # A key of very many halves is dealt to shares; what a share finds once is compared across shares by hash.
    shares = F.ceil(F.col("n") / (4 * HALVES_PER_GROUP)).cast("int")
    asked = (
        candidates.withColumn("shares", shares)
        .withColumn("group", F.when(F.col("shares") > 1, F.col("key")).otherwise(F.pmod("key", F.lit(n_groups))))
        .withColumn("share", F.when(F.col("shares") > 1, 1 + F.pmod(F.hash("_h1", "from"), "shares")).otherwise(0))
        .groupBy("_h1", "_h2").agg(F.collect_list(F.struct("from", "to", "several", "group", "share", "key")).alias("halves"))
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the halves asked for."""
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                out = []
                for i, (text, halves) in enumerate(zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                    out += [(i, h["group"], h["share"], h["from"], h["several"], h["key"], text[h["from"] : h["to"] + length]) for h in halves]
                where, *columns = zip(*out, strict=True)
                where = pa.array(where, pa.int64())
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).take(where), batch.column(3).take(where), *map(pa.array, columns, kinds)],
                    names=["_h1", "_h2", "group", "share", "first", "several", "key", "bytes"],
                )
            release()

    def settle(key: tuple, rows: pa.Table) -> pa.Table:
        """Runs of windows that another half of the group has too; in a share also each other window by its hash."""
        rows = rows.combine_chunks().sort_by("key")  # halves that may be alike beside each other: they go to different shards
        texts = rows.column("bytes").to_pylist()
        first, several = rows.column("first").to_pylist(), rows.column("several").to_pylist()
        owner, start, end, names = [], [], [], []
        for i, hit in enumerate(repeated_windows(texts, length)):
            n = len(texts[i]) - length + 1
            if key[1].as_py():  # a share: every window may have its like in another one
                hashes = RollingHash(np.frombuffer(texts[i], dtype=np.uint8)).ranges(np.arange(n), np.arange(n) + length).view(np.int64)
                owner += [i] * n
                start += range(first[i], first[i] + n)
                end += range(first[i], first[i] + n)
                names += hashes.tolist()
            if len(hit) and not several[i]:
                new = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
                final = np.append(new[1:], len(hit)) - 1
                owner += [i] * len(new)
                start += (hit[new] + first[i]).tolist()
                end += (hit[final] + first[i]).tolist()
                names += [None] * len(new)
        release()  # the transforms are gone
        taken = pa.array(owner, pa.int64())
        return pa.table(
            {
                "_h1": rows.column("_h1").take(taken), "_h2": rows.column("_h2").take(taken),
                "first": pa.array(start, pa.int32()), "last": pa.array(end, pa.int32()),
                "name": pa.array(names, pa.int64()), "share": pa.array([key[1].as_py()] * len(owner), pa.int32()),
            }
        )

    settled = stored(
        keyed.join(asked, ["_h1", "_h2"])
        .select("doc_id", "text", "_h1", "_h2", "halves")
        .mapInArrow(pieces, "_h1 long, _h2 int, group long, share int, first int, several boolean, key long, bytes binary")
        .groupBy("group", "share")
        .applyInArrow(settle, "_h1 long, _h2 int, first int, last int, name long, share int")
    )
    # Shares: one row stands for each share's equal windows, so even a frequent window has few.
    across = settled.where("name is not null").select("name", "share").distinct().groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    late = split_hot(settled.where("name is not null"), across, ["name"]).select("_h1", "_h2", span.alias("span"))
    singles = settled.where("name is null").select("_h1", "_h2", span.alias("span")).unionByName(late)
    return wholes.unionByName(singles).groupBy("_h1", "_h2").agg(F.collect_list("span").alias("spans"))


def merged(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by windows, as maximal runs."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["last"] + length) for s in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def remove_repeats(docs: DataFrame, *, length: int = 200, carry: list[str] | None = None) -> DataFrame:
    """Cuts from every row each byte that lies in a string of length bytes occurring anywhere else too.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes: start,
    end), kept (the remaining bytes; a cut may split a character), and a struct of the
    columns to carry, named row. Texts are UTF-8
    bytes, null is empty; matches lie within one text each, overlapping ones count,
    and repeated rows are repeats of each other, an empty table gives an empty one. One
    row out for each row in; only doc_id and text are read. A task holds a slice of
    256 KB of text, or one longer text, and some hundred bytes for each of its bytes.
    """
    if length < 2 * RUN:
        raise ValueError(f"length must be at least {2 * RUN}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = (F.xxhash64("doc_id", "text").alias("_h1"), F.hash("text", "doc_id").alias("_h2"))
    keyed = docs.select("doc_id", "text", *keys, *carried(docs, carry))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            sizes, removed, runs, kept = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8")
                out = merged(spans or [], length)
                edges = [0, *(x for run in out for x in run), len(data)]
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in out))
                runs.append([{"start": a, "end": b} for a, b in out])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(runs, span_type), pa.array(kept, pa.binary()), *batch.columns[3:],
                ],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept", *batch.schema.names[3:]],
            )

    spans = repeated_spans(keyed.select("doc_id", "text", "_h1", "_h2"), length)
    cut_from = keyed.join(spans, ["_h1", "_h2"], "left").select("doc_id", "text", "spans", *keyed.columns[4:])
    return cut_from.mapInArrow(
        cut,
        f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary" + carried_kind(cut_from),
    )
