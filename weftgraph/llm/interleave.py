"""Burrows-Wheeler transforms of shards, merged by refining their interleave (numpy inside tasks).

A shard is some texts behind one another, each closed by a separator. Its suffixes are
sorted once, by themselves; its prefix array tells which strings repeat within it. The
shards are merged without sorting suffixes again: the interleave that orders suffixes
by their first h symbols gives, by one stable pass over the q symbols before them, the
one for h + q. Suffixes with equal first h symbols are an interval. One whose suffixes
are all of one shard needs no more refining; those of several shards that last for the
wanted number of symbols are repeated strings. Only rows that lead to a place where a
string of that length fits into its text take part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END, SEPARATOR = 0, 1  # symbols below those of bytes


@dataclass
class Transform:
    """The suffixes of a shard in order, the rank of each place, and by place whether its next `length` symbols repeat."""

    text: np.ndarray
    suffixes: np.ndarray
    rank: np.ndarray
    repeated: np.ndarray


def symbols_of(data: np.ndarray) -> np.ndarray:
    """For each byte value its symbol, from 2 on: 8 bits if the bytes in use leave room, as all of UTF-8 does."""
    used = np.bincount(data, minlength=256) > 0
    table = np.cumsum(used) + 1
    return table.astype(np.uint8 if used.sum() <= 254 else np.uint16)


def grams_of(text: np.ndarray, q: int) -> np.ndarray:
    """The q symbols from each place on (those beyond the end count as END), as one number in their order; q is 8 bytes at most."""
    bits = 8 * text.itemsize
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(q):
        out <<= np.uint64(bits)
        out[: max(0, len(text) - k)] |= text[k:]
    return out


def transform(text: np.ndarray, length: int) -> Transform:
    """Sorts the suffixes of a shard, whose last symbol is END, by doubling the sorted prefix; length is 64 at least.

    A rank is the number of suffixes with a lesser prefix; only suffixes that share theirs are sorted again.
    """
    n = len(text)
    reach = 8 // text.itemsize
    key = grams_of(text, reach)
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    ordered = key[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    known, at = rank.copy(), reach
    tied = np.flatnonzero(np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n))))  # places in order
    while len(tied):
        at_suffix = order[tied]
        ahead = np.where(at_suffix + reach < n, rank[np.minimum(at_suffix + reach, n - 1)] + 1, 0)
        key = rank[at_suffix] * (n + 1) + ahead
        by = np.argsort(key)
        order[tied], key = at_suffix[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        rank[order[tied]] = np.repeat(tied[starts], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        reach *= 2
        if reach <= length:
            known, at = rank.copy(), reach  # ranks by the longest prefix that isn't beyond length
    # Neighbours in order share `length` symbols if two known prefixes that cover these are equal.
    a, b = order[:-1], order[1:]
    repeated = np.zeros(n, dtype=bool)
    maybe = np.flatnonzero((known[a] == known[b]) & (np.maximum(a, b) + length <= n))
    a, b = a[maybe], b[maybe]
    same = known[a + length - at] == known[b + length - at]
    repeated[a[same]] = repeated[b[same]] = True
    return Transform(text, order, rank, repeated)


def merge(shards: list[Transform], ends: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each shard the places whose next `length` symbols occur in another shard too; ends are the places behind these."""
    if len(shards) < 2:
        return [np.empty(0, np.int64)] * len(shards)
    base = np.cumsum([0, *(len(s.text) for s in shards)])
    for q in (4, 2, 1):
        names, gram = np.unique(np.concatenate([grams_of(s.text, q) for s in shards]), return_inverse=True)
        if length % q == 0 and len(names) <= 1 << 16:
            break
    gram = gram.astype(np.uint16)
    # By row: the symbols before its suffix, and the row of the suffix that begins with these.
    back = [np.maximum(s.suffixes - q, 0) for s in shards]
    before = np.concatenate([gram[b + x] for x, b in zip(back, base, strict=False)])
    steps = np.concatenate([s.rank[x] + b for s, x, b in zip(shards, back, base, strict=False)]).astype(np.int32)
    shard = np.repeat(np.arange(len(shards), dtype=np.int32), np.diff(base))
    row = np.concatenate([np.sort(s.rank[e]) + b for s, e, b in zip(shards, ends, base, strict=False)]).astype(np.int32)
    interval = np.zeros(len(row), dtype=np.int32)
    for _ in range(length // q):
        if not len(row):
            break
        symbol = before[row]
        order = np.argsort(symbol, kind="stable")
        symbol, source = symbol[order], interval[order]
        row = steps[row[order]]
        new = np.empty(len(row), dtype=bool)
        new[0] = True
        new[1:] = (symbol[1:] != symbol[:-1]) | (source[1:] != source[:-1])
        starts = np.flatnonzero(new)
        of = shard[row]
        several = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
        interval = np.cumsum(new, dtype=np.int32) - 1
        keep = several[interval]
        row, interval = row[keep], interval[keep]
    return [s.suffixes[row[shard[row] == k] - base[k]] for k, s in enumerate(shards)]


def repeated_windows(texts: list[bytes], length: int, shard_bytes: int = 1 << 16) -> list[np.ndarray]:
    """For each text the places whose next `length` bytes, within it, also stand at another place of these texts."""
    if not texts:
        return []
    table = symbols_of(np.frombuffer(b"".join(texts), dtype=np.uint8))
    n_shards = max(1, -(-sum(map(len, texts)) // shard_bytes))
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    shards, begins, members, ends = [], [], [], []
    for k in range(n_shards):
        mine = list(range(k, len(texts), n_shards))  # neighbours, often copies, go to different shards
        if not mine:
            continue
        begin = np.cumsum([0, *(len(texts[i]) + 1 for i in mine)])
        joined = np.empty(begin[-1] + 1, dtype=table.dtype)
        for i, at in zip(mine, begin, strict=False):
            joined[at : at + len(texts[i])] = table[np.frombuffer(texts[i], dtype=np.uint8)]
        joined[begin[1:] - 1] = SEPARATOR
        joined[-1] = END
        shards.append(transform(joined, length))
        begins.append(begin)
        fits = [at + np.arange(length, len(texts[i]) + 1) for i, at in zip(mine, begin, strict=False)]
        ends.append(np.concatenate(fits))
        members.append(mine)
    for shard, across, begin, mine in zip(shards, merge(shards, ends, length), begins, members, strict=True):
        shard.repeated[across] = True
        for i, at in zip(mine, begin, strict=False):
            out[i] = np.flatnonzero(shard.repeated[at : at + max(0, len(texts[i]) - length + 1)])
    return out
