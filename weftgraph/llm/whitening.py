"""Operator 11: whitening of embeddings by a bidiagonal qd solver.

Centred rows are reduced to one triangle R by blockwise QR, within tasks and then in a
tree over them. R is small (dimensions by dimensions), so what follows is done once:
Householder reflections make it bidiagonal, dqds finds the singular values, to full
relative accuracy, and a twisted factorisation for each wanted one its vector. The
covariance is never formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT = 64, 1_000_000  # entry c becomes floor(64 c) + 1000000
FAN_IN = 4  # triangles that a task of the tree joins
BLOCK_ROWS = 4096
EPS = np.finfo(float).eps
TOLERANCE = (10 * EPS) ** 2
CLUSTER = 1e-3  # relative gap of singular values below which their vectors are made orthogonal together


def householder_bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of an upper bidiagonal B with the singular values of r, and V with r = U B V'."""
    a = np.array(r, dtype=float)
    d = a.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float] | None:
        """The unit vector w for which x - 2 w (w'x) has one entry left, and that entry."""
        scale = np.abs(x).max(initial=0.0)
        if scale == 0 or not np.any(x[1:]):
            return None
        y = x / scale
        size = -math.copysign(np.linalg.norm(y), y[0])
        y[0] -= size
        return y / np.linalg.norm(y), size * scale

    for k in range(d):
        left = reflector(a[k:, k].copy())
        if left:
            w, entry = left
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
            a[k:, k] = 0
            a[k, k] = entry
        right = reflector(a[k, k + 1 :].copy()) if k + 1 < d else None
        if right:
            w, entry = right
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            a[k, k + 1 :] = 0
            a[k, k + 1] = entry
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, the largest first, each to high relative accuracy.

    Differential qd with shifts, on squares q and e. A shift below the least value keeps
    all of them positive; one that doesn't is tried again, lessened by how far it failed.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    todo = [(((diagonal / scale) ** 2).tolist(), ((above / scale) ** 2).tolist(), 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        for turn in range(100 * len(q) + 100):
            if len(q) < 2:
                break
            if e[-1] <= TOLERANCE * (sigma + q[-1]):  # the last value has settled
                found.append(q.pop() + sigma)
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= TOLERANCE * (sigma + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if turn % 16 == 0 and 1.5 * q[0] < q[-1]:  # the transpose, read from the other end: small values settle at the end
                q.reverse()
                e.reverse()
            shift = least_of_two(q, e) if turn % 64 < 48 else 0.0
            while (new := qd_step(q, e, shift))[2] < 0:
                lessened = shift + new[2]
                shift = lessened * (1 - 4 * EPS) if new[3] and lessened > 0 else shift / 4 if shift > EPS * q[0] else 0.0
            q, e, sigma = new[0], new[1], sigma + shift
        else:
            raise ArithmeticError("qd steps didn't settle")
        found += [x + sigma for x in q]
    return np.sqrt(np.sort(np.maximum(found, 0.0))[::-1]) * scale


def least_of_two(q: list[float], e: list[float]) -> float:
    """The lesser eigenvalue of the last two by two of the product that q and e stand for."""
    a, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1]
    product = q[-2] * q[-1] + (e[-2] * c if len(e) > 1 else 0.0)
    return product / ((a + c) / 2 + math.sqrt(((a - c) / 2) ** 2 + q[-2] * e[-1]))


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One dqds step: the new q and e, the least d if that is negative (else 0), and whether only the last one is."""
    out_q, out_e, d = [], [], q[0] - shift
    for i, x in enumerate(e):
        if d < 0:
            return q, e, d, False
        top = d + x
        ratio = q[i + 1] / top if top else 0.0
        out_q.append(top)
        out_e.append(x * ratio)
        d = d * ratio - shift
    out_q.append(d)
    return out_q, out_e, min(d, 0.0), True


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twisted factorisations of B'B - value^2: the multipliers from above, those from below, and gamma of each twist."""
    n, shift = len(diagonal), value * value
    tiny = EPS * max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0))
    b = np.where(np.abs(diagonal) < tiny * EPS, tiny * EPS, diagonal)
    big, low = b * b, above / b[:-1]  # B'B = L D L'
    floor = tiny * tiny
    down, up, s, p = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n), np.zeros(n)
    s[0], p[-1] = -shift, big[-1] - shift
    for i in range(n - 1):
        d = s[i] + big[i]
        down[i] = low[i] * big[i] / (d if abs(d) > floor * EPS else floor * EPS)
        s[i + 1] = down[i] * low[i] * s[i] - shift
    for i in range(n - 2, -1, -1):
        d = big[i] * low[i] ** 2 + p[i + 1]
        t = big[i] / (d if abs(d) > floor * EPS else floor * EPS)
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - shift
    return down, up, s + p + shift


def vector_of(down: np.ndarray, up: np.ndarray, twist: int) -> np.ndarray:
    """The unit vector that a factorisation with this twist gives."""
    z = np.zeros(len(down) + 1)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, len(z) - 1):
        z[i + 1] = -up[i] * z[i]
    size = np.abs(z).max()
    z = z / size if np.isfinite(size) else np.where(np.isfinite(z), 0.0, np.sign(z))
    return z / np.linalg.norm(z)


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of an upper bidiagonal matrix for its largest values, given in order.

    Values with a relative gap below CLUSTER are a cluster: each of its vectors is made
    orthogonal to those before, taking another twist where little is left of it, and the
    cluster is turned within itself so that the matrix keeps its vectors apart.
    """
    n, out = len(diagonal), []
    b = np.diag(diagonal) + np.diag(above, 1)
    start = 0
    for k in range(len(values)):
        if k and values[k - 1] - values[k] > CLUSTER * values[k - 1]:
            start = k
        down, up, gamma = twisted(diagonal, above, values[k])
        before, best, left = np.array(out[start:k]).reshape(k - start, n), None, -1.0
        for twist in np.argsort(np.abs(gamma), kind="stable"):
            z = vector_of(down, up, int(twist))
            for _ in range(2):
                z = z - before.T @ (before @ z)
            size = np.linalg.norm(z)
            if size > left:
                best, left = z / size if size else z, size
            if left > 0.1:
                break
        out.append(best)
        if k + 1 == len(values) or values[k] - values[k + 1] > CLUSTER * values[k]:
            if k > start:
                basis = np.linalg.qr(np.array(out[start : k + 1]).T)[0]
                _, _, turned = np.linalg.svd(b @ basis, full_matrices=False)
                out[start : k + 1] = list((basis @ turned.T).T)
    return np.array(out).reshape(len(values), n).T


def principal(r: np.ndarray, n: int, limit: int) -> tuple[np.ndarray, np.ndarray, float]:
    """From the triangle of n centred rows: the eigenvalues of their covariance (the largest, those above rounding), its vectors as columns, its trace."""
    diagonal, above, v = householder_bidiagonal(r)
    values = dqds(diagonal, above)
    trace = float(np.sum(r.astype(float) ** 2)) / n
    wanted = values[:limit]
    wanted = wanted[wanted > len(values) * EPS * max(values[0], 1e-300)] if len(values) else wanted
    # All of a cluster that the limit cuts belong to its basis.
    more = len(wanted)
    while 0 < more < len(values) and values[more - 1] - values[more] <= CLUSTER * values[more - 1] and values[more] > len(values) * EPS * values[0]:
        more += 1
    vectors = v @ right_vectors(diagonal, above, values[:more])[:, : len(wanted)] if more else np.zeros((r.shape[1], 0))
    return wanted**2 / n, vectors, trace


def packed(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes: two for each where a row's are all small, else eight; equal rows have equal bytes."""
    y = x - SHIFT
    small = np.abs(y).max(axis=1, initial=0) < 1 << 15
    narrow = y.astype(np.int16)
    return pa.array([narrow[i].tobytes() if small[i] else y[i].tobytes() for i in range(len(y))], pa.binary())


def unpacked(rows: pa.Array, d: int) -> np.ndarray:
    out = np.empty((len(rows), d), np.int64)
    for i, b in enumerate(rows.to_pylist()):
        out[i] = np.frombuffer(b, np.int16 if len(b) == 2 * d else np.int64)
    return out + SHIFT


def whole_numbers(column: pa.Array, d: int) -> np.ndarray:
    """floor(64 c) + 1000000 of each entry c; beyond 2^52 it is held there."""
    entries = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)
    return np.clip(np.floor(SCALE * entries), -(2.0**52), 2.0**52).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: as 64-bit numbers if all fit, else as Python's."""
    largest = max(int(np.abs(x).max(initial=0)) * n, *(abs(s) for s in sums))
    return n * x - np.array(sums, np.int64) if largest < 1 << 61 else n * x.astype(object) - np.array(sums, object)


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows whose vector is there, without null or non-finite entries, of the commonest length (of equally common ones the least)."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & ~bad & (F.size("embedding") > 0))
    first = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (first["d"] if first else 0))


def whiten(embeddings: DataFrame, *, components: int = 16) -> DataFrame:
    """Coordinates of every vector on the principal directions of the different vectors, scaled to unit variance.

    Entries c count as floor(64 c) + 1000000. Returns for each row that remains and each
    component (numbered from 1 by falling variance, either sign, the same for all rows):
    vec_id, component, n (different vectors), deviation (the exact sum of (n x - S)^2 over
    the dimensions, with the sums S of the different vectors; null beyond 64 bits),
    whitened, explained (the component's share of all variance) and identity_error (one
    value: the largest entry, without sign, of whitened's covariance less the identity,
    over the different vectors). Rows whose vector is null or empty, holds null or
    non-finite entries, or has not the commonest length are dropped. Repeated rows come
    out repeated but count once; a direction without variance is no component, so one
    different vector, or an empty table, gives no rows. Entries beyond 2^52 / 64 are
    held there. Only vec_id and embedding are read, so further columns can't clash.

    A task holds a block of rows and a few triangles of d by d numbers; the driver holds
    one such triangle, which depends on the dimensions d alone.
    """
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = usable(embeddings)
    head = rows.select(F.size("embedding")).first()
    none = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    if head is None:
        return spark.createDataFrame([], none)
    d = head[0]

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([packed(whole_numbers(batch.column(0), d))], names=["x"])

    fit = stored(rows.select("embedding").mapInArrow(pack_rows, "x binary").distinct())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At place 0 the number of rows, behind it the sums of each dimension."""
        for batch in batches:
            x = unpacked(batch.column(0), d)
            for k in range(0, len(x), 1 << 10):
                part = x[k : k + (1 << 10)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(np.append(len(part), part.sum(axis=0)))], names=["place", "total"])

    total = F.sum(F.col("total").cast("decimal(38,0)"))
    added = {r["place"]: int(r["total"]) for r in fit.mapInArrow(add_up, "place int, total long").groupBy("place").agg(total.alias("total")).collect()}  # d + 1 rows
    n, sums = added[0], [added[i + 1] for i in range(d)]

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                c = centred(unpacked(batch.column(0).slice(k, BLOCK_ROWS), d), n, sums).astype(float) / n
                r = np.linalg.qr(np.concatenate([r, c]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // FAN_IN]), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def join(key: tuple, several: pa.Table) -> pa.Table:
        r = np.zeros((0, d))
        for b in sorted(several.column("r").to_pylist()):
            r = np.linalg.qr(np.concatenate([r, np.frombuffer(b).reshape(-1, d)]), mode="r")
        return pa.table({"part": [key[0].as_py() // FAN_IN], "r": pa.array([r.tobytes()], pa.binary())})

    left, tree = fit.rdd.getNumPartitions(), fit.mapInArrow(triangles, "part long, r binary")
    while left > 1:
        tree, left = tree.groupBy("part").applyInArrow(join, "part long, r binary"), -(-left // FAN_IN)
    r = np.frombuffer(tree.first()["r"]).reshape(-1, d)
    variances, vectors, trace = principal(np.concatenate([r, np.zeros((max(0, d - len(r)), d))]), n, components)
    count = len(variances)
    if not count:
        return spark.createDataFrame([], none)
    to_white = vectors / np.sqrt(variances)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the whitened coordinates and of their products."""
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                w = (centred(unpacked(batch.column(0).slice(k, BLOCK_ROWS), d), n, sums).astype(float) / n) @ to_white
                values = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["place", "value"])

    by_place = {r["place"]: r["value"] for r in fit.mapInArrow(moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()}  # components^2 rows
    mean = np.array([by_place[i] for i in range(count)]) / n
    covariance = np.array([by_place[count + i] for i in range(count * count)]).reshape(count, count) / n - np.outer(mean, mean)
    error, explained = float(np.abs(covariance - np.eye(count)).max()), variances / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1 << 10):
                batch = whole.slice(k, 1 << 10)
                c = centred(whole_numbers(batch.column(1), d), n, sums)
                rough = (c.astype(float) ** 2).sum(axis=1)
                exact = (c**2).sum(axis=1) if c.dtype == object or rough.max() < 2.0**62 else (c.astype(object) ** 2).sum(axis=1)
                deviation = pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())
                white = (c.astype(float) / n) @ to_white
                size = batch.num_rows
                at = pa.array(np.repeat(np.arange(size), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)), pa.array(np.full(size * count, n)),
                        deviation.take(at), pa.array(white.ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * count, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, none)
