"""Operator 11 against numpy's own decompositions, its contract, and brute-force whole-number sums."""

import math

import numpy as np
import pytest

from weftgraph.llm import whitening
from weftgraph.llm.queries import op11_whitening
from weftgraph.llm.whitening import dqds, householder_bidiagonal, principal, whiten

DATA = "/root/testdata/sf0.001"
RNG = np.random.default_rng(7)
MATRICES = {
    "plain": RNG.normal(size=(300, 24)),
    "falling": RNG.normal(size=(300, 24)) * np.logspace(0, -8, 24),
    "rising": RNG.normal(size=(300, 24)) * np.logspace(-8, 0, 24),
    "rank three": RNG.normal(size=(60, 3)) @ RNG.normal(size=(3, 20)),
    "repeated dimensions": np.repeat(RNG.integers(-5, 5, (90, 7)).astype(float), 3, axis=1),
    "equal values": np.concatenate([np.eye(24) * 7, -np.eye(24) * 7]),
    "equal blocks": np.kron(np.eye(4), RNG.normal(size=(30, 6))),
    "few rows": RNG.normal(size=(4, 30)),
    "one dimension": RNG.normal(size=(9, 1)),
    "constant": np.ones((9, 5)),
    "empty dimensions": RNG.normal(size=(50, 6)) * [1, 0, 1, 0, 2, 0],
}


@pytest.mark.parametrize("name", MATRICES)
def test_solver(name):
    x = MATRICES[name]
    c, d = x - x.mean(axis=0), x.shape[1]
    r = np.linalg.qr(c, mode="r")
    r = np.concatenate([r, np.zeros((max(0, d - len(r)), d))])
    diagonal, above, v = householder_bidiagonal(r)
    want = np.zeros(d)
    want[: min(c.shape)] = np.linalg.svd(c, compute_uv=False)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13)
    assert np.allclose(dqds(diagonal, above), want, rtol=1e-12, atol=1e-13 * max(want[0], 1))
    variances, vectors, trace = principal(r, len(x), 16)
    assert len(variances) == min(16, np.sum(want > d * whitening.EPS * max(want[0], 1)))
    assert trace == pytest.approx(np.trace(c.T @ c) / len(x), abs=1e-12)
    if len(variances):
        white = c @ (vectors / np.sqrt(variances))
        assert np.abs(white.T @ white / len(x) - np.eye(len(variances))).max() < 1e-9
        assert np.abs(c.T @ c / len(x) @ vectors - vectors * variances).max() < 1e-13 * max(1, variances[0])


def test_dqds_keeps_relative_accuracy():
    """Of a graded bidiagonal matrix, whose product would lose the small values altogether."""
    diagonal, above = np.logspace(0, -30, 16), np.logspace(-1, -31, 15)
    got = dqds(diagonal, above)
    from decimal import Decimal, getcontext

    getcontext().prec = 80
    want = Decimal(1)
    for x in diagonal:
        want *= Decimal(float(x))
    product = Decimal(1)
    for x in got:
        product *= Decimal(float(x))
    assert abs(product / want - 1) < Decimal("1e-13")  # the determinant


def by_hand(rows, limit=16):
    """Rows that remain with their whole numbers, n, S, and the covariance's eigenvalues."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(x[j] for x in distinct) for j in range(len(distinct[0]))]
    c = (np.array(distinct, dtype=object) * n - np.array(sums, dtype=object)).astype(float) / n
    return kept, n, sums, np.linalg.eigvalsh(c.T @ c / n)[::-1][:limit], np.trace(c.T @ c / n), c.T @ c / n


def compare(got, rows):
    kept, n, sums, eigen, trace, covariance = by_hand(rows)
    count = sum(eigen > 1e-9 * eigen[0])
    assert len(got) == count * len(kept)
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], []).append(r)
    for i, x in kept:
        mine = by_row[i]
        assert {r["n"] for r in mine} == {n}
        want = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        assert {r["deviation"] for r in mine} == {want if want < 1 << 63 else None}
    first = {r["component"]: r for r in got}
    assert sorted(first) == list(range(1, count + 1)) and all(r["identity_error"] <= 1e-9 for r in got)
    assert [first[k]["explained"] for k in sorted(first)] == pytest.approx([e / trace for e in eigen[:count]], rel=1e-10)
    # The squares of a row's coordinates, weighted by the eigenvalues, don't depend on signs or on turned clusters.
    for i, x in kept[:50]:
        white = {r["component"]: r["whitened"] for r in by_row[i]}
        c = np.array([a - s / n for a, s in zip(x, sums, strict=True)], float)
        if count == len(x):
            assert sum(v * v for v in white.values()) * len([1 for r in by_row[i]]) / count == pytest.approx(c @ np.linalg.solve(covariance, c), rel=1e-6)


def test_registered_query(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    compare(op11_whitening(spark, DATA).collect(), [(r["vec_id"], r["embedding"]) for r in rows])


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    inf, nan = float("inf"), float("nan")
    good = [(k, [float(v) for v in RNG.normal(size=3)]) for k in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, nan, 2.0]), (104, [-inf, 0.0, 1.0]), (105, [1.0, 2.0])]
    copies = [(200 + k, good[0][1]) for k in range(30)] + [good[1], good[1]]
    rows = [(i, v, "x", 1) for i, v in good + bad + copies]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, n int").repartition(7)
    got = whiten(frame).collect()
    assert len(got) == 3 * 72
    kept, n, sums, eigen, trace, _ = by_hand(good)
    assert {r["n"] for r in got} == {n} == {40}
    assert max(r["identity_error"] for r in got) < 1e-9
    assert sorted({round(r["explained"], 10) for r in got}, reverse=True) == [round(e / trace, 10) for e in eigen]
    assert whiten(frame.limit(0)).count() == 0 and whiten(frame.where("vec_id = 0")).count() == 0 and whiten(frame.where("vec_id = 100")).count() == 0
    assert whiten(frame).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(2**40 + k), float(k * k)]) for k in range(12)] + [(99, [3e38, -3e38])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    held = lambda c: max(min(math.floor(64 * c), 1 << 52), -(1 << 52)) + 1_000_000
    x = {i: [held(c) for c in v] for i, v in rows}
    sums = [sum(v[j] for v in x.values()) for j in range(2)]
    for r in got:
        want = sum((13 * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert r["n"] == 13 and r["deviation"] == (want if want < 1 << 63 else None)
