"""Whitening beside a full eigendecomposition on the driver."""

from __future__ import annotations

import math

import numpy as np
import pytest

from newsloom.llm import whiten

VECTORS = "vec_id long, embedding array<float>, label int, x long, n string, component double"


def frame(spark, rows):
    plain = [(i, v and [None if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 1, 2, "n", 0.5) for i, v in plain], VECTORS).repartition(4)


def whole(rows):
    """Rows that remain, and their whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [i for i, _ in kept], [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept]


def check(got, rows, count=8):
    ids, x = whole(rows)
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    dev = {i: sum((n * a - s) ** 2 for a, s in zip(r, sums)) for i, r in zip(ids, x)}
    y = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == n * count
    white = np.zeros((n, count))
    place = {i: k for k, i in enumerate(ids)}
    for r in got:
        assert r.n == n and r.deviation == dev[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error <= 1e-9
        white[place[r.vec_id], r.component - 1] = r.whitened
    want = y @ axes[:, :count] / np.sqrt(values[:count])
    for k in range(count):
        sign = np.sign(white[:, k] @ want[:, k])
        assert np.abs(white[:, k] - sign * want[:, k]).max() < 1e-8


def test_whitened_equals_eigendecomposition(spark):
    rng = np.random.default_rng(1)
    mix = rng.standard_normal((12, 12)) * np.linspace(0.05, 1, 12)
    rows = [(i, (rng.standard_normal(12) @ mix).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    bad = [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [])]
    check(whiten.whiten(frame(spark, rows + bad)).collect(), rows)


def test_ties_and_flat_dimensions(spark):
    """Equal eigenvalues, and dimensions in which the rows do not differ."""
    base = [[1.0, 0, 0, 0], [-1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, -1.0, 0, 0], [0, 0, 0.5, 0], [0, 0, -0.5, 0]]
    got = whiten.whiten(frame(spark, list(enumerate(base)))).collect()
    # The fourth dimension is flat: three components, the first two of one value.
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 18
    shares = {r.component: r.explained for r in got}
    assert shares[1] == pytest.approx(shares[2], rel=1e-9)
    w = np.zeros((6, 3))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    w -= w.mean(0)
    assert np.abs(w.T @ w / 6 - np.eye(3)).max() < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]])
def test_nothing_to_whiten(spark, rows):
    got = whiten.whiten(frame(spark, rows))
    assert got.count() == 0
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_null_ids_and_other_lengths(spark):
    rows = [(None, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.5]), (None, [-1.0, 0.25]), (8, [1.0, 2.0, 3.0])]
    got = whiten.whiten(frame(spark, rows)).collect()
    assert len(got) == 8 and {r.n for r in got} == {4}
    assert sorted((r.vec_id is None, r.vec_id) for r in got if r.component == 1)[:2] == [(False, 7)] * 2


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + 2**20 * i), float(i % 3), float(i * i)]) for i in range(40)]
    got = {r.vec_id: r for r in whiten.whiten(frame(spark, rows)).collect() if r.component == 1}
    ids, x = whole(rows)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    for i, r in zip(ids, x):
        exact = sum((n * a - s) ** 2 for a, s in zip(r, sums))
        assert got[i].deviation == (exact if exact < 2**63 else None)
    huge = whiten.whiten(frame(spark, [*rows, (99, [3e38, 0.0, 0.0])]))
    assert huge.where("vec_id = 99").count() == 0


def test_bidiagonal_of_a_matrix():
    """X V = U B with orthonormal V, for full, deficient and wide matrices."""
    rng = np.random.default_rng(4)
    shapes = [rng.standard_normal((50, 9)), rng.standard_normal((50, 3)) @ rng.standard_normal((3, 9)), rng.standard_normal((4, 9)), np.eye(9)]
    for x in shapes:

        def multiply(g, others, x=x):
            u = x @ g
            return float(u @ u), x.T @ u, (x @ others).T @ u

        b, v = whiten.bidiagonal(multiply, 9, 9)
        assert np.abs(v.T @ v - np.eye(9)).max() < 1e-12
        assert np.allclose(np.triu(np.tril(b, 1)), b)
        want = np.zeros(9)
        s = np.linalg.svd(x, compute_uv=False)
        want[: len(s)] = s
        assert np.abs(np.linalg.svd(b, compute_uv=False) - want).max() < 1e-10
        assert np.abs(v @ b.T @ b @ v.T - x.T @ x).max() < 1e-10
