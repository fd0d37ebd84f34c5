"""Whitening against NumPy's eigenvectors and exact sums."""

import math
from fractions import Fraction

import numpy as np
import pytest

from ledgerloom.llm import whitening

from .helpers import SF


def test_jacobi_equals_eigh():
    rng = np.random.default_rng(2)
    for d in (1, 2, 5, 40):
        x = rng.standard_normal((3 * d, d)) * 10.0 ** -np.arange(d).clip(0, 6)
        a = x.T @ x / len(x)
        e, v = whitening.jacobi(a)
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-9, atol=0)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose(a @ v, v * e, atol=1e-13 * e[0])
        assert (v[np.abs(v).argmax(axis=0), np.arange(d)] > 0).all()


def test_small_eigenvalues_are_accurate():
    """Of a scaled matrix, where methods that first reduce it lose the small ones."""
    d = 10.0 ** -np.arange(0, 16, 4)
    inner = np.full((4, 4), 0.5) + np.eye(4) / 2
    e, _ = whitening.jacobi(d[:, None] * inner * d)
    det = Fraction(1)
    for s in d:
        det *= Fraction(float(s)) ** 2
    assert float(np.prod(e)) == pytest.approx(float(det) * np.linalg.det(inner), rel=1e-12)


def by_hand(rows, k=8):
    """vec_id -> deviation and n, and the matrix of x."""
    x = [[math.floor(c * 1024) + 100_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    return n, [sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x], np.array(x, dtype=np.float64)


def checked(got, rows):
    n, deviation, x = by_hand(rows)
    v = np.cov(x.T, bias=True)
    e = np.linalg.eigvalsh(v)[::-1]
    k = min(8, x.shape[1])
    assert len(got) == k * len(rows)
    z = np.zeros((n, k))
    place = {i: at for at, (i, _) in enumerate(rows)}
    for r in got:
        assert (r.n, r.deviation) == (n, deviation[place[r.vec_id]])
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-9) and r.identity_error < 1e-10
        z[place[r.vec_id], r.component - 1] = r.whitened
    assert np.allclose(np.cov(z.T, bias=True), np.eye(k), atol=1e-9)
    axes = (x - x.mean(axis=0)).T @ z / n / np.sqrt(e[:k])  # unit eigenvectors again
    assert np.allclose(v @ axes, axes * e[:k], atol=1e-7 * e[0])


def test_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    checked(whitening.whitening(table).collect(), rows)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [(k, rng.standard_normal(12).tolist()) for k in range(40)]
    bad = [(100, None), (101, []), (102, [1.0] * 11 + [None]), (103, [float("nan")] * 12), (104, [float("inf")] + [0.0] * 11), (105, [1.0] * 3), (106, [1e300] * 12)]
    table = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in good + bad], "vec_id long, embedding array<double>, n int, component int, mean string")
    checked(whitening.whitening(table).collect(), good)
    got = whitening.whitening(table.union(table.where("vec_id < 3")).union(spark.createDataFrame([(None, good[5][1], 1, 2, "x")], table.schema)).repartition(5))
    assert got.where("vec_id = 1").count() == 16 and got.where("vec_id is null").count() == 8 and got.first().n == 44


def test_without_variance(spark):
    table = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whitening(table).collect()} == {(2, 0, None, 0.0, None)}
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whitening(flat).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and all(r.identity_error < 1e-12 for r in got)
    assert whitening.whitening(flat.limit(0)).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(2**30 - k), -float(2**30) + k * k, 0.1 * k]) for k in range(30)]
    n, deviation, _ = by_hand(rows)
    got = whitening.whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None) for r in got)
    x = np.array([[(1 << 40) - k, k, 5] for k in range(4)], dtype=np.int64)
    about = whitening.Sums(1 << 20, np.array([3, 1 << 45, 7], dtype=object))
    assert whitening.deviations(x, about) == [None] * 4
