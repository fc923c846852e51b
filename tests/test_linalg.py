"""Factorisations, solves and products by panels, tiles and joins against NumPy, with panels smaller than the matrix."""

import numpy as np
import pytest

from gridloom.operators import elementwise, indexing, linalg, panels, reduce, stencil
from gridloom.sources import arrays

RNG = np.random.default_rng(0)
X = RNG.normal(size=(40, 12))
G = X.T @ X + np.eye(12)


@pytest.fixture(scope="module")
def put(spark):
    return lambda x: arrays.from_numpy(spark, x)


@pytest.mark.parametrize("block", [None, 5])
def test_cholesky(put, block):
    assert np.allclose(linalg.cholesky(put(G), block=block).collect(), np.linalg.cholesky(G))
    for wrong, why in ((G - 100 * np.eye(12), "positive definite"), (np.triu(G), "symmetric")):
        with pytest.raises(np.linalg.LinAlgError, match=why):
            linalg.cholesky(put(wrong), block=block)


@pytest.mark.parametrize(("shape", "block"), [((12, 12), None), ((12, 12), 5), ((15, 8), 3), ((8, 15), 3)])
def test_lu(put, shape, block):
    x = RNG.normal(size=shape)
    low, up, order = (a.collect() for a in linalg.lu(put(x), block=block))
    assert np.allclose(x[order.astype(int)], low @ up) and np.abs(low).max() <= 1
    assert np.array_equal(low, np.tril(low)) and np.array_equal(up, np.triu(up))


def test_lu_pivots(put):
    low, up, order = (a.collect() for a in linalg.lu(put(G), pivot=False, block=5))
    assert np.allclose(low @ up, G) and order.tolist() == list(range(12))
    with pytest.raises(np.linalg.LinAlgError):
        linalg.lu(put(np.array([[0.0, 1], [1, 0]])), pivot=False)
    with pytest.raises(np.linalg.LinAlgError):
        linalg.lu(put(np.ones((4, 4))), block=2)


@pytest.mark.parametrize(("x", "block"), [(X, None), (X, 5), (RNG.normal(size=(6, 9)), None), (np.ones((16, 3)), None), (np.ones((11, 3)), None)])
def test_qr(put, x, block):
    q, r = (a.collect() for a in linalg.qr(put(x), block))
    assert np.allclose(q @ r, x) and np.allclose(q.T @ q, np.eye(q.shape[1])) and np.allclose(r, np.triu(r)) and (np.diag(r) > -1e-12).all()
    b = RNG.normal(size=(x.shape[0], 2))
    held = linalg.qr(put(x), block)[0]
    assert np.allclose(linalg.apply_q(held, put(b), transpose=True).collect(), q.T @ b)
    assert np.allclose(linalg.apply_q(held, put(b.T), side="right").collect(), b.T @ q)


def test_qr_tree(put):
    """Leaves of 6 rows and nodes of 2: several levels."""
    x = RNG.normal(size=(100, 4))
    q, r = panels.tsqr(panels.to_rows(put(x)), 4, leaf_rows=6, fan_in=2)
    q = panels.to_cells(q, x.shape).collect()
    assert np.allclose(q @ r, x) and np.allclose(q.T @ q, np.eye(4))


@pytest.mark.parametrize("x", [X, X.T, np.ones((9, 3))])
def test_svd(put, x):
    u, s, vt = (a.collect() for a in linalg.svd(put(x)))
    assert np.allclose(u * s @ vt, x) and np.allclose(s, np.linalg.svd(x)[1])


@pytest.mark.parametrize("upper", [True, False])
@pytest.mark.parametrize("side", ["left", "right"])
def test_triangular_solve(put, upper, side):
    t, b = (np.triu if upper else np.tril)(G), RNG.normal(size=(12, 3))
    for op, of in (("N", t), ("T", t.T)):
        x = linalg.triangular_solve(put(G), put(b if side == "left" else b.T), upper, side, op, block=5).collect()
        assert np.allclose(of @ x if side == "left" else x @ of, b if side == "left" else b.T)
    with pytest.raises(np.linalg.LinAlgError):
        linalg.triangular_solve(put(np.zeros((3, 3))), put(np.ones(3)), upper)


def test_solves(put):
    b, c = RNG.normal(size=(12, 2)), RNG.normal(size=40)
    for method in ("lu", "cholesky"):
        assert np.allclose(linalg.solve(put(G), put(b), method).collect(), np.linalg.solve(G, b))
        assert np.allclose(linalg.inverse(put(G), method).collect(), np.linalg.inv(G))
    low = np.ones((40, 3))
    for x, y in ((X, c), (X.T, b[:, 0]), (low, c)):  # tall, wide, and of rank 1
        assert np.allclose(linalg.solve(put(x), put(y)).collect(), np.linalg.lstsq(x, y, rcond=None)[0])


def test_products(put):
    a, g = put(X), put(G)
    assert np.allclose(linalg.matmul_tiled(a, g, 5).collect(), X @ G)
    assert np.allclose(linalg.matmul_tiled(a.T, a, 2).collect(), X.T @ X)
    assert np.allclose((a @ g).collect(), X @ G) and np.allclose((a @ put(G[0])).collect(), X @ G[0])
    assert np.allclose(linalg.syrk(a, outer=True).collect(), X @ X.T)
    for ops, want in (("TN", X.T @ X), ("NN", G @ G), ("NT", G @ X.T @ np.eye(40)[:, :12]), ("CN", X.T @ X)):
        left, right = {"TN": (a, a), "CN": (a, a), "NN": (g, g), "NT": (g, put(X[:12]))}[ops]
        assert np.allclose(linalg.multiply_into(g, left, right, 2.0, 3.0, ops).collect(), 2 * want + 3 * G)
    with pytest.raises(ValueError):
        linalg.multiply_into(g, a, a)
    for k in (0, 1, 2, 5):
        assert np.allclose(linalg.power(g, k).collect(), np.linalg.matrix_power(G, k))
    with pytest.raises(ValueError):
        linalg.power(g, -1)


def test_sparse(spark, put):
    e, one = arrays.eye(spark, 3), np.eye(3)
    assert np.allclose((e + 1.0).collect(), one + 1) and np.allclose((e * 2.0).collect(), one * 2) and (e * 2.0).sparse
    assert np.allclose((e + put(np.ones((3, 3)))).collect(), one + 1) and np.allclose((e + e).collect(), 2 * one)
    column = put(np.arange(3.0).reshape(3, 1))
    assert np.allclose(elementwise.broadcast(lambda x, y: x - y, e, column).collect(), one - np.arange(3.0).reshape(3, 1))
    block = one.copy()
    block[:2, :2] = 5
    assert np.allclose(indexing.set_value(e, [(0, 2), (0, 2)], 5.0).collect(), block)
    assert np.allclose(indexing.set_block(e, [(1, 3), (0, 2)], put(np.full((2, 2), 7.0))).collect(), [[1, 0, 0], [7, 7, 0], [7, 7, 1]])
    assert indexing.take(e, 0, 1).collect() == 0 and indexing.first(e).collect() == indexing.last(e).collect() == 1
    for op, want in (("min", 0), ("max", 1), ("mean", 1 / 3), ("var", one.var(ddof=1)), ("std", one.std(ddof=1)), ("prod", 0), ("norm", 3**0.5)):
        assert np.isclose(reduce.reduce(e, op).collect(), want)
    assert np.allclose(reduce.reduce(e, "mean", (0,)).collect(), one.mean(0, keepdims=True))
    assert np.allclose(stencil.neighbours(e, 1, stencil.pad(0.0), fold="min").collect(), 0)


def _most_in_a_task(df):
    from pyspark.sql import functions as F

    return df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("share", [0.04, 0.9])
def test_sparse_products(put, monkeypatch, share):
    """Products of few cells are dealt to as many tasks as they need, whatever the setting of partitions; of many, summed up first."""
    monkeypatch.setattr(linalg, "TASK_CELLS", 64, raising=False)
    x = np.where(RNG.uniform(size=(50, 60)) < share, RNG.normal(size=(50, 60)), 0)
    cells = arrays.from_numpy(put(x).df.sparkSession, x)
    a = type(cells)(cells.df.filter("v <> 0"), x.shape, True)
    for got, want in ((linalg.matmul(a.T, a), x.T @ x), (linalg.syrk(a), x.T @ x), (a @ a.T, x @ x.T), (a @ put(x[0]), x @ x[0])):
        assert got.sparse and np.allclose(got.collect(), want)
    if share < 0.5:
        assert _most_in_a_task(linalg.matmul(a.T, a).df) < 3 * 64


def test_sparse_query_is_dealt(spark, monkeypatch):
    """A task holds the lines of some orders, by the number of lines."""
    from gridloom import queries

    monkeypatch.setattr(queries, "ORDER_LINES", 200, raising=False)
    a = queries.sparse(spark, "/root/testdata/sf0.001")
    assert _most_in_a_task(a.df) < 3 * 200
    x = a.collect()
    assert np.allclose(linalg.matmul(a.T, a).collect(), x.T @ x)


def test_updates(put):
    x = RNG.normal(size=(4, 3))
    y = x.copy()
    y[1:3, :2] = 0
    assert np.allclose(indexing.copy_into(put(x), put(np.zeros((2, 2))), (1, 0)).collect(), y)
    with pytest.raises(IndexError):
        indexing.copy_into(put(x), put(np.zeros((4, 4))))
    assert indexing.scalar(put(x), 2, 1) == x[2, 1]
    with indexing.scalars_allowed(False), pytest.raises(RuntimeError):
        indexing.scalar(put(x), 0, 0)


def test_folds_and_extrema(put):
    a = put(X)
    assert np.isclose(reduce.fold(a, lambda p, q: p + q, 5.0, (0, 1), run=7).collect().item(), X.sum() + 5)
    assert np.allclose(reduce.fold(a, lambda p, q: q, 0.0, (0,), run=3).collect(), X[-1:])  # the last in order
    got = reduce.reduce(a, "extrema", init=(-9.0, 0.5)).df.first().v
    assert (got.min, got.max) == (-9.0, max(X.max(), 0.5))


def test_boundaries(put):
    line = put(np.array([np.inf, 1, 2, 3]))
    assert stencil.neighbours(line, 1, stencil.pad(0.0)).collect().tolist() == [np.inf, np.inf, 6, 5]
    big = put(np.array([2**53 + 1, 1, 2**53 + 3]))
    assert stencil.neighbours(big, 1, stencil.wrap(), fold="max").collect().tolist() == [2**53 + 3] * 3
    x = RNG.normal(size=(4, 5))
    padded = np.pad(x, 1, constant_values=2.0)
    want = sum(padded[1 + i : 5 + i, 1 + j : 6 + j] for i in (-1, 0, 1) for j in (-1, 0, 1))
    assert np.allclose(stencil.neighbours(put(x), 1, stencil.pad(2.0)).collect(), want)


def test_transforms_of_long_lines(spark):
    """Lines laid out as matrices, and of prime length as convolutions, there and back."""
    from gridloom.operators import fourier

    for n in (60, 53):
        x = RNG.normal(size=(n, 2))
        cells = fourier.complex_cells(arrays.from_numpy(spark, x))
        there = fourier.transform(cells, x.shape, line_cells=12 if n == 60 else 16)
        got = there.toPandas().sort_values(["i0", "i1"])
        assert np.allclose(got.re.to_numpy() + 1j * got.im.to_numpy(), np.fft.fft2(x).ravel())
        back = fourier.transform(there, x.shape, inverse=True, line_cells=12 if n == 60 else 16).toPandas().sort_values(["i0", "i1"])
        assert np.allclose(back.re, x.ravel()) and np.allclose(back.im, 0)
