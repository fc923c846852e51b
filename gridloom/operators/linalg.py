"""Linear algebra: products by broadcast rows, tiles or joins, and factorisations by panels of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import GridArray
from gridloom.operators import elementwise, panels, reshape
from gridloom.plans.durable import drop, materialize, stored

#: Columns up to which an n by n factor is decomposed further (singular values, least squares) at one place.
SQUARE = 8192
#: Cells of a sparse product that a task sums up at once.
TASK_CELLS = 1 << 20


def _as_matrix(b: GridArray) -> GridArray:
    """A vector as a matrix of one column."""
    return b if b.ndim == 2 else GridArray(b.df.select("i0", F.lit(0).cast("bigint").alias("i1"), "v"), (*b.shape, 1), b.sparse)


def _like(out: GridArray, b: GridArray) -> GridArray:
    return out if b.ndim == 2 else GridArray(out.df.select("i0", "v"), out.shape[:1], out.sparse)


def to_numpy(a: GridArray) -> np.ndarray:
    """A matrix of at most a panel's cells in the driver."""
    if a.cells > panels.PANEL_CELLS:
        raise ValueError(f"over {panels.PANEL_CELLS} cells")
    t = a.df.select("i0", "i1", F.col("v").cast("double").alias("v")).toArrow()
    x = np.zeros(a.shape)
    x[t["i0"].to_numpy(), t["i1"].to_numpy()] = t["v"].to_numpy()
    return x


def from_small(spark, x: np.ndarray) -> GridArray:
    """A driver's matrix of bounded size, dealt to the cluster."""
    return panels.to_cells(panels.from_matrix(spark, np.asarray(x, float)), x.shape)


def matmul(a: GridArray, b: GridArray) -> GridArray:
    """``a @ b`` for matrices and vectors.

    Sparse operands meet in a join on the contracted index, then sums by cell
    (:func:`_summed`).  Of dense ones a factor of at most a panel's cells is broadcast to
    the rows of the other; larger ones meet as tiles.
    """
    if a.ndim != 2 or b.ndim not in (1, 2) or a.shape[1] != b.shape[0]:
        raise ValueError(f"can't multiply {a.shape} and {b.shape}")
    if a.sparse or b.sparse:
        return _join_product(a, b)
    right = _as_matrix(b)
    if right.cells <= panels.PANEL_CELLS:
        return _like(_rows_product(a, right), b)
    if a.cells <= panels.PANEL_CELLS:
        return _like(_rows_product(right.T, a.T).T, b)
    return _like(matmul_tiled(a, right), b)


def _join_product(a: GridArray, b: GridArray) -> GridArray:
    left = a.df.select("i0", F.col("i1").alias("k"), F.col("v").alias("x"))
    columns = [F.col("i1").alias("j")] if b.ndim == 2 else []
    right = GridArray(b.small(), b.shape).df.select(F.col("i0").alias("k"), *columns, F.col("v").alias("y"))
    shape = (a.shape[0], *b.shape[1:])
    if columns:
        return GridArray(_summed(left, right, shape).select("i0", F.col("j").alias("i1"), "v"), shape, True)
    return GridArray(left.join(right, "k").groupBy("i0").agg(F.sum(F.col("x") * F.col("y")).alias("v")), shape, True)


def _summed(left: DataFrame, right: DataFrame, shape: tuple[int, int], half: bool = False) -> DataFrame:
    """``i0, j, v``: products of cells ``i0, k, x`` and ``k, j, y``, summed up; with ``half`` those of ``i0 <= j``.

    Partial sums before the shuffle hold a cell for nearly each product of a task
    where few products meet in a cell, so there products are dealt to their cells
    as they are, in as many tasks as a count of them needs.  Partial sums stay where
    the shape bounds them, and where a cell has over 8 products and they spare most
    of the shuffle.
    """
    met = left.join(right, "k")
    products = (met.filter("i0 <= j") if half else met).select("i0", "j", (F.col("x") * F.col("y")).alias("v"))
    cells = shape[0] * shape[1]
    if cells > TASK_CELLS:
        each = [side.groupBy("k").agg(F.count("*").alias(n)) for side, n in ((left, "m"), (right, "n"))]
        found = each[0].join(each[1], "k").agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
        if TASK_CELLS < found <= 8 * cells:
            products = products.repartition(-(-min(found, cells) // TASK_CELLS), "i0", "j")
    return products.groupBy("i0", "j").agg(F.sum("v").alias("v"))


def _rows_product(a: GridArray, b: GridArray) -> GridArray:
    held = a.df.sparkSession.sparkContext.broadcast(to_numpy(b))
    return panels.to_cells(panels.map_rows(panels.to_rows(a), a.shape[1], lambda _, x: x @ held.value), (a.shape[0], b.shape[1]))


def _tiles(a: GridArray, block: int, row: str, column: str) -> DataFrame:
    """``row, column, x``: the matrix in dense tiles, each packed once."""
    n = a.shape

    def pack(key, pdf):
        import pandas as pd

        p, q = int(key[0]), int(key[1])
        x = np.zeros((min(block, n[0] - p * block), min(block, n[1] - q * block)))
        x[pdf["i0"] - p * block, pdf["i1"] - q * block] = pdf["v"]
        return pd.DataFrame({row: [p], column: [q], "x": [x.ravel()]})

    at = [F.floor(F.col(c) / block).cast("int").alias(k) for c, k in (("i0", row), ("i1", column))]
    return a.df.select("i0", "i1", F.col("v").cast("double").alias("v")).groupBy(*at).applyInPandas(pack, f"{row} int, {column} int, x array<double>")


def matmul_tiled(a: GridArray, b: GridArray, block: int = 512) -> GridArray:
    """``a @ b`` by dense tiles: tiles that share the contracted index meet in a join, each moved once.

    A pair's product is one NumPy call; products are summed up in groups of 16
    tiles, then in a last sum, so a task holds few tiles at once.
    """
    import pyarrow as pa

    m, n, inner = a.shape[0], b.shape[1], a.shape[1]
    met = _tiles(a, block, "p", "k").join(_tiles(b, block, "k", "q").withColumnRenamed("x", "y"), "k").select("p", "q", "k", "x", "y")

    def multiply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                p, q, k = (batch.column(c)[i].as_py() for c in range(3))
                x, y = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                h, w = min(block, m - p * block), min(block, n - q * block)
                z = (x.reshape(h, -1) @ y.reshape(-1, w)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (p, q, k // 16)] + [pa.array([z])], names=["p", "q", "k", "x"])

    def total(pdf):
        out = pdf.iloc[[0]].copy()
        out["x"] = [np.sum(np.stack(pdf["x"].to_numpy()), axis=0)]
        return out

    parts = met.mapInArrow(multiply, "p int, q int, k int, x array<double>")
    if inner > block:
        parts = parts.groupBy("p", "q", "k").applyInPandas(total, "p int, q int, k int, x array<double>")
    if inner > 16 * block:
        parts = parts.groupBy("p", "q").applyInPandas(total, "p int, q int, k int, x array<double>")
    w = F.least(F.lit(block), F.lit(n) - F.col("q") * block)
    cells = parts.select("p", "q", w.alias("w"), F.posexplode("x").alias("at", "v"))
    return GridArray(cells.select((F.col("p") * block + F.floor(F.col("at") / F.col("w"))).cast("bigint").alias("i0"), (F.col("q") * block + F.col("at") % F.col("w")).cast("bigint").alias("i1"), "v"), (m, n))


def multiply_into(c: GridArray, a: GridArray, b: GridArray, alpha: float = 1.0, beta: float = 0.0, ops: str = "NN") -> GridArray:
    """``alpha * op(a) @ op(b) + beta * c``; an op is N, T or C (the adjoint, which for real cells is T)."""
    if len(ops) != 2 or set(ops) - set("NTC"):
        raise ValueError(f"no operations {ops}")
    left, right = (x if op == "N" else x.T for x, op in zip((a, b), ops))
    product = matmul(left, right)
    if product.shape != c.shape:
        raise ValueError(f"{product.shape} isn't {c.shape}")
    scaled = product * alpha if alpha != 1 else product
    return elementwise.add(scaled, c * beta) if beta else scaled


def syrk(a: GridArray, outer: bool = False) -> GridArray:
    """``a.T @ a``, or with ``outer`` ``a @ a.T``; exactly symmetric.

    A dense matrix whose result is a panel at most gives one partial product a
    task; a sparse one meets itself on its rows.
    """
    if outer:
        return syrk(a.T)
    n = a.shape[1]
    if a.sparse:
        left = a.df.select(F.col("i0").alias("k"), F.col("i1").alias("i0"), F.col("v").alias("x"))
        right = a.df.select(F.col("i0").alias("k"), F.col("i1").alias("j"), F.col("v").alias("y"))
        return reshape.mirror(GridArray(_summed(left, right, (n, n), True).select("i0", F.col("j").alias("i1"), "v"), (n, n), True))
    if n * n > panels.PANEL_CELLS:
        return reshape.mirror(matmul_tiled(a.T, a))
    parts = panels.gram_parts(panels.to_rows(a), n)
    return reshape.mirror(GridArray(parts.select(F.col("k").alias("i0"), F.col("j").cast("bigint").alias("i1"), "v"), (n, n)))


def power(a: GridArray, k: int) -> GridArray:
    """``a`` to the power ``k`` (0: the identity) by squaring; every product is written, so the plan stays short."""
    from gridloom.sources import arrays

    if k < 0 or a.shape[0] != a.shape[1]:
        raise ValueError("powers are of square matrices, and not negative")
    out, square = None, a
    while k:
        if k & 1:
            out = square if out is None else _written(matmul(out, square))
        k >>= 1
        square = _written(matmul(square, square)) if k else square
    return arrays.eye(a.df.sparkSession, a.shape[0]) if out is None else out


def _written(a: GridArray) -> GridArray:
    return GridArray(materialize(a.df, "product"), a.shape, a.sparse)


def _square(a: GridArray) -> int:
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError(f"{a.shape} is not square")
    return a.shape[0]


def cholesky(a: GridArray, upper: bool = False, block: int | None = None) -> GridArray:
    """The triangular factor; a matrix that is not symmetric or not positive definite is an error."""
    n = _square(a)
    away = a.df.alias("a").join(a.T.df.withColumnRenamed("v", "w"), a.index, "full")
    off, top = away.agg(F.max(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0)))), F.max(F.abs("v"))).first()
    if (off or 0.0) > 1e-9 * (top or 0.0):
        raise np.linalg.LinAlgError("the matrix is not symmetric, so not positive definite")
    f = panels.to_cells(panels.cholesky(panels.to_rows(a), n, block), (n, n))
    return f.T if upper else f


def lu(a: GridArray, pivot: bool = True, block: int | None = None) -> tuple[GridArray, GridArray, GridArray]:
    """``l, u, order`` with ``a[order] = l @ u``; pivots by the largest of a column, or none."""
    (m, n), spark = a.shape, a.df.sparkSession
    rows, order = panels.lu(panels.to_rows(a), m, n, pivot, block)
    k, packed = min(m, n), panels.to_cells(rows, a.shape)
    low = packed.df.filter(F.col("i1") < k).withColumn("v", F.when(F.col("i0") > F.col("i1"), F.col("v")).when(F.col("i0") == F.col("i1"), 1.0).otherwise(0.0))
    up = packed.df.filter(F.col("i0") < k).withColumn("v", F.when(F.col("i0") <= F.col("i1"), F.col("v")).otherwise(0.0))
    names = _like(from_small(spark, order[:, None]), GridArray(a.df, (m,)))
    return GridArray(low, (m, k)), GridArray(up, (k, n)), names


def _tall(a: GridArray, block: int | None = None) -> tuple[DataFrame, np.ndarray | None, GridArray]:
    """``q`` rows, r in the driver if it is one panel, and r."""
    (m, n), spark, rows = a.shape, a.df.sparkSession, panels.to_rows(a)
    b = block or (n if n * n <= panels.PANEL_CELLS else panels.width(n, n))
    if b >= n:
        q, r = panels.tsqr(rows, n, fan_in=max(2, min(panels.FAN_IN, panels.PANEL_CELLS // (n * n))))
        return q, r, from_small(spark, r)
    # Blocks of columns: each is made orthogonal to those before it, twice, and factored by the tree.
    done, parts, rows = None, [], materialize(rows, "rows")
    for lo in range(0, n, b):
        hi = min(n, lo + b)
        own, above = rows.select("i0", F.slice("x", lo + 1, hi - lo).alias("x")), np.zeros((lo, hi - lo))
        for _ in range(2 if done is not None else 0):
            c = panels.gram(done, lo, own, hi - lo)
            above += c
            held = spark.sparkContext.broadcast(c)
            both = done.join(own.withColumnRenamed("x", "y"), "i0").select("i0", F.concat("x", "y").alias("x"))
            own = materialize(panels.map_rows(both, hi, lambda _, x, held=held, lo=lo: x[:, lo:] - x[:, :lo] @ held.value), "rows")
        q, r = panels.tsqr(own, hi - lo)
        joined = q if done is None else done.join(q.withColumnRenamed("x", "y"), "i0").select("i0", F.concat("x", "y").alias("x"))
        done = materialize(joined, "q")
        part = from_small(spark, np.vstack([above, r, np.zeros((n - hi, hi - lo))]))
        parts.append(part)
    return done, None, reshape.concat(1, *parts)


def qr(a: GridArray, block: int | None = None) -> tuple[GridArray, GridArray]:
    """``q, r`` with r's diagonal not negative, for any shape and rank.  Of a wide matrix the first columns are factored, and the rest is ``q.T`` times it."""
    m, n = a.shape
    if m >= n:
        q, _, r = _tall(a, block)
        return panels.to_cells(materialize(q, "q"), (m, n)), r
    head = GridArray(a.df.filter(F.col("i1") < m), (m, m), a.sparse)
    q, _ = qr(head, block)
    return q, matmul(q.T, a)


def apply_q(q: GridArray, b: GridArray, side: str = "left", transpose: bool = False) -> GridArray:
    """``q @ b``, ``q.T @ b``, ``b @ q`` or ``b @ q.T``."""
    op = q.T if transpose else q
    return matmul(op, b) if side == "left" else matmul(b, op)


def svd(a: GridArray) -> tuple[GridArray, GridArray, GridArray]:
    """Thin ``u, s, vt`` with s descending: the tall factor stays distributed, its n by n one is decomposed in the driver."""
    m, n = a.shape
    if m < n:
        v, s, ut = svd(a.T)
        return ut.T, s, v.T
    if n > SQUARE:
        raise ValueError(f"singular values of over {SQUARE} columns")
    spark = a.df.sparkSession
    q, r, cells = _tall(a)
    u, s, vt = np.linalg.svd(_local(cells) if r is None else r)
    left = materialize(panels.map_rows(q, n, _times(spark, u)), "u")
    return panels.to_cells(left, (m, n)), _like(from_small(spark, s[:, None]), GridArray(a.df, (n,))), from_small(spark, vt)


def _local(a: GridArray) -> np.ndarray:
    t = a.df.toArrow()
    x = np.zeros(a.shape)
    x[t["i0"].to_numpy(), t["i1"].to_numpy()] = t["v"].to_numpy()
    return x


def _times(spark, u: np.ndarray):
    held = spark.sparkContext.broadcast(u)
    return lambda _, x: x @ held.value


def triangular_solve(t: GridArray, b: GridArray, upper: bool = True, side: str = "left", op: str = "N", unit: bool = False, block: int | None = None) -> GridArray:
    """``x`` with ``op(t) @ x = b`` or, at the right, ``x @ op(t) = b``; only t's triangle is read."""
    if op not in "NTC" or side not in ("left", "right"):
        raise ValueError(f"no solve {side} {op}")
    n = _square(t)
    if side == "right":
        return triangular_solve(t, _as_matrix(b).T, upper, "left", "T" if op == "N" else "N", unit, block).T
    if op != "N":
        t, upper = t.T, not upper
    right = _as_matrix(b)
    if right.shape[0] != n:
        raise ValueError(f"{t.shape} and {b.shape} don't meet")
    made = panels.triangular_solve(panels.to_rows(t), n, panels.to_rows(right), right.shape[1], upper, unit, block)
    return _like(panels.to_cells(made, right.shape), b)


def solve(a: GridArray, b: GridArray, method: str = "lu") -> GridArray:
    """``x`` with ``a @ x = b`` by lu, cholesky, lower or upper; where a is not square the least squares, and of those the shortest."""
    (m, n), right = a.shape, _as_matrix(b)
    spark = a.df.sparkSession
    if m != n:
        if min(m, n) > SQUARE:
            raise ValueError(f"least squares of over {SQUARE} columns")
        q, r, cells = _tall(a if m > n else a.T)
        r = _local(cells) if r is None else r
        if m > n:
            c = panels.gram(q, n, panels.to_rows(right), right.shape[1])
            return _like(from_small(spark, np.linalg.lstsq(r, c, rcond=None)[0]), b)
        y = np.linalg.lstsq(r.T, to_numpy(right), rcond=None)[0]
        return _like(panels.to_cells(materialize(panels.map_rows(q, m, _times(spark, y)), "x"), (n, right.shape[1])), b)
    if method in ("lower", "upper"):
        return triangular_solve(a, b, method == "upper")
    if method == "cholesky":
        f = cholesky(a)
        return triangular_solve(f, triangular_solve(f, b, False), False, op="T")
    low, up, order = lu(a)
    moved = right.df.join(order.df.select(F.col("v").cast("bigint").alias("i0"), F.col("i0").alias("p")), "i0").select(F.col("p").alias("i0"), "i1", "v")
    y = triangular_solve(low, GridArray(moved, right.shape, right.sparse), False, unit=True)
    return _like(triangular_solve(up, y), b)


def inverse(a: GridArray, method: str = "lu") -> GridArray:
    """The inverse, by solving for the identity."""
    from gridloom.sources import arrays

    return solve(a, arrays.eye(a.df.sparkSession, _square(a)), method)


def conjugate_gradient(a: GridArray, b: GridArray, tolerance: float = 1e-10, max_steps: int = 200) -> GridArray:
    """``x`` with ``a @ x = b`` for a sparse positive definite matrix; only scalars reach the driver.

    Each step keeps x, r and p in one written table, so a step's plan is one
    product and one join.
    """
    spark, b = b.df.sparkSession, b.dense()
    state, path = stored(b.df.select("i0", F.lit(0.0).alias("x"), F.col("v").cast("double").alias("r"), F.col("v").cast("double").alias("p")), "cg")
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    limit = tolerance**2 * rr
    for _ in range(max_steps):
        if rr <= limit:
            break
        ap = matmul(a, GridArray(state.select("i0", F.col("p").alias("v")), b.shape)).df.withColumnRenamed("v", "ap")
        joined, middle = stored(state.join(ap, "i0", "left").fillna(0.0, ["ap"]), "cg")
        alpha = rr / joined.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        moved = joined.select("i0", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        new = moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        old = path
        state, path = stored(moved.select("i0", "x", "r", (F.col("r") + new / rr * F.col("p")).alias("p")), "cg")
        for used in (old, middle):
            drop(spark, used)
        rr = new
    return GridArray(state.select("i0", F.col("x").alias("v")), b.shape)
