"""Element-wise maps with broadcasting; joins only on the dimensions that operands share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.model import GridArray


def map_cells(f: Callable[..., Column], a: GridArray, *others: GridArray) -> GridArray:
    """``f`` over arrays of one shape."""
    for b in others:
        if b.shape != a.shape:
            raise ValueError(f"shapes {a.shape} and {b.shape} differ")
    return broadcast(f, a, *others)


def broadcast(f: Callable[..., Column], *operands) -> GridArray:
    """``f`` over arrays and scalars; dimensions align from the first, and size 1 stretches.

    A stretched operand joins on its other dimensions alone, so a vector meets
    a matrix in one equi-join, broadcast where the vector's shape bounds it.
    Sparse operands stay sparse where all arrays are sparse and of one shape and
    ``f`` of their zeros is 0; else their zeros become cells first.
    """
    arrays = [x for x in operands if isinstance(x, GridArray)]
    if not arrays:
        raise ValueError("no array among the operands")
    ndim = max(a.ndim for a in arrays)
    shape = []
    for k in range(ndim):
        sizes = {a.shape[k] for a in arrays if k < a.ndim} - {1}
        if len(sizes) > 1:
            raise ValueError(f"sizes {sorted(sizes)} meet in dimension {k}")
        shape.append(sizes.pop() if sizes else 1)
    alike = all(a.sparse and a.shape == tuple(shape) for a in arrays)
    if any(a.sparse for a in arrays) and not (alike and _keeps_zero(f, operands)):
        operands = [x.dense() if isinstance(x, GridArray) else x for x in operands]
        arrays = [x for x in operands if isinstance(x, GridArray)]
    if len(arrays) == 1 and arrays[0].shape == tuple(shape):
        return arrays[0].values(f(*[F.col("v") if isinstance(x, GridArray) else F.lit(x) for x in operands]))
    axes = lambda a: [k for k in range(a.ndim) if a.shape[k] != 1 or shape[k] == 1]
    order = sorted(range(len(arrays)), key=lambda n: -len(axes(arrays[n])))
    have: list[int] = []
    joined = None
    sparse = all(a.sparse for a in arrays)
    for n in order:
        a = arrays[n]
        side = a if joined is None else GridArray(a.small(), a.shape, a.sparse)
        cells = side.df.select(*[F.col(f"i{k}").alias(f"j{k}") for k in axes(a)], F.col("v").alias(f"v{n}"))
        if joined is None:
            joined, have = cells, axes(a)
            continue
        shared = [f"j{k}" for k in axes(a) if k in have]
        how = "full" if any(x.sparse for x in arrays) and len(shared) == len(have) == len(axes(a)) else "inner"
        joined = joined.join(cells, shared, how) if shared else joined.crossJoin(cells)  # an outer product: as many rows as the result
        have = sorted({*have, *axes(a)})
    names = iter(range(len(arrays)))
    value = lambda: F.coalesce(F.col(f"v{next(names)}"), F.lit(0)) if any(a.sparse for a in arrays) else F.col(f"v{next(names)}")
    out = f(*[value() if isinstance(x, GridArray) else F.lit(x) for x in operands])
    index = [(F.col(f"j{k}") if k in have else F.lit(0).cast("bigint")).alias(f"i{k}") for k in range(ndim)]
    return GridArray(joined.select(*index, out.alias("v")), tuple(shape), sparse)


def _keeps_zero(f: Callable[..., Column], operands) -> bool:
    """Whether ``f`` of the arrays' zeros is 0: one constant expression, asked of the optimiser by a table of one row."""
    spark = next(x for x in operands if isinstance(x, GridArray)).df.sparkSession
    zeros = [F.lit(0).cast(dict(x.df.dtypes)["v"]) if isinstance(x, GridArray) else F.lit(x) for x in operands]
    return bool(spark.range(1).select((f(*zeros) == 0).alias("z")).first()[0])


def add(a: GridArray, b) -> GridArray:
    return map_cells(lambda x, y: x + y, a, b) if isinstance(b, GridArray) else broadcast(lambda x, y: x + y, a, b)


def subtract(a: GridArray, b) -> GridArray:
    return map_cells(lambda x, y: x - y, a, b) if isinstance(b, GridArray) else broadcast(lambda x, y: x - y, a, b)


def scale_rows(d: GridArray, x: GridArray) -> GridArray:
    """A diagonal matrix, given as a vector, times a matrix."""
    if d.shape != x.shape[:1]:
        raise ValueError(f"a diagonal of {d.shape} can't scale {x.shape}")
    if x.sparse or d.sparse:  # a zero stays zero, whatever scales it
        met = x.df.join(GridArray(d.small(), d.shape).df.withColumnRenamed("v", "s"), "i0")
        return GridArray(met.select(*x.index, (F.col("s") * F.col("v")).alias("v")), x.shape, True)
    return broadcast(lambda s, v: s * v, d, x)


def equal(a: GridArray, b: GridArray, tolerance: float = 0.0):
    """A one-row DataFrame ``equal``: whether all cells agree (within ``tolerance``)."""
    if a.shape != b.shape:
        return a.df.sparkSession.createDataFrame([(False,)], "equal boolean")
    joined = a.df.withColumnRenamed("v", "x").join(b.df.withColumnRenamed("v", "y"), a.index, "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    same = x.eqNullSafe(y) if tolerance == 0 else F.abs(x - y) <= tolerance
    return joined.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))


def map_tiles(f: Callable, a: GridArray, block: tuple[int, ...]) -> GridArray:
    """``f`` over the array's tiles as NumPy arrays; a tile's result has the tile's shape.  A task holds one tile."""
    import pandas as pd

    from gridloom.sources import arrays

    index, shape = a.index, a.shape

    def run(key, pdf):
        import numpy as np

        lo = [int(b) * n for b, n in zip(key, block)]
        x = np.zeros([min(n, size - at) for at, n, size in zip(lo, block, shape)])
        x[tuple(pdf[c].to_numpy() - at for c, at in zip(index, lo))] = pdf["v"]
        y = np.asarray(f(x), float)
        if y.shape != x.shape:
            raise ValueError(f"a tile of {x.shape} became one of {y.shape}")
        at = np.indices(y.shape).reshape(y.ndim, -1)
        return pd.DataFrame({c: at[k] + lo[k] for k, c in enumerate(index)} | {"v": y.ravel()})

    keyed = arrays.tiles(a.dense(), block)
    made = keyed.groupBy(*[f"b{k}" for k in range(a.ndim)]).applyInPandas(run, ", ".join(f"{c} bigint" for c in index) + ", v double")
    return GridArray(made, shape)
