"""Slices, gathers and functional updates."""

from __future__ import annotations

import contextvars
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.model import GridArray


def _inside(a: GridArray, k: int, lo: int, hi: int) -> None:
    if not 0 <= lo <= hi <= a.shape[k]:
        raise IndexError(f"[{lo}, {hi}) is outside dimension {k} of size {a.shape[k]}")


def take(a: GridArray, *keys) -> GridArray:
    """One key a dimension: an int drops it, a slice (step 1) cuts it, a list picks indices in order, repeats included.

    Ints and slices are range filters, which reach a Parquet scan; a list is an
    equi-join with its positions.  A cell that a sparse array doesn't have is 0.
    """
    if len(keys) != a.ndim:
        raise IndexError(f"{len(keys)} keys for {a.ndim} dimensions")
    df, out, shape = a.df, [], []
    for k, key in enumerate(keys):
        c = F.col(f"i{k}")
        if isinstance(key, int):
            _inside(a, k, key, key + 1)
            df = df.filter(c == key)
        elif isinstance(key, slice):
            lo, hi, step = key.indices(a.shape[k])
            if step != 1:
                raise ValueError("only contiguous slices")
            df = df.filter((c >= lo) & (c < hi))
            out.append((c - lo, max(0, hi - lo)))
        else:
            for x in key:
                _inside(a, k, x, x + 1)
            picks = df.sparkSession.createDataFrame([(p, int(x)) for p, x in enumerate(key)], f"p{k} bigint, i{k} bigint")
            df = df.join(F.broadcast(picks), f"i{k}")  # as long as the key list in the driver
            out.append((F.col(f"p{k}"), len(key)))
        shape = [n for _, n in out]
    if not out and a.sparse:  # one cell, there or not
        kind = dict(a.df.dtypes)["v"]
        return GridArray(df.agg(F.coalesce(F.max("v"), F.lit(0).cast(kind)).alias("v")), ())
    return GridArray(df.select(*[c.cast("bigint").alias(f"i{n}") for n, (c, _) in enumerate(out)], "v"), tuple(shape), a.sparse)


def linear(a: GridArray, k: int) -> GridArray:
    """The cell of column-major number ``k``, as a scalar array."""
    at = []
    for n in a.shape:
        at.append(k % n)
        k //= n
    if k:
        raise IndexError("beyond the last cell")
    return take(a, *at)


def first(a: GridArray) -> GridArray:
    return take(a, *[0] * a.ndim)


def last(a: GridArray) -> GridArray:
    return take(a, *[n - 1 for n in a.shape])


def _hit(a: GridArray, ranges: list[tuple[int, int]]) -> Column:
    hit = F.lit(True)
    for k, (lo, hi) in enumerate(ranges):
        _inside(a, k, lo, hi)
        hit = hit & (F.col(f"i{k}") >= lo) & (F.col(f"i{k}") < hi)
    return hit


def set_value(a: GridArray, ranges: list[tuple[int, int]], x) -> GridArray:
    """The array with a constant in a block; the shape stays the whole array's.  A sparse array gets the block's cells."""
    hit = _hit(a, ranges)
    if not a.sparse:
        return a.values(F.when(hit, F.lit(x)).otherwise(F.col("v")))
    from gridloom.sources import arrays

    rest = GridArray(a.df.filter(~hit), a.shape, True)
    if x == 0:
        return rest
    block = arrays.full(a.df.sparkSession, tuple(hi - lo for lo, hi in ranges), x, dict(a.df.dtypes)["v"])
    return GridArray(rest.df.union(_moved(block, ranges)), a.shape, True)


def _moved(b: GridArray, ranges: list[tuple[int, int]]):
    return b.df.select(*[(F.col(c) + lo).alias(c) for c, (lo, _) in zip(b.index, ranges)], "v")


def set_block(a: GridArray, ranges: list[tuple[int, int]], b: GridArray) -> GridArray:
    """The array with another one in a block: the cells outside it, and the other's, moved there; no join."""
    if b.shape != tuple(hi - lo for lo, hi in ranges):
        raise ValueError(f"{b.shape} doesn't fill the block")
    own = b if a.sparse else b.dense()
    kind = dict(a.df.dtypes)["v"]
    moved = _moved(own, ranges).withColumn("v", F.col("v").cast(kind))
    return GridArray(a.df.filter(~_hit(a, ranges)).union(moved), a.shape, a.sparse)


def copy_into(to: GridArray, a: GridArray, at: tuple[int, ...] | None = None) -> GridArray:
    """``to`` with ``a`` in its first cells, or from ``at`` on; an array that doesn't fit is an error."""
    at = at or (0,) * to.ndim
    if a.ndim != to.ndim or any(lo < 0 or lo + n > size for lo, n, size in zip(at, a.shape, to.shape)):
        raise IndexError(f"{a.shape} from {at} doesn't fit {to.shape}")
    return set_block(to, [(lo, lo + n) for lo, n in zip(at, a.shape)], a)


def scalar(a: GridArray, *at: int):
    """One cell as a value in the driver; :func:`scalars_allowed` says whether that is let pass."""
    if not _scalars.get():
        raise RuntimeError("scalar indexing runs a job a cell; allow it by scalars_allowed()")
    return take(a, *at).df.first()[0]


_scalars: contextvars.ContextVar[bool] = contextvars.ContextVar("gridloom_scalars", default=True)


@contextmanager
def scalars_allowed(allow: bool = True):
    """Allow or forbid :func:`scalar` inside."""
    token = _scalars.set(allow)
    try:
        yield
    finally:
        _scalars.reset(token)
