"""Concatenation and permutation: index arithmetic, never a shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.model import GridArray


def permute(a: GridArray, order: tuple[int, ...]) -> GridArray:
    if sorted(order) != list(range(a.ndim)):
        raise ValueError(f"{order} is no permutation of {a.ndim} dimensions")
    return GridArray(a.df.select(*[F.col(f"i{p}").alias(f"i{k}") for k, p in enumerate(order)], "v"), tuple(a.shape[p] for p in order), a.sparse)


def concat(dim: int, *arrays: GridArray) -> GridArray:
    """Arrays one after the other along ``dim``; other sizes must agree."""
    first = arrays[0]
    at, out = 0, None
    for a in arrays:
        if a.ndim != first.ndim or any(x != y for k, (x, y) in enumerate(zip(a.shape, first.shape)) if k != dim):
            raise ValueError(f"shapes {first.shape} and {a.shape} differ outside dimension {dim}")
        moved = a.df.withColumn(f"i{dim}", F.col(f"i{dim}") + F.lit(at).cast("bigint"))
        out = moved if out is None else out.unionByName(moved)
        at += a.shape[dim]
    return GridArray(out, tuple(at if k == dim else n for k, n in enumerate(first.shape)), any(a.sparse for a in arrays))


def mirror(a: GridArray, upper: bool = True) -> GridArray:
    """A symmetric matrix from one triangle."""
    side = a.df.filter("i0 <= i1" if upper else "i0 >= i1")
    other = side.filter("i0 <> i1").select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v")
    return GridArray(side.union(other), a.shape, a.sparse)
