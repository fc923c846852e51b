"""The array handle: a DataFrame of index columns and a value, with a shape.

Indices are 0-based BIGINT columns ``i0 .. i{n-1}``; the value is ``v``.  A dense
array has every cell; in a sparse one an absent cell is zero.  Handles are
immutable, and every operator returns a new one over a longer plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells up to which one side of a join may be broadcast; the shape proves the bound.
BROADCAST_CELLS = 200_000


@dataclass(frozen=True)
class GridArray:
    df: DataFrame
    shape: tuple[int, ...]
    sparse: bool = False

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def index(self) -> list[str]:
        return [f"i{k}" for k in range(self.ndim)]

    @property
    def cells(self) -> int:
        return prod(self.shape)

    def values(self, v: Column, sparse: bool | None = None) -> GridArray:
        """The same cells with another value."""
        return replace(self, df=self.df.select(*self.index, v.alias("v")), sparse=self.sparse if sparse is None else sparse)

    def dense(self) -> GridArray:
        """The array with a cell for each zero: one join with the grid of indices."""
        if not self.sparse:
            return self
        from gridloom.sources import arrays

        kind = dict(self.df.dtypes)["v"]
        grid = arrays.zeros(self.df.sparkSession, self.shape, kind).df.select(*self.index)
        joined = grid.join(self.df, self.index, "left") if self.index else grid
        return GridArray(joined.select(*self.index, F.coalesce("v", F.lit(0).cast(kind)).alias("v")), self.shape)

    def small(self) -> DataFrame:
        """The cells, marked for broadcast if the shape bounds them."""
        return F.broadcast(self.df) if self.cells <= BROADCAST_CELLS else self.df

    def __add__(self, other):
        from gridloom.operators import elementwise

        return elementwise.add(self, other)

    def __sub__(self, other):
        from gridloom.operators import elementwise

        return elementwise.subtract(self, other)

    def __mul__(self, s):
        from gridloom.operators import elementwise

        return elementwise.broadcast(lambda x, y: x * y, self, s)

    def __truediv__(self, s):
        from gridloom.operators import elementwise

        return elementwise.broadcast(lambda x, y: x / y, self, s)

    def __matmul__(self, other):
        from gridloom.operators import linalg

        return linalg.matmul(self, other)

    @property
    def T(self):  # noqa: N802
        from gridloom.operators import reshape

        return reshape.permute(self, tuple(reversed(range(self.ndim))))

    def collect(self):
        """The array as NumPy; for arrays that fit the driver."""
        import numpy as np

        t = self.df.toArrow()
        out = np.zeros(self.shape, t["v"].to_numpy().dtype)
        if self.ndim == 0:
            return t["v"][0].as_py()
        out[tuple(t[c].to_numpy() for c in self.index)] = t["v"].to_numpy()
        if not self.sparse and t.num_rows != self.cells:
            raise ValueError(f"a dense array of {self.cells} cells has {t.num_rows}")
        return out


@dataclass(frozen=True)
class Domain:
    """Index ranges ``[start, stop)`` of each dimension; pure metadata."""

    ranges: tuple[tuple[int, int], ...]

    def intersect(self, other: Domain) -> Domain:
        return Domain(tuple((max(a, c), max(max(a, c), min(b, d))) for (a, b), (c, d) in zip(self.ranges, other.ranges)))

    def project(self, other: Domain) -> Domain:
        """``other`` in coordinates that start where this domain does."""
        return Domain(tuple((c - a, d - a) for (a, _), (c, d) in zip(self.ranges, other.ranges)))

    def align_first(self) -> Domain:
        return self.project(self)

    def concat(self, other: Domain, dim: int) -> Domain:
        if any(b - a != d - c for k, ((a, b), (c, d)) in enumerate(zip(self.ranges, other.ranges)) if k != dim):
            raise ValueError("sizes differ outside the concatenated dimension")
        (c, d) = other.ranges[dim]
        return Domain(tuple((a, b + d - c) if k == dim else (a, b) for k, (a, b) in enumerate(self.ranges)))

    def reduce(self, dims: tuple[int, ...]) -> Domain:
        return Domain(tuple((0, 1) if k in dims else r for k, r in enumerate(self.ranges)))

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(b - a for a, b in self.ranges)

    def tiles(self, block: tuple[int, ...]) -> list[Domain]:
        """The domain cut in tiles of at most ``block``, row-major."""
        from itertools import product

        cuts = [[(s, min(s + n, b)) for s in range(a, b, n)] for (a, b), n in zip(self.ranges, block)]
        return [Domain(t) for t in product(*cuts)]
