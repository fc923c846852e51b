"""Neighbourhood computation with boundary policies.

The array is first extended by its boundary: for each dimension in turn, the
positions outside it are made of few source positions, a filter and a join with
a table of at most four rows a side and distance.  Named folds then go by tiles:
each cell moves once to its own tile, and those near an edge to the next one too,
where the fold is a few NumPy operations.  Other folds send every cell to the
targets that it neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import GridArray


@dataclass(frozen=True)
class Boundary:
    """Of what an outside position is made: ``sources(p, n)`` gives (position, factor) pairs and a constant.

    ``first_only``: where an earlier dimension is outside too, the edge is
    repeated instead.
    """

    sources: Callable[[int, int], tuple[list[tuple[int, float]], float]]
    first_only: bool = False


def _clamp(p: int, n: int) -> int:
    return min(max(p, 0), n - 1)


def wrap() -> Boundary:
    return Boundary(lambda p, n: ([(p % n, 1.0)], 0.0))


def pad(x: float = 0.0) -> Boundary:
    return Boundary(lambda p, n: ([], x))


def clamp() -> Boundary:
    return Boundary(lambda p, n: ([(_clamp(p, n), 1.0)], 0.0))


def _mirrored(p: int, n: int, repeat_edge: bool) -> int:
    """An outside position's mirror image."""
    if p < 0:
        return -1 - p if repeat_edge else -p
    return 2 * n - 1 - p if repeat_edge else 2 * n - 2 - p


def reflect(repeat_edge: bool = True) -> Boundary:
    return Boundary(lambda p, n: ([(_mirrored(p, n, repeat_edge), 1.0)], 0.0))


def anti_reflect(repeat_edge: bool = True) -> Boundary:
    return Boundary(lambda p, n: ([(_mirrored(p, n, repeat_edge), -1.0)], 0.0))


def extrapolate() -> Boundary:
    def sources(p: int, n: int):
        if n < 2:
            raise ValueError("extrapolation needs two cells")
        edge, inner, k = (0, 1, -p) if p < 0 else (n - 1, n - 2, p - n + 1)
        return [(edge, 1.0 + k), (inner, -float(k))], 0.0

    return Boundary(sources, first_only=True)


def extend(a: GridArray, distance: tuple[int, ...], boundaries: tuple[Boundary, ...]) -> DataFrame:
    """The cells with those outside, at indices from ``-distance`` to ``n + distance - 1``."""
    df = a.df
    for k, (n, d, rule) in enumerate(zip(a.shape, distance, boundaries)):
        if not 0 < d <= n:
            raise ValueError(f"distance {d} in a dimension of {n} cells")
        outside = [*range(-d, 0), *range(n, n + d)]
        made = {p: rule.sources(p, n) for p in outside}
        rows = [(s, p, c, x) for p, (pairs, x) in made.items() for s, c in pairs]
        constants = [(p, x) for p, (pairs, x) in made.items() if not pairs]
        inner = df
        if rule.first_only and k:
            df = df.union(_halo(a, inner.filter(_within(a, k)), k, rows)).union(_halo(a, inner.filter(~_within(a, k)), k, [(_clamp(p, n), p, 1.0, 0.0) for p in outside]))
        elif rows:
            df = df.union(_halo(a, inner, k, rows))
        if constants:
            # One line of cells at index 0, without its values, is where constants stand.
            table = F.broadcast(df.sparkSession.createDataFrame(constants, "p bigint, x double"))
            line = inner.filter(F.col(f"i{k}") == 0).drop("v", f"i{k}").crossJoin(table)  # 2 * distance rows a cell of the line
            df = df.union(line.select(*[F.col("p").alias(c) if c == f"i{k}" else F.col(c) for c in a.index], F.col("x").cast(dict(a.df.dtypes)["v"]).alias("v")))
    return df


def _within(a: GridArray, k: int) -> Column:
    """Whether the dimensions before ``k`` are inside."""
    inside = F.lit(True)
    for j in range(k):
        inside = inside & F.col(f"i{j}").between(0, a.shape[j] - 1)
    return inside


def _halo(a: GridArray, df: DataFrame, k: int, rows: list[tuple]) -> DataFrame:
    kind = dict(a.df.dtypes)["v"]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, f"i{k} bigint, p bigint, c double, x double"))
    met = df.filter(F.col(f"i{k}").isin([r[0] for r in rows])).join(table, f"i{k}")
    others = [c for c in a.index if c != f"i{k}"]
    one = max(sum(1 for r in rows if r[1] == p) for p in {r[1] for r in rows}) == 1
    # A value that is only copied keeps its type's digits and its infinity.
    term = F.when((F.col("c") == 1) & (F.col("x") == 0), F.col("v")) if all(r[2:] == (1.0, 0.0) for r in rows) else F.when((F.col("c") == -1) & (F.col("x") == 0), -F.col("v")) if all(r[2:] == (-1.0, 0.0) for r in rows) else F.col("v") * F.col("c") + F.col("x")
    if one:
        made = met.select(*others, F.col("p").alias(f"i{k}"), term.alias("v"))
    else:
        made = met.groupBy(*others, F.col("p").alias(f"i{k}")).agg(F.sum(term).alias("v"))
    return made.select(*a.index, F.col("v").cast(kind))


def neighbours(a: GridArray, distance, boundaries, fold="sum", f: Callable[[Column], Column] | None = None) -> GridArray:
    """A fold of each cell's ``(2d + 1)**n`` neighbours.

    ``fold`` is sum, prod, min, max, mean, or a function of the array of
    neighbours' values in row-major order of their offsets.
    """
    a = a.dense()
    distance = (distance,) * a.ndim if isinstance(distance, int) else tuple(distance)
    boundaries = (boundaries,) * a.ndim if isinstance(boundaries, Boundary) else tuple(boundaries)
    full = extend(a, distance, boundaries)
    if f is not None:
        full = full.withColumn("v", f(F.col("v")))
    if not callable(fold):
        return _by_tiles(full, a.shape, distance, fold)
    offsets = list(product(*[range(-d, d + 1) for d in distance]))
    sent = F.explode(F.array(*[F.struct(*[(F.col(c) - o).alias(f"t{k}") for k, (c, o) in enumerate(zip(a.index, at))], F.lit(n).alias("o")) for n, at in enumerate(offsets)]))
    inside = F.lit(True)
    for k, n in enumerate(a.shape):
        inside = inside & F.col(f"s.t{k}").between(0, n - 1)
    scattered = full.select(sent.alias("s"), "v").filter(inside)
    keyed = scattered.select(*[F.col(f"s.t{k}").alias(c) for k, c in enumerate(a.index)], F.col("s.o").alias("o"), "v")
    values = F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"])  # (2d + 1)**n values at most
    out = keyed.groupBy(*a.index).agg(values.alias("l")).select(*a.index, fold(F.col("l")).alias("v"))
    return GridArray(out, a.shape)


#: Cells of a tile of a stencil, about.
TILE_CELLS = 1 << 16


def _by_tiles(full: DataFrame, shape: tuple[int, ...], distance: tuple[int, ...], fold: str) -> GridArray:
    """A named fold over cells that have their halo; a task holds one tile with its edges."""
    from functools import reduce

    import numpy as np

    # As Spark's aggregates have it: NaN is greater than any number.
    folds = {"sum": np.add, "mean": np.add, "prod": np.multiply, "min": np.fmin, "max": np.maximum}
    step, index = folds[fold], [f"i{k}" for k in range(len(shape))]
    whole = dict(full.dtypes)["v"] in ("bigint", "int", "smallint", "tinyint")
    out_type = "bigint" if whole and fold == "sum" else dict(full.dtypes)["v"] if fold in ("min", "max") else "double"
    side = round(TILE_CELLS ** (1 / len(shape)))
    block = [max(2 * d, min(n, side)) for n, d in zip(shape, distance)]
    dealt = full
    for k, (c, n, d, size) in enumerate(zip(index, shape, distance, block)):
        low, high = F.greatest(F.col(c) - d, F.lit(0)), F.least(F.col(c) + d, F.lit(n - 1))
        dealt = dealt.withColumn(f"b{k}", F.explode(F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))))

    def run(key, pdf):
        import pandas as pd

        start = [int(b) * size for b, size in zip(key, block)]
        inner = [min(size, n - lo) for size, n, lo in zip(block, shape, start)]
        x = np.zeros([m + 2 * d for m, d in zip(inner, distance)], np.int64 if whole and fold in ("sum", "min", "max") else float)
        x[tuple(pdf[c].to_numpy() - lo + d for c, lo, d in zip(index, start, distance))] = pdf["v"].to_numpy()
        views = [x[tuple(slice(o, o + m) for o, m in zip(at, inner))] for at in product(*[range(2 * d + 1) for d in distance])]
        y = reduce(step, views)
        if fold == "mean":
            y = y / len(views)
        at = np.indices(inner).reshape(len(inner), -1)
        return pd.DataFrame({c: at[k] + start[k] for k, c in enumerate(index)} | {"v": y.ravel()})

    tiles = dealt.groupBy(*[f"b{k}" for k in range(len(shape))])
    return GridArray(tiles.applyInPandas(run, ", ".join(f"{c} bigint" for c in index) + f", v {out_type}"), shape)


def sweep(a: GridArray, *steps: Callable[[GridArray], GridArray]) -> GridArray:
    """Stencil expressions one after the other; each sees the whole result of the one before."""
    for step in steps:
        a = step(a)
    return a


def life_step(a: GridArray) -> GridArray:
    """A generation of the game of life on a torus of 0 and 1."""
    total = neighbours(a, 1, wrap())
    both = total.df.withColumnRenamed("v", "s").join(a.df, a.index)
    alive = (F.col("s") - F.col("v") == 3) | ((F.col("v") == 1) & (F.col("s") - F.col("v") == 2))
    return GridArray(both.select(*a.index, alive.cast(dict(a.df.dtypes)["v"]).alias("v")), a.shape)
