"""Reductions over all or some dimensions, as partial and final aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import GridArray


def _least(v: Column) -> Column:
    """The minimum; NaN if any is NaN, as for IEEE."""
    return F.when(F.bool_or(F.isnan(v.cast("double"))), F.lit(float("nan"))).otherwise(F.min(v))


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "prod": F.product,
    "min": _least,
    "max": F.max,
    "mean": F.avg,
    "var": F.var_samp,
    "std": F.stddev_samp,
    "count": F.count,
    "any": F.bool_or,
    "all": F.bool_and,
    "norm": lambda v: F.sqrt(F.sum(v * v)),
    "extrema": lambda v: F.struct(_least(v).alias("min"), F.max(v).alias("max")),
}
#: How an initial value joins the result; it counts once, however the cells are dealt.
INITIAL = {"sum": lambda x, s: x + s, "prod": lambda x, s: x * s, "min": lambda x, s: F.least(x, F.lit(s)), "max": lambda x, s: F.greatest(x, F.lit(s))}


def _sparse_aggregates(size: int) -> dict[str, Callable[[Column], Column]]:
    """Aggregates over the cells of groups of ``size``, most of them absent zeros."""
    n = F.lit(size)
    zero = lambda v, x, f: F.when(F.count(v) < n, f(x, F.lit(0))).otherwise(x)
    mean = lambda v: F.sum(v) / n
    var = lambda v: F.when(n > 1, (F.sum(v * v) - F.sum(v) * F.sum(v) / n) / (n - 1))
    low, high = lambda v: zero(v, _least(v), F.least), lambda v: zero(v, F.max(v), F.greatest)
    return {
        "prod": lambda v: F.when(F.count(v) < n, F.lit(0.0)).otherwise(F.product(v)),
        "min": lambda v: F.when(F.isnan(_least(v).cast("double")), _least(v)).otherwise(low(v)),
        "max": high,
        "mean": mean,
        "var": var,
        "std": lambda v: F.sqrt(var(v)),
        "extrema": lambda v: F.struct(low(v).alias("min"), high(v).alias("max")),
    }


def reduce(a: GridArray, op: str, dims: tuple[int, ...] | None = None, f: Callable[[Column], Column] | None = None, init=None) -> GridArray:
    """``op`` over ``dims`` (all: a scalar array); reduced dimensions stay with size 1.

    A sparse array's absent zeros count: a group with none of its cells is 0 and
    stays absent.  With ``f`` such an array becomes dense first.  An initial value
    counts once; for extrema it is a (min, max) pair.
    """
    if a.sparse and (f is not None or init is not None or op in ("any", "all")):
        a = a.dense()
    x = F.col("v") if f is None else f(F.col("v"))
    kept = [k for k in range(a.ndim) if dims is not None and k not in dims]
    size = 1
    for k in range(a.ndim):
        size *= 1 if k in kept else a.shape[k]
    known = AGGREGATES | (_sparse_aggregates(size) if a.sparse else {})
    out = known[op](x)
    if init is not None and op == "extrema":
        out = F.struct(F.least(out["min"], F.lit(init[0])).alias("min"), F.greatest(out["max"], F.lit(init[1])).alias("max"))
    elif init is not None:
        out = F.coalesce(INITIAL[op](out, init), F.lit(init))
    if dims is None:
        return GridArray(a.df.agg(out.alias("v")), (), False)
    grouped = a.df.groupBy(*[f"i{k}" for k in kept]).agg(out.alias("v"))
    index = [(F.col(f"i{k}") if k in kept else F.lit(0).cast("bigint")).alias(f"i{k}") for k in range(a.ndim)]
    return GridArray(grouped.select(*index, "v"), tuple(1 if k in dims else n for k, n in enumerate(a.shape)), a.sparse)


def fold(a: GridArray, op: Callable[[Column, Column], Column], zero, dims: tuple[int, ...], f: Callable[[Column], Column] | None = None, run: int = 1024) -> GridArray:
    """An associative ``op`` of two columns over ``f`` of the cells along ``dims``, in index order (row-major); ``zero`` joins once, first.

    Cells are folded in runs of ``run`` neighbours, then the runs' results, and so
    on: each pass is one partial result a run, so no row gathers more than a run,
    however large the group is.
    """
    a = a.dense()
    kept = [k for k in range(a.ndim) if k not in dims]
    place, size = F.lit(0).cast("bigint"), 1
    for k in sorted(dims):
        place, size = place * a.shape[k] + F.col(f"i{k}"), size * a.shape[k]
    df = a.df.select(*[f"i{k}" for k in kept], place.alias("p"), (F.col("v") if f is None else f(F.col("v"))).alias("v"))
    while True:
        last = size <= run
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"])
        keys = [*[f"i{k}" for k in kept], *([] if last else [F.floor(F.col("p") / run).cast("bigint").alias("p")])]
        grouped = df.groupBy(*keys).agg(ordered.alias("l"))
        names = [c for c in grouped.columns if c != "l"]
        # The first value begins a run; ``zero`` joins once, at the end.
        folded = F.aggregate(F.slice("l", 2, run), F.get("l", F.lit(0)), op)
        df = grouped.select(*names, (op(F.lit(zero), folded) if last else folded).alias("v"))
        if last:
            break
        size = -(-size // run)
    index = [(F.col(f"i{k}") if k in kept else F.lit(0).cast("bigint")).alias(f"i{k}") for k in range(a.ndim)]
    return GridArray(df.select(*index, "v"), tuple(1 if k in dims else n for k, n in enumerate(a.shape)))


def is_symmetric(a: GridArray, tolerance: float = 0.0) -> DataFrame:
    from gridloom.operators import elementwise

    return elementwise.equal(a, a.T, tolerance)


def is_finite(a: GridArray) -> DataFrame:
    v = F.col("v").cast("double")
    return a.df.agg(F.coalesce(F.bool_and(~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(True)).alias("finite"))


def triangle(a: GridArray, upper: bool = True) -> GridArray:
    return GridArray(a.df.filter("i0 <= i1" if upper else "i0 >= i1"), a.shape, True)


def histogram(df: DataFrame, bucket: Column) -> DataFrame:
    """Counts by bucket; each task sends one row a bucket."""
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
