"""Dense factorisations over rows: panels of bounded size, everything else distributed.

A matrix is a table ``i0, x``: one row of doubles for each row.  A step takes a
panel of columns, as many as make ``PANEL_CELLS`` cells at most, to the driver,
factors it there, and sends the factors back in a broadcast of the same bound;
all other columns are updated by a map over the rows, without a shuffle.  A
matrix that is one panel is one step; there is no size beyond which it fails but
that of a row.  Tall matrices go by a tree of QR factorisations, in which a task
holds a block of rows and n by n factors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import GridArray
from gridloom.plans.durable import materialize

#: Cells of a panel: what the driver factors at once and what a broadcast holds.
PANEL_CELLS = 4_000_000
#: Rows that one leaf of the QR tree factors, and nodes that meet in one above.
LEAF_ROWS, FAN_IN = 4096, 8
ROW = "i0 bigint, x array<double>"


def to_rows(a: GridArray) -> DataFrame:
    """A matrix's rows as arrays; absent cells are 0 and absent rows are there."""
    n = a.shape[1]
    grouped = a.df.groupBy("i0").agg(F.collect_list(F.col("i1").cast("int")).alias("j"), F.collect_list(F.col("v").cast("double")).alias("v"))
    if a.sparse:
        grouped = a.df.sparkSession.range(a.shape[0]).withColumnRenamed("id", "i0").join(grouped, "i0", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j, v = batch.column(1), batch.column(2)
            x = np.zeros((batch.num_rows, n))
            row = np.repeat(np.arange(batch.num_rows), j.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            x[row, j.flatten().to_numpy()] = v.flatten().to_numpy()
            yield _batch(batch.column(0), x)

    return grouped.mapInArrow(run, ROW)


def _batch(index, x: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x, float).ravel()))], names=["i0", "x"])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), n)


def to_cells(rows: DataFrame, shape: tuple[int, int]) -> GridArray:
    return GridArray(rows.select("i0", F.posexplode("x").alias("i1", "v")).select("i0", F.col("i1").cast("bigint").alias("i1"), "v"), shape)


def map_rows(rows: DataFrame, n: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``f(indices, rows of n)`` batch by batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                i = batch.column(0).to_numpy()
                yield _batch(i, f(i, _matrix(batch.column(1), n).copy()))

    return rows.mapInArrow(run, ROW)


def panel(rows: DataFrame, lo: int, hi: int, only=None) -> tuple[np.ndarray, np.ndarray]:
    """Columns ``lo`` to ``hi`` of the rows (for which ``only`` holds), sorted by index; of checked size by its callers."""
    found = rows if only is None else rows.filter(only)
    t = found.select("i0", F.slice("x", lo + 1, hi - lo).alias("x")).toArrow()
    i = t["i0"].to_numpy()
    order = np.argsort(i)
    return i[order], _matrix(t["x"].combine_chunks(), hi - lo)[order]


def width(m: int, n: int) -> int:
    """Columns of a panel over ``m`` rows, such that the panel and as many rows of ``n`` columns are bounded."""
    return max(1, min(n, PANEL_CELLS // max(1, m, n)))


def _positive(x: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.cholesky(x)
    except np.linalg.LinAlgError:
        raise np.linalg.LinAlgError("the matrix is not positive definite") from None


def cholesky(rows: DataFrame, n: int, block: int | None = None) -> DataFrame:
    """The lower factor's rows.  Right-looking: a step takes the panel, and every row subtracts its product with it."""
    spark, b, state = rows.sparkSession, block or width(n, n), rows
    for lo in range(0, n, b):
        hi = min(n, lo + b)
        i, x = panel(state, lo, hi, F.col("i0") >= lo)
        x[: hi - lo] = np.tril(_positive(x[: hi - lo]))
        if hi < n:
            x[hi - lo :] = np.linalg.solve(x[: hi - lo], x[hi - lo :].T).T
        held = spark.sparkContext.broadcast((lo, hi, x))

        def step(index, row, held=held):
            lo, hi, f = held.value
            mine = index >= lo
            row[mine, lo:hi] = f[index[mine] - lo]
            row[mine, hi:] -= row[mine, lo:hi] @ f[hi - lo :].T
            row[~mine, lo:hi] = 0
            return row

        state = materialize(map_rows(state, n, step), "cholesky")
    return map_rows(state, n, lambda i, x: np.where(np.arange(n) <= i[:, None], x, 0.0))


def lu(rows: DataFrame, m: int, n: int, pivot: bool = True, block: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Rows of the packed factors in pivot order, and that order (``order[k]``: the row at place k).

    Pivots are the largest of a column, of equals the first in the present order;
    without ``pivot`` rows keep their places.  A zero pivot is an error.
    """
    spark, b, state, order = rows.sparkSession, block or width(m, n), rows, np.arange(m)
    for lo in range(0, min(m, n), b):
        hi = min(m, n, lo + b)
        i, x = panel(state, lo, hi)
        x = x[np.argsort(i)][order[lo:]]
        rest = order[lo:].copy()
        for k in range(hi - lo):
            p = k + int(np.argmax(np.abs(x[k:, k]))) if pivot else k
            if x[p, k] == 0:
                raise np.linalg.LinAlgError("singular matrix")
            x[[k, p]], rest[[k, p]] = x[[p, k]], rest[[p, k]]
            x[k + 1 :, k] /= x[k, k]
            x[k + 1 :, k + 1 :] -= np.outer(x[k + 1 :, k], x[k, k + 1 :])
        order[lo:] = rest
        top = np.tril(x[: hi - lo], -1) + np.eye(hi - lo)
        upper = np.empty((hi - lo, n - hi))
        if hi < n:  # the pivot rows' other columns: at most a panel's cells
            j, y = panel(state, hi, n, F.col("i0").isin([int(r) for r in rest[: hi - lo]]))
            upper = np.linalg.solve(top, y[np.argsort(np.argsort(rest[: hi - lo]))])
        place = np.full(m, -1)
        place[rest] = np.arange(len(rest))
        held = spark.sparkContext.broadcast((lo, hi, x, upper, place))

        def step(index, row, held=held):
            lo, hi, f, upper, place = held.value
            at = place[index]
            mine, pivots = at >= 0, (at >= 0) & (at < hi - lo)
            row[mine, lo:hi] = f[at[mine]]
            below = mine & ~pivots
            row[below, hi:] -= row[below, lo:hi] @ upper
            row[pivots, hi:] = upper[at[pivots]]
            return row

        state = materialize(map_rows(state, n, step), "lu")
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    held = spark.sparkContext.broadcast(place)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(held.value[batch.column(0).to_numpy()]), batch.column(1)], names=["i0", "x"])

    return state.mapInArrow(run, ROW), order


def triangular_solve(rows: DataFrame, n: int, right: DataFrame, r: int, upper: bool, unit: bool = False, block: int | None = None) -> DataFrame:
    """Rows of ``x`` with ``t @ x = b`` for a triangular ``t``: substitution by blocks of rows, as many as a panel of t and b holds."""
    spark, b = rows.sparkSession, block or max(1, min(n, PANEL_CELLS // max(n, r)))
    joined = rows.join(right.withColumnRenamed("x", "b"), "i0").select("i0", F.concat("x", "b").alias("x"))
    state = joined
    cuts = [(lo, min(n, lo + b)) for lo in range(0, n, b)]
    for lo, hi in reversed(cuts) if upper else cuts:
        inside = (F.col("i0") >= lo) & (F.col("i0") < hi)
        _, t = panel(state, lo, hi, inside)
        _, y = panel(state, n, n + r, inside)
        t = np.triu(t) if upper else np.tril(t)
        if unit:
            t = t - np.diag(np.diag(t)) + np.eye(len(t))
        if not np.all(np.diag(t)):
            raise np.linalg.LinAlgError("singular triangle")
        x = np.linalg.solve(t, y)
        held = spark.sparkContext.broadcast((lo, hi, x))

        def step(index, row, held=held):
            lo, hi, x = held.value
            own = (index >= lo) & (index < hi)
            later = index < lo if upper else index >= hi
            row[own, n:] = x[index[own] - lo]
            row[later, n:] -= row[later, lo:hi] @ x
            return row

        state = materialize(map_rows(state, n + r, step), "solve")
    return state.select("i0", F.slice("x", n + 1, r).alias("x"))


def gram_parts(left: DataFrame, m: int, right: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """``k, j, v`` of ``left.T @ right`` (m by n), summed up from one partial product a task."""
    both = left if right is None else left.join(right.withColumnRenamed("x", "y"), "i0").select("i0", F.concat("x", "y").alias("x"))
    alone = right is None
    wide, n = (m, m) if alone else (m + n, n)

    def run(batches):
        total = np.zeros((m, n))
        for batch in batches:
            x = _matrix(batch.column(1), wide)
            total += x[:, :m].T @ (x if alone else x[:, m:])
        yield _batch(np.arange(m), total).rename_columns(["k", "x"])

    parts = both.mapInArrow(run, "k bigint, x array<double>")
    return parts.select("k", F.posexplode("x").alias("j", "v")).groupBy("k", "j").agg(F.sum("v").alias("v"))


def gram(left: DataFrame, m: int, right: DataFrame, n: int) -> np.ndarray:
    """:func:`gram_parts` as a matrix in the driver, of checked size by its callers."""
    t = gram_parts(left, m, right, n).toArrow()
    out = np.zeros((m, n))
    out[t["k"].to_numpy(), t["j"].to_numpy()] = t["v"].to_numpy()
    return out


def tsqr(rows: DataFrame, n: int, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> tuple[DataFrame, np.ndarray]:
    """``q`` rows and ``r`` (n by n, diagonal not negative) of a matrix with at least n rows, whatever its rank.

    Leaves are blocks of rows.  Their factors are factored again, ``fan_in`` at
    once, up to the root; on the way back each block's q is multiplied by its part
    of the q above.  No task holds more than a block and ``fan_in`` n by n factors.
    """
    spark = rows.sparkSession
    numbered = "leaf bigint, i0 bigint, x array<double>"

    def deal(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        held_i, held_x, size = [], [], 0

        def leaf():
            nonlocal at, held_i, held_x, size
            i, x = np.concatenate(held_i), np.concatenate(held_x)
            q, r = np.linalg.qr(x)  # fewer rows than n give a wide r
            key = np.int64(part << 32 | at)
            at, held_i, held_x, size = at + 1, [], [], 0
            pad = np.zeros((len(q), n))
            pad[:, : q.shape[1]] = q
            up = np.zeros((n, n))
            up[: len(r)] = r
            yield _leaf(key, np.concatenate([i, -1 - np.arange(n)]), np.concatenate([pad, up]))

        for batch in batches:
            i, x = batch.column(0).to_numpy(), _matrix(batch.column(1), n)
            for lo in range(0, len(i), leaf_rows):
                held_i.append(i[lo : lo + leaf_rows])
                held_x.append(x[lo : lo + leaf_rows])
                size += len(held_i[-1])
                if size >= max(n, leaf_rows):
                    yield from leaf()
        if size:
            yield from leaf()

    made = materialize(rows.mapInArrow(deal, numbered), "tsqr")
    level = made.filter("i0 < 0").select("leaf", (-1 - F.col("i0")).alias("k"), "x")
    leaves = level.select("leaf").distinct()
    from gridloom.operators.sorting import dense_positions

    names = dense_positions(leaves, [F.col("leaf")]).select("leaf", F.col("position").alias("node"))
    names = materialize(names, "tsqr-leaves")
    level, count, steps = level.join(names, "leaf").select("node", "k", "x"), names.count(), []
    blocks = "node bigint, part bigint, k bigint, x array<double>"

    def climb(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["node", "k"])
        q, r = np.linalg.qr(np.stack(pdf["x"].to_numpy()))
        sign = np.where(np.diag(r) < 0, -1.0, 1.0)
        q, r = q * sign, r * sign[:, None]
        own = pd.DataFrame({"node": pdf["node"].to_numpy(), "part": 0, "k": pdf["k"].to_numpy(), "x": list(q)})
        return pd.concat([own, pd.DataFrame({"node": int(key[0]), "part": 1, "k": np.arange(n), "x": list(r)})])

    while True:
        done = materialize(level.groupBy(F.floor(F.col("node") / fan_in).cast("bigint")).applyInPandas(climb, blocks), "tsqr")
        steps.append(done.filter("part = 0").select("node", "k", "x"))
        level, count = done.filter("part = 1").select("node", "k", "x"), -(-count // fan_in)
        if count == 1:
            break
    root = level.toArrow()
    r = _matrix(root["x"].combine_chunks(), n)[np.argsort(root["k"].to_numpy())]

    def descend(key, own, above):
        import pandas as pd

        if not len(own):
            return pd.DataFrame({"node": [], "k": [], "x": []})
        x = np.stack(own["x"].to_numpy()) @ np.stack(above.sort_values("k")["x"].to_numpy())
        return pd.DataFrame({"node": own["node"], "k": own["k"], "x": list(x)})

    factor = steps[-1]
    for below in reversed(steps[:-1]):
        keyed = below.groupBy(F.floor(F.col("node") / fan_in).cast("bigint").alias("g"))
        factor = materialize(keyed.cogroup(factor.groupBy(F.col("node").alias("g"))).applyInPandas(descend, "node bigint, k bigint, x array<double>"), "tsqr")

    def finish(key, own, above):
        import pandas as pd

        if not len(own):
            return pd.DataFrame({"i0": [], "x": []})
        return pd.DataFrame({"i0": own["i0"], "x": list(np.stack(own["x"].to_numpy()) @ np.stack(above.sort_values("k")["x"].to_numpy()))})

    q = made.filter("i0 >= 0").join(names, "leaf").groupBy("node").cogroup(factor.groupBy("node")).applyInPandas(finish, ROW)
    return q, np.triu(r)


def _leaf(key, index, x: np.ndarray) -> pa.RecordBatch:
    batch = _batch(index, x)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), key, np.int64)), *batch.columns], names=["leaf", "i0", "x"])


def from_matrix(spark, x: np.ndarray) -> DataFrame:
    """A driver's matrix of bounded size as rows."""
    return spark.createDataFrame(pa.Table.from_batches([_batch(np.arange(len(x)), x)]))
