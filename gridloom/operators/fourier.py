"""Fourier transforms of complex arrays (columns re and im) along one dimension after the other."""

from __future__ import annotations

from math import isqrt, pi, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import GridArray
from gridloom.plans.durable import materialize

#: Cells that one task transforms at once: many short lines, or one long one.
LINE_CELLS = 1 << 20


def complex_cells(a: GridArray) -> DataFrame:
    return a.dense().df.select(*a.index, F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))


def _lines(df: DataFrame, axis: str, n: int, others: list[str], sizes: list[int], inverse: bool, line_cells: int) -> DataFrame:
    """The transform of each line along ``axis``; lines go to tasks in groups of bounded size."""
    place = F.lit(0).cast("bigint")
    for c, size in zip(others, sizes):
        place = place * size + F.col(c)
    held = max(1, line_cells // n)
    grouped = df.withColumn("_line", place).groupBy(F.floor(F.col("_line") / held))

    def run(pdf):
        import numpy as np

        first = pdf.drop_duplicates("_line")
        names, line = np.unique(pdf["_line"], return_inverse=True)
        x = np.zeros((len(names), n), complex)
        x[line, pdf[axis]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = np.fft.ifft(x, axis=1) if inverse else np.fft.fft(x, axis=1)
        out = first.sort_values("_line").loc[lambda d: d.index.repeat(n)].drop(columns="_line")
        out[axis], out["re"], out["im"] = np.tile(np.arange(n), len(names)), y.real.ravel(), y.imag.ravel()
        return out

    return grouped.applyInPandas(run, ", ".join(f"{c} {t}" for c, t in df.dtypes))


def _turned(df: DataFrame, angle: Column, scale: float = 1.0) -> DataFrame:
    """Cells times ``scale * exp(i * angle)``."""
    c, s = F.cos(angle) * scale, F.sin(angle) * scale
    return df.withColumns({"re": F.col("re") * c - F.col("im") * s, "im": F.col("re") * s + F.col("im") * c})


def _axis(df: DataFrame, axis: str, n: int, others: list[str], sizes: list[int], inverse: bool, line_cells: int) -> DataFrame:
    """The transform along one dimension.

    A line beyond ``line_cells`` is laid out as a matrix, transformed along one
    side, turned, and transformed along the other, so no task holds it.  Where its
    length has no such sides, it becomes a convolution with a chirp, of a length
    that is a power of two.
    """
    if n <= line_cells:
        return _lines(df, axis, n, others, sizes, inverse, line_cells)
    sign = 2 * pi / n * (1 if inverse else -1)
    low = next((d for d in range(isqrt(n), 0, -1) if n % d == 0))
    if n // low <= line_cells:
        high = n // low
        # i = a * low + b and k = c + high * d, with a, c below high and b, d below low.
        laid = df.withColumns({"_a": F.floor(F.col(axis) / low).cast("bigint"), "_b": F.col(axis) % low}).drop(axis)
        made = _lines(laid, "_a", high, [*others, "_b"], [*sizes, low], inverse, line_cells)
        made = _turned(made, F.col("_a") * F.col("_b") % n * sign)
        made = _lines(made, "_b", low, [*others, "_a"], [*sizes, high], inverse, line_cells)
        return made.withColumn(axis, F.col("_a") + high * F.col("_b")).select(*df.columns)
    # Bluestein: i * k = (i**2 + k**2 - (k - i)**2) / 2.
    m = 1 << (2 * n - 2).bit_length()
    square = lambda c: c * c % (2 * n) * (sign / 2)
    spark = df.sparkSession
    own = _turned(df, square(F.col(axis)))
    chirp = spark.range(m).select(F.col("id").alias(axis), F.lit(1.0).alias("re"), F.lit(0.0).alias("im")).filter((F.col(axis) < n) | (F.col(axis) > m - n))
    away = F.least(F.col(axis), m - F.col(axis))
    chirp = materialize(_axis(_turned(chirp, -square(away)), axis, m, [], [], False, line_cells), "chirp")
    there = _axis(own, axis, m, others, sizes, False, line_cells)
    both = there.join(chirp.select(axis, F.col("re").alias("_r"), F.col("im").alias("_i")), axis)
    product = both.withColumns({"re": F.col("re") * F.col("_r") - F.col("im") * F.col("_i"), "im": F.col("re") * F.col("_i") + F.col("im") * F.col("_r")}).select(*df.columns)
    back = _axis(product, axis, m, others, sizes, True, line_cells).filter(F.col(axis) < n)
    return _turned(back, square(F.col(axis)), 1 / n if inverse else 1.0)


def transform(df: DataFrame, shape: tuple[int, ...], dims: tuple[int, ...] | None = None, inverse: bool = False, line_cells: int = LINE_CELLS) -> DataFrame:
    """FFT (or its inverse) over ``dims``, all by default; each dimension is one shuffle, two for a line that no task may hold."""
    if not prod(shape):
        return df
    index = [f"i{k}" for k in range(len(shape))]
    for k in range(len(shape)) if dims is None else dims:
        others = [c for c in index if c != f"i{k}"]
        df = _axis(df, f"i{k}", shape[k], others, [shape[int(c[1:])] for c in others], inverse, line_cells).select(*index, "re", "im")
    return df
