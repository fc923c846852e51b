"""Random values as expressions of a cell's index, the same for any partitioning."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(index: list[str], seed: int, stream: int = 0) -> Column:
    """U[0, 1) from a hash of seed and index."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *index), 11)
    return bits.cast("double") / float(1 << 53)


def normal(index: list[str], seed: int) -> Column:
    """N(0, 1) by Box and Muller from two uniforms."""
    return F.sqrt(-2 * F.log(1 - uniform(index, seed, 1))) * F.cos(2 * pi * uniform(index, seed, 2))


def sampler(kind: str, index: list[str], seed: int, a: float = 0.0, b: float = 1.0) -> Column:
    """uniform(a, b), normal(mean a, deviation b), exponential(scale b), laplace(place a, scale b)."""
    u = uniform(index, seed)
    if kind == "uniform":
        return a + (b - a) * u
    if kind == "normal":
        return a + b * normal(index, seed)
    if kind == "exponential":
        return -b * F.log(1 - u)
    if kind == "laplace":
        c = u - 0.5
        return a - b * F.signum(c) * F.log(F.greatest(1 - 2 * F.abs(c), F.lit(1e-300)))
    raise ValueError(f"no sampler {kind}")
