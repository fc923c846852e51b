"""Distributed sort with dense ranks: ranges of sampled keys, then local sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import GridArray
from gridloom.plans.durable import materialize


def dense_positions(df: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """``df`` in global order of ``keys`` with dense 0-based positions.

    Rows are dealt by ranges and sorted in them; a running sum over one count a
    range gives each its start.  No task sees more than its range.
    """
    order = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(order.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = part.groupBy("_part").count()
    starts = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return part.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_at", "_part", "_row", "_start")


def sort(a: GridArray, by=None, reverse: bool = False) -> GridArray:
    """A vector in order of ``by(v)``; equal keys keep their order, so the sort is stable."""
    if a.ndim != 1:
        raise ValueError("only vectors are sorted")
    a = a.dense()
    key = F.col("v") if by is None else by(F.col("v"))
    done = dense_positions(a.df.withColumn("_k", key), [F.desc("_k") if reverse else F.asc("_k"), F.asc("i0")])
    return GridArray(done.select(F.col("position").alias("i0"), "v"), a.shape)
