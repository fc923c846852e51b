"""Arrays from constants, hashes, NumPy, columns and files; and back to files."""

from __future__ import annotations

from collections.abc import Callable
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import random
from gridloom.model import GridArray


def allocate(spark: SparkSession, shape: tuple[int, ...], value: Callable[[list[str]], Column]) -> GridArray:
    """A dense array whose cells are an expression of their index; cells are numbered row-major and never meet a shuffle."""
    index = [f"i{k}" for k in range(len(shape))]
    cell, place = F.col("id"), []
    for k in range(len(shape)):
        below = prod(shape[k + 1 :])
        place.append(F.pmod(F.floor(cell / below) if below > 1 else cell, F.lit(shape[k])).cast("bigint").alias(index[k]))
    df = spark.range(prod(shape)).select(*place)
    return GridArray(df.select(*index, value(index).alias("v")), tuple(shape))


def full(spark: SparkSession, shape: tuple[int, ...], x: float, dtype: str = "double") -> GridArray:
    return allocate(spark, shape, lambda _: F.lit(x).cast(dtype))


def zeros(spark: SparkSession, shape: tuple[int, ...], dtype: str = "double") -> GridArray:
    return full(spark, shape, 0, dtype)


def ones(spark: SparkSession, shape: tuple[int, ...], dtype: str = "double") -> GridArray:
    return full(spark, shape, 1, dtype)


def zeros_like(a: GridArray) -> GridArray:
    return a.values(F.lit(0).cast(dict(a.df.dtypes)["v"]))


def rand(spark: SparkSession, shape: tuple[int, ...], seed: int = 0) -> GridArray:
    return allocate(spark, shape, lambda i: random.uniform(i, seed))


def randn(spark: SparkSession, shape: tuple[int, ...], seed: int = 0) -> GridArray:
    return allocate(spark, shape, lambda i: random.normal(i, seed))


def sprand(spark: SparkSession, shape: tuple[int, ...], density: float, seed: int = 0) -> GridArray:
    """Sparse uniforms: a cell is present with probability ``density``."""
    a = rand(spark, shape, seed)
    return GridArray(a.df.filter(random.uniform(a.index, seed, 7) < density), a.shape, True)


def refill(a: GridArray, kind: str, seed: int = 0, low: float = 0.0, high: float = 1.0) -> GridArray:
    """The array with new random values."""
    return a.values(random.sampler(kind, a.index, seed, low, high))


def eye(spark: SparkSession, n: int, m: int | None = None) -> GridArray:
    """The identity, sparse."""
    m = m or n
    return GridArray(spark.range(min(n, m)).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(1.0).alias("v")), (n, m), True)


def from_numpy(spark: SparkSession, x) -> GridArray:
    """A driver's array, dealt to the cluster."""
    import numpy as np
    import pyarrow as pa

    x = np.asarray(x)
    at = np.indices(x.shape).reshape(x.ndim, -1)
    columns = {f"i{k}": at[k].astype(np.int64) for k in range(x.ndim)} | {"v": x.ravel()}
    return GridArray(spark.createDataFrame(pa.table(columns)), x.shape)


def from_array_column(df: DataFrame, row: str, column: str, shape: tuple[int, int]) -> GridArray:
    """A matrix from rows with a dense index and an array of equal length."""
    cells = df.select(F.col(row).cast("bigint").alias("i0"), F.posexplode(column).alias("p", "x"))
    return GridArray(cells.select("i0", F.col("p").cast("bigint").alias("i1"), F.col("x").cast("double").alias("v")), shape)


def from_columns(df: DataFrame, index: list[str], value: str, shape: tuple[int, ...], sparse: bool = False) -> GridArray:
    cells = df.select(*[F.col(c).cast("bigint").alias(f"i{k}") for k, c in enumerate(index)], F.col(value).alias("v"))
    return GridArray(cells, shape, sparse)


def tiles(a: GridArray, block: tuple[int, ...]) -> DataFrame:
    """Cells with their tile ``b0..`` and place in it, dealt by tile."""
    keyed = a.df.select("*", *[F.floor(F.col(c) / n).cast("int").alias(f"b{k}") for k, (c, n) in enumerate(zip(a.index, block))])
    return keyed.repartition(*[f"b{k}" for k in range(a.ndim)])


def assign(a: GridArray, block: tuple[int, ...], how: str, parts: int) -> DataFrame:
    """Tiles dealt to ``parts`` partitions by rows or columns of tiles, in equal blocks or in turn; partition k gets what is dealt to k."""
    keyed = a.df.select("*", *[F.floor(F.col(c) / n).cast("int").alias(f"b{k}") for k, (c, n) in enumerate(zip(a.index, block))])
    kinds = {"blockrow": 0, "blockcol": 1, "cyclicrow": 0, "cycliccol": 1}
    if how == "arbitrary":
        return keyed.repartition(*[f"b{k}" for k in range(a.ndim)])
    if how not in kinds:
        raise ValueError(f"no assignment {how}")
    k = kinds[how]
    tiles_there = -(-a.shape[k] // block[k])
    to = F.floor(F.col(f"b{k}") * parts / tiles_there) if how.startswith("block") else F.col(f"b{k}") % parts
    return keyed.repartitionById(parts, to.cast("int"))


def save(a: GridArray, path: str) -> None:
    """Cells as Parquet; shape and kind go beside them."""
    spark = a.df.sparkSession
    a.df.write.parquet(path)
    spark.createDataFrame([(list(a.shape), a.sparse)], "shape array<bigint>, sparse boolean").coalesce(1).write.json(f"{path}.shape")


def load(spark: SparkSession, path: str) -> GridArray:
    head = spark.read.schema("shape array<bigint>, sparse boolean").json(f"{path}.shape").first()
    return GridArray(spark.read.parquet(path), tuple(head.shape), head.sparse)


def read_table(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """A table from csv, json, parquet, orc or text files, or an Arrow IPC file."""
    if kind == "arrow":
        import pyarrow as pa

        def rows(batches):
            for batch in batches:
                for content in batch.column(0).to_pylist():
                    yield from pa.ipc.open_file(pa.BufferReader(content))

        files = spark.read.format("binaryFile").load(path).select("content")

        def schema(batches):  # one file's, read by its executor
            for batch in batches:
                for content in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([pa.ipc.open_file(pa.BufferReader(content)).schema.serialize().to_pybytes()])], names=["schema"])

        from pyspark.sql.pandas.types import from_arrow_schema

        first = files.limit(1).mapInArrow(schema, "schema binary").first()
        if first is None:
            raise FileNotFoundError(f"no file in {path}")
        return files.mapInArrow(rows, from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(first.schema))))
    return spark.read.format(kind).options(**options).load(path)
