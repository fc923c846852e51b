"""Row-wise functions over Arrow batches, and files in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows that are Python values at once.
SLICE_ROWS = 512


def map_rows(df: DataFrame, fn: Callable, schema: str, rows: Callable | None = None) -> DataFrame:
    """Rows that the generator ``fn(*row)`` yields as tuples of ``schema``, for each row of ``df``.

    ``rows`` makes the tuples that ``fn`` gets from the batches, instead of ``rows_of``.

    Rows leave in batches of bounded size, so a task holds one batch of input
    and one of output, whatever its partition's size.
    """
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in (rows or rows_of)(batches):
            out.extend(fn(*row))
            if len(out) >= 4096:
                yield to_batch(out, target)
                out = []
        if out:
            yield to_batch(out, target)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """A DDL schema as Arrow's; for the driver, which knows DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Tuples as one Arrow batch."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The tuples of Arrow batches, in order; only a slice of a batch is held as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns])


def text_or_empty(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def file_system(uri: str):
    """The file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, *parts) -> None:
    """Write a whole file, its parts one after another, under a name of its own, then give it its final name.

    Attempts of one task use different names, so none reads or overwrites
    another's half-written file.  Until it is whole, a file's name starts with
    ``_``, which Spark's readers of the folder skip.
    """
    system, path = file_system(uri)
    folder, _, name = path.rpartition("/")
    own = f"{folder}/_{name}.part"
    with system.open_output_stream(own, compression=None) as out:
        for x in parts:
            out.write(x)
    system.move(own, path)


def make_dir(uri: str) -> None:
    system, path = file_system(uri)
    system.create_dir(path, recursive=True)
