"""Tables written to the folder that driver and executors share.

A plan that is used twice, or that grows in a loop, is cut by writing it as
Parquet below ``spark.checkpoint.dir`` and reading it again.  The files outlive
executors, so losing one costs no recomputation and no data.
"""

from __future__ import annotations

import contextvars
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("gridloom_scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables and folders that are made inside are deleted at the end, but for those made with ``keep``.

    For code that has read or written all its results inside, as plans are lazy.
    """
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in made:
            drop(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI: ``spark.checkpoint.dir``, or in local mode a temporary folder.

    Only a local master may fall back to a folder of this machine; elsewhere a
    missing setting is an error, as executors could not see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local") and not master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), f"gridloom-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def fresh_path(spark: SparkSession, what: str, keep: bool = False) -> str:
    """A new path below the shared folder."""
    path, made = f"{shared_dir(spark)}/gridloom/{what}-{uuid.uuid4().hex}", _scratch.get()
    if made is not None and not keep:
        made.append(path)
    return path


def materialize(df: DataFrame, what: str = "table", keep: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again with the same schema."""
    return stored(df, what, keep)[0]


def stored(df: DataFrame, what: str = "table", keep: bool = False) -> tuple[DataFrame, str]:
    """As :func:`materialize`, with the path, for :func:`drop`."""
    spark = df.sparkSession
    path = fresh_path(spark, what, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table or folder below the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
