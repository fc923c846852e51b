"""Streaming regions over Structured Streaming: stages, fan-out, zip, limits and teardown."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.durable import fresh_path


@dataclass(frozen=True)
class Finish:
    """What a stage returns to end its stream, with the stream's result."""

    value: object = None


@dataclass
class Region:
    """Queries that start together when the region ends and are torn down together.

    Sinks are Parquet tables in the shared folder, written once a batch even if
    a batch is retried.  With ``teardown`` leaving the region by an error, or a
    failing or finished query, stops the others.
    """

    spark: SparkSession
    files_per_batch: int = 1
    teardown: bool = True
    waiting: list[tuple[DataFrame, str]] = field(default_factory=list)
    running: list = field(default_factory=list)
    limits: dict[str, int] = field(default_factory=dict)
    finished: dict[str, Finish] = field(default_factory=dict)
    state: dict[str, object] = field(default_factory=dict)

    def __post_init__(self):
        if self.files_per_batch < 1:
            raise ValueError("files_per_batch must be positive")

    def __enter__(self) -> Region:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.start()
        elif self.teardown:
            self.stop()

    def source(self, path: str, schema) -> DataFrame:
        """A stream of a folder's Parquet files; the files a batch are the back-pressure."""
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(path)

    def sink(self, stream: DataFrame, max_evals: int | None = None) -> str:
        """The path at which the stream's rows will be; at most ``max_evals`` of them."""
        if max_evals is not None and max_evals < 1:
            raise ValueError("max_evals must be positive")
        path = fresh_path(self.spark, "stream")
        if max_evals is not None:
            self.limits[path] = max_evals
        self.waiting.append((stream, path))
        return path

    def start(self) -> None:
        for stream, path in self.waiting:
            out = stream.limit(self.limits[path]) if path in self.limits else stream
            writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}.state").outputMode("append")
            self.running.append(writer.trigger(availableNow=True).start())
        self.waiting = []

    def each(self, stream: DataFrame, f: Callable, state: object = None) -> str:
        """Call ``f(batch, number)`` on the driver for every batch, until it returns True or a :class:`Finish`; the stage's name.

        With a ``state`` it is ``f(batch, number, state)``, and what a call returns
        beside a Finish is the next call's state.
        """
        where = fresh_path(self.spark, "stream")
        self.state[where] = state

        def step(batch: DataFrame, number: int) -> None:
            if where in self.finished:
                return
            found = f(batch, number) if state is None else f(batch, number, self.state[where])
            if found is True or isinstance(found, Finish):
                self.finished[where] = found if isinstance(found, Finish) else Finish()
            elif state is not None:
                self.state[where] = found

        self.running.append(stream.writeStream.queryName(where.rsplit("/", 1)[-1]).foreachBatch(step).option("checkpointLocation", f"{where}.state").trigger(availableNow=True).start())
        return where

    def result(self, stage: str):
        """What the stage finished with; None if its stream came to its end."""
        return self.finished[stage].value if stage in self.finished else None

    def wait(self, seconds: int = 120) -> None:
        """Until all queries end; a failure is raised, and tears the others down.  A finished stage's query is stopped."""
        from time import monotonic

        until = monotonic() + seconds
        try:
            while active := [q for q in self.running if not q.awaitTermination(0.05)]:
                if monotonic() > until:
                    raise TimeoutError("a stream didn't end in time")
                for q in active:
                    if any(w.rsplit("/", 1)[-1] == q.name for w in self.finished):
                        q.stop()
        except BaseException:
            if self.teardown:
                self.stop()
            raise

    def stop(self) -> None:
        for q in self.running:
            if q.isActive:
                q.stop()

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)


def zip_streams(a: DataFrame, b: DataFrame, seq: str, ts: str, bound: str = "1 hour") -> DataFrame:
    """Rows of two streams with the same sequence number; event time bounds what is kept waiting."""
    left = a.withWatermark(ts, bound).alias("a")
    right = b.withWatermark(ts, bound).alias("b")
    near = F.expr(f"a.{seq} = b.{seq} AND b.{ts} BETWEEN a.{ts} - INTERVAL {bound} AND a.{ts} + INTERVAL {bound}")
    return left.join(right, near)


def windowed(stream: DataFrame, ts: str, width: str, late: str, *aggregates) -> DataFrame:
    """Aggregates of tumbling windows, closed once the watermark has passed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(*aggregates)
