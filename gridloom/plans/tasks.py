"""Driver-side tasks around Spark jobs: futures, queues, cancellation, options, restore."""

from __future__ import annotations

import contextvars
import threading
import time
import uuid
from collections.abc import Callable
from concurrent import futures
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_options: contextvars.ContextVar[dict] = contextvars.ContextVar("gridloom_options", default={})


_current: contextvars.ContextVar[Task | None] = contextvars.ContextVar("gridloom_task", default=None)


def current_task() -> Task | None:
    """The task that this code runs in."""
    return _current.get()


class TaskFailed(RuntimeError):
    """A task failed, or one that it needs did; the cause is the root."""


@contextmanager
def with_options(**values):
    """Options that tasks spawned inside see, at any depth.

    ``pool`` is the fair scheduler's pool and ``description`` the text of the
    task's Spark jobs, and ``tags`` are tags of theirs; other options are for the
    tasks to read.
    """
    token = _options.set(_options.get() | values)
    try:
        yield
    finally:
        _options.reset(token)


def get_options() -> dict:
    return dict(_options.get())


class Task:
    """A future whose Spark jobs carry a tag, so that they can be cancelled."""

    def __init__(self, pool: Tasks, f: Callable, args: tuple, kwargs: dict):
        self.tag = f"task-{uuid.uuid4().hex}"
        self.cancelled = threading.Event()
        self.pool = pool
        context = contextvars.copy_context()
        self.future = pool.threads.submit(context.run, self._run, f, args, kwargs)

    def _run(self, f, args, kwargs):
        try:
            args = [a.future.result() if isinstance(a, Task) else a for a in args]
            kwargs = {k: a.future.result() if isinstance(a, Task) else a for k, a in kwargs.items()}
        except BaseException as e:
            raise TaskFailed("a task that this one needs failed") from root(e)
        if self.cancelled.is_set():
            raise TaskFailed("cancelled")
        spark, options = self.pool.spark, get_options()
        tags = [self.tag, *options.get("tags", ())]
        local = {"spark.scheduler.pool": options.get("pool"), "spark.job.description": options.get("description")}
        for t in tags:
            spark.sparkContext.addJobTag(t)
        for key, value in local.items():
            spark.sparkContext.setLocalProperty(key, value)
        token = _current.set(self)
        self.pool.log("start", self)
        try:
            return f(*args, **kwargs)
        finally:
            self.pool.log("end", self)
            _current.reset(token)
            for key in local:
                spark.sparkContext.setLocalProperty(key, None)
            for t in tags:
                spark.sparkContext.removeJobTag(t)

    def fetch(self, timeout: float | None = None):
        try:
            return self.future.result(timeout)
        except futures.TimeoutError:
            raise
        except BaseException as e:
            raise TaskFailed(str(root(e))) from root(e)

    def wait(self, timeout: float | None = None) -> bool:
        """Whether the task has ended; its error shows in :meth:`fetch` only."""
        return bool(futures.wait([self.future], timeout).done)

    def cancel(self) -> None:
        self.cancelled.set()
        self.future.cancel()
        self.pool.spark.sparkContext.cancelJobsWithTag(self.tag)


def root(e: BaseException) -> BaseException:
    while e.__cause__ is not None:
        e = e.__cause__
    return e


class Tasks:
    """A pool of driver threads; independent tasks' jobs run side by side."""

    def __init__(self, spark: SparkSession, width: int = 8):
        self.spark, self.threads, self.all = spark, futures.ThreadPoolExecutor(width), []
        #: ``(seconds, event, tag)`` of each task's spawn, start and end.
        self.events: list[tuple[float, str, str]] = []

    def log(self, event: str, task: Task) -> None:
        self.events.append((time.monotonic(), event, task.tag))

    def spawn(self, f: Callable, *args, **kwargs) -> Task:
        task = Task(self, f, args, kwargs)
        self.log("spawn", task)
        self.all.append(task)
        return task

    def spawn_bulk(self, calls: list[tuple]) -> list[Task]:
        return [self.spawn(*c) for c in calls]

    def spawn_sequential(self, calls: list[tuple]) -> list[Task]:
        """Each call starts after the one before; a failure stops the rest."""
        out: list[Task] = []
        for f, *args in calls:
            before = out[-1] if out else None
            out.append(self.spawn(lambda _, f=f, args=args: f(*args), before))
        return out

    def wait_all(self, timeout: float | None = None) -> bool:
        return not futures.wait([t.future for t in self.all], timeout).not_done

    def wait_any(self, timeout: float | None = None) -> Task:
        done = futures.wait([t.future for t in self.all], timeout, futures.FIRST_COMPLETED).done
        return next(t for t in self.all if t.future in done)


def fetch_all(x):
    """A structure with every task replaced by its value."""
    if isinstance(x, Task):
        return fetch_all(x.fetch())
    if isinstance(x, dict):
        return {k: fetch_all(v) for k, v in x.items()}
    return type(x)(fetch_all(v) for v in x) if isinstance(x, (list, tuple)) else x


def restore_or_run(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if a whole one is there, else ``make()``, written there.

    A failing restore means the work is done again; a failing write leaves the
    result unsaved.  Neither fails the task.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    try:
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.parquet(path)
    except Exception as e:
        print(f"restore of {path} failed: {e}")
    df = make()
    try:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    except Exception as e:
        print(f"checkpoint to {path} failed: {e}")
        return df
