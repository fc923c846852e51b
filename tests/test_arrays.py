"""Array operators against NumPy and golden grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.model import Domain
from gridloom.operators import elementwise, fourier, indexing, linalg, reduce, reshape, sorting, stencil
from gridloom.plans import tasks
from gridloom.sources import arrays


@pytest.fixture(scope="module")
def pair(spark):
    x = np.random.default_rng(1).normal(size=(12, 7))
    return x, arrays.from_numpy(spark, x)


def test_reductions(pair):
    x, a = pair
    for op, f in {"sum": np.sum, "min": np.min, "max": np.max, "mean": np.mean}.items():
        for dims in (None, (0,), (1,), (0, 1)):
            want = f(x) if dims is None else f(x, axis=dims, keepdims=True)
            assert np.allclose(reduce.reduce(a, op, dims).collect(), want)
    assert np.isclose(reduce.reduce(a, "std").collect(), x.std(ddof=1))
    assert np.isclose(reduce.reduce(a, "sum", init=5.0).collect(), x.sum() + 5)


def test_min_of_nan(spark):
    a = arrays.from_numpy(spark, np.array([1.0, np.nan]))
    assert np.isnan(reduce.reduce(a, "min").collect()) and np.isnan(reduce.reduce(a, "max").collect())


def test_elementwise_and_indexing(pair):
    x, a = pair
    assert np.allclose((a + a * 2.0).collect(), 3 * x)
    assert np.allclose(elementwise.broadcast(lambda p, q: p * q, a, reduce.reduce(a, "sum", (1,))).collect(), x * x.sum(1, keepdims=True))
    assert np.allclose(indexing.take(a, [3, 3, 0], slice(2, 5)).collect(), x[[3, 3, 0], 2:5])
    y = x.copy()
    y[1:3, 2:4] = x[5:7, 0:2]
    assert np.allclose(indexing.set_block(a, [(1, 3), (2, 4)], indexing.take(a, slice(5, 7), slice(0, 2))).collect(), y)
    assert np.allclose(reshape.concat(1, a, a.T.T).collect(), np.hstack([x, x]))
    with pytest.raises(ValueError):
        a + a.T
    with pytest.raises(IndexError):
        indexing.take(a, 12, 0)


def test_sort(spark):
    x = np.array([3, 1, 2, 3, 1, 5, 0, 3])
    assert sorting.sort(arrays.from_numpy(spark, x)).collect().tolist() == sorted(x)


def test_stencil_goldens(spark):
    line = arrays.from_numpy(spark, np.array([1.0, 2, 3, 4]))
    got = lambda a, rule, **k: stencil.neighbours(a, 1, rule, **k).collect().tolist()
    assert got(line, stencil.clamp()) == [4, 6, 9, 11]
    assert got(line, stencil.reflect()) == [4, 6, 9, 11]
    assert got(line, stencil.reflect(False)) == [5, 6, 9, 10]
    assert got(line, stencil.anti_reflect()) == [2, 6, 9, 3]
    assert got(line * 2.0, stencil.extrapolate()) == [6, 12, 18, 24]
    four = arrays.ones(spark, (4, 4))
    assert got(four, stencil.pad(0.0)) == [[4, 6, 6, 4], [6, 9, 9, 6], [6, 9, 9, 6], [4, 6, 6, 4]]
    assert got(four, stencil.wrap()) == [[9] * 4] * 4


def test_linalg(spark, pair):
    x, a = pair
    g = x.T @ x + np.eye(7)
    b = arrays.from_numpy(spark, g)
    assert np.allclose(linalg.syrk(a).collect() + np.eye(7), g)
    assert np.allclose(linalg.matmul_tiled(a, b, 4).collect(), x @ g)
    assert np.allclose(linalg.cholesky(b).collect(), np.linalg.cholesky(g))
    low, up, order = linalg.lu(b)
    assert np.allclose(g[order.collect().astype(int)], low.collect() @ up.collect())
    assert np.allclose(linalg.svd(a)[1].collect(), np.linalg.svd(x)[1])
    with pytest.raises(Exception, match="positive definite"):
        linalg.cholesky(b * -1.0).collect()


def test_fft(spark):
    x = np.random.default_rng(2).normal(size=(6, 5))
    got = fourier.transform(fourier.complex_cells(arrays.from_numpy(spark, x)), x.shape).toPandas().sort_values(["i0", "i1"])
    assert np.allclose(got.re.to_numpy() + 1j * got.im.to_numpy(), np.fft.fft2(x).ravel())


def test_fft2_takes_the_whole_matrix(spark, monkeypatch):
    import duckdb

    from gridloom.queries import QUERIES

    sf, seen, transform = "/root/testdata/sf0.001", [], fourier.transform

    def spy(df, shape, **kw):
        if not kw:
            seen.append((shape, df.count()))
        return transform(df, shape, **kw)

    monkeypatch.setattr(fourier, "transform", spy)
    got = QUERIES["fft2_round_trip"].run(spark, sf).toPandas().sort_values(["i0", "i1"]).reset_index(drop=True)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert n > 32 and seen == [((n, 64), n * 64)]
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(QUERIES["fft2_round_trip"].sql).df().sort_values(["i0", "i1"]).reset_index(drop=True)
    assert len(got) == len(want) and np.allclose(got.v, want.v, atol=2e-5)


def test_domains():
    a, b = Domain(((11, 26), (21, 101))), Domain(((10, 20), (30, 40)))
    assert a.intersect(b).ranges == ((11, 20), (30, 40)) and a.align_first().ranges == ((0, 15), (0, 80))
    assert len(Domain(((0, 10), (0, 10))).tiles((3, 4))) == 12


def test_tasks(spark, tmp_path):
    pool = tasks.Tasks(spark)
    bad = pool.spawn(lambda: 1 / 0)
    after = pool.spawn(lambda x: x, bad)
    with pytest.raises(tasks.TaskFailed, match="division"):
        after.fetch(20)
    with tasks.with_options(width=3):
        assert pool.spawn(tasks.get_options).fetch(20) == {"width": 3}
    assert tasks.fetch_all({"a": [pool.spawn(lambda: 2)]}) == {"a": [2]}
    path = f"file://{tmp_path}/kept"
    first = tasks.restore_or_run(spark, path, lambda: spark.range(3))
    assert first.count() == tasks.restore_or_run(spark, path, lambda: spark.range(9)).count() == 3


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 64
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pushdown(spark):
    plan = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter(F.col("l_quantity") > 10).select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan


def test_task_options_queues_and_events(spark):
    pool = tasks.Tasks(spark, 2)
    with tasks.with_options(pool="slow", description="a job of mine", tags=("mine",)):
        seen = pool.spawn(lambda: (spark.sparkContext.getLocalProperty("spark.scheduler.pool"), spark.sparkContext.getLocalProperty("spark.job.description"), "mine" in spark.sparkContext.getJobTags(), tasks.current_task().tag)).fetch(30)
    assert seen[:3] == ("slow", "a job of mine", True) and seen[3] == pool.all[0].tag and tasks.current_task() is None
    order = []
    pool.spawn_sequential([(order.append, x) for x in range(5)])[-1].fetch(30)
    assert order == list(range(5)) and [t.fetch(30) for t in pool.spawn_bulk([(pow, 2, k) for k in range(4)])] == [1, 2, 4, 8]
    assert {e for _, e, _ in pool.events} == {"spawn", "start", "end"}
    stuck = pool.spawn(lambda: spark.range(10**13).selectExpr("sum(sqrt(id))").first())
    import time

    time.sleep(2)
    stuck.cancel()
    with pytest.raises(tasks.TaskFailed):
        stuck.fetch(60)


def test_data_dependencies(spark):
    import time

    from gridloom.plans import deps

    pool, total, other, log = tasks.Tasks(spark, 4), deps.Mutable(0), deps.Mutable(0), []
    with deps.Region(pool) as r:
        for k in range(6):
            r.spawn(lambda m, k=k: (time.sleep(0.01 * (6 - k)), log.append(k), m.update(lambda x: 10 * x + k)), deps.InOut(total))
        late = r.spawn(lambda m: m.get(), deps.In(total))
        r.spawn(lambda m: m.set(-1), deps.Out(total))
        r.spawn(lambda m: m.set(5), deps.Out(other))
    assert log == list(range(6)) and late.fetch() == 12345 and total.get() == -1 and other.get() == 5
    with pytest.raises(tasks.TaskFailed, match="division"), deps.Region(pool) as r:
        r.spawn(lambda m: 1 / 0, deps.InOut(total))
        r.spawn(lambda m: m.set(7), deps.InOut(total))
    assert total.get() == -1


def test_entry_without_text_operators(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "gridloom.llm.queries", None)
    assert len(e.queries()) > 100 and not any(n.startswith("op") for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_scratch(spark):
    """What is made inside goes at the end, but for what is to stay."""
    from pathlib import Path

    from gridloom.plans import durable

    with durable.scratch(spark):
        gone, at = durable.stored(spark.range(3))
        kept, there = durable.stored(gone, keep=True)
    assert kept.count() == 3 and Path(there.removeprefix("file://")).exists() and not Path(at.removeprefix("file://")).exists()
    _, outside = durable.stored(spark.range(1))
    assert Path(outside.removeprefix("file://")).exists()
