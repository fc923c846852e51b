"""Streaming regions: limits, finishing with a value, state, teardown and argument checks."""

import pytest
from pyspark.sql import functions as F

from gridloom.streaming import region


@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('numbers')}/in"
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(path)
    return path


def test_arguments(spark, numbers):
    for n in (0, -1):
        with pytest.raises(ValueError):
            region.Region(spark, files_per_batch=n)
        with pytest.raises(ValueError):
            r = region.Region(spark)
            r.sink(r.source(numbers, "id bigint"), n)


def test_end_and_limits(spark, numbers):
    r = region.Region(spark)
    with r:
        stream = r.source(numbers, "id bigint")
        whole, some = r.sink(stream.select((F.col("id") * 2).alias("x"))), r.sink(stream, 15)
    r.wait()
    assert sorted(x.x for x in r.read(whole).collect()) == list(range(0, 80, 2))
    assert sorted(x.id for x in r.read(some).collect()) == list(range(15))


def test_finish_with_value_and_state(spark, numbers):
    r, seen = region.Region(spark), []

    def step(batch, number, total):
        seen.append(number)
        total += batch.agg(F.sum("id")).first()[0]
        return region.Finish(total) if number == 1 else total

    stage = r.each(r.source(numbers, "id bigint"), step, 0)
    other = r.each(r.source(numbers, "id bigint"), lambda batch, number: batch.count() < 0)
    r.wait()
    assert seen == [0, 1] and r.result(stage) == sum(range(20)) and r.result(other) is None


def test_failure_tears_down(spark, numbers):
    def fail(batch, number):
        raise RuntimeError("no")

    r = region.Region(spark)
    r.each(r.source(numbers, "id bigint"), fail)
    slow = r.source(numbers, "id bigint").writeStream.format("noop").trigger(processingTime="1 hour").start()
    r.running.append(slow)
    with pytest.raises(Exception, match="no"):
        r.wait(60)
    assert not slow.isActive
    with pytest.raises(KeyError), region.Region(spark) as left:
        raise KeyError("the region's body fails before its queries start")
    assert left.running == []


def test_zip(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.range(20).selectExpr("id as seq", "timestamp'2024-01-01' + make_dt_interval(0, 0, id) as ts").write.parquet(path)
    r = region.Region(spark)
    with r:
        s = r.source(path, "seq bigint, ts timestamp")
        left, right = s.selectExpr("seq", "ts", "seq * 2 as a"), s.selectExpr("seq", "ts", "seq * 3 as b")
        out = r.sink(region.zip_streams(left, right, "seq", "ts").selectExpr("a.a + b.b as v"))
    r.wait()
    assert sorted(x.v for x in r.read(out).collect()) == [5 * i for i in range(20)]
