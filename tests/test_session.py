"""Written stages and who removes them."""

import os

import pytest

from pyspark.sql import functions as F

from hostlens.session import Stages, discard, materialize, shared_folder


def left(spark, *names):
    return sorted(f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.split("-")[0] in names)


def test_stages_go_with_their_block(spark):
    with Stages() as outer:
        kept = outer.result(spark.range(5), "tsa")
        with Stages() as inner:
            first = materialize(spark.range(10), "tsb")
            second = inner.result(first.where("id > 3"), "tsc")
            assert len(left(spark, "tsa", "tsb", "tsc")) == 3
        assert len(left(spark, "tsb")) == 0 and second.count() == 6
        discard(second, spark.range(3))
        assert left(spark, "tsc") == []
    assert kept.count() == 5 and len(left(spark, "tsa")) == 1
    discard(kept)
    assert left(spark, "tsa") == []
    assert materialize(spark.range(2), "tsd").count() == 2  # nobody's


def test_stages_go_after_an_error(spark):
    with pytest.raises(ValueError):
        with Stages():
            materialize(spark.range(10), "tse")
            raise ValueError
    assert left(spark, "tse") == []


def test_scans_are_dealt_out_by_their_bytes(spark, tmp_path, monkeypatch):
    from hostlens import session

    spark.range(40_000).selectExpr("id", "md5(string(id)) AS a").coalesce(1).write.parquet(f"{tmp_path}/one")  # one row group, however it is split
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "TASK_BYTES", 50_000)
    scan = spark.read.parquet(f"{tmp_path}/one")
    dealt = session.spread(scan)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert cores < len(sizes) <= session.TASKS_PER_CORE * cores and max(sizes) < 40_000 / cores
    assert sum(sizes) == 40_000 and dealt.select(F.sum("id")).first()[0] == 40_000 * 39_999 // 2
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 40)
    assert session.parsing_tasks(scan) == 1 and session.spread(scan).rdd.getNumPartitions() == cores
    many = scan.repartition(cores)
    assert session.spread(many) is many
