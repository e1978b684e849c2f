"""The master of first sightings: touched buckets only, batches run again, merged folders."""

import os

import pytest
from pyspark.sql import functions as F

from hostlens.streaming.master import Master


def batch(spark, keys, day):
    return spark.createDataFrame([(k, day) for k in sorted(set(keys))], "k string, day int")


def rows(master):
    return sorted((r.k, r.day) for r in master.scan().collect())


def folders(path):
    return sorted(os.path.relpath(d, path) for d, _, names in os.walk(f"{path}/rows") if any(n.endswith(".parquet") for n in names))


def test_only_touched_buckets_are_read(spark, tmp_path):
    master = Master(spark, str(tmp_path / "m"), "k", buckets=32)
    master.add(batch(spark, [f"k{i}" for i in range(2000)], 0), 0)
    live, _ = master.live()
    assert len(live) == 32
    small = batch(spark, ["k7", "new"], 1).withColumn("bucket", master.bucket())
    touched = {r.bucket for r in small.collect()}
    read = master.seen(small, live).inputFiles()
    assert read and {int(f.split("bucket=")[1].split("/")[0]) for f in read} == touched and len(touched) <= 2
    assert master.seen(batch(spark, ["x"], 1).withColumn("bucket", F.lit(99)), live) is None
    master.add(small.drop("bucket"), 1)
    assert len(rows(master)) == 2001 and ("new", 1) in rows(master) and ("k7", 0) in rows(master)


def test_a_batch_run_again_adds_nothing_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    master = Master(spark, path, "k", buckets=4, merge_at=3)
    master.add(batch(spark, "abcdef", 0), 0)
    master.add(batch(spark, "aghi", 1), 1)
    wanted = rows(master)
    master.add(batch(spark, "aghi", 1), 1)  # its manifest stood, but the stream had not noted it
    assert rows(master) == wanted
    # Lost before the manifest is written: rows and merged folders are there, and not live.
    monkeypatch.setattr(Master, "_declare", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        master.add(batch(spark, "xyzab", 2), 2)
    monkeypatch.undo()
    again = Master(spark, path, "k")  # a restart; the number of buckets comes from the manifest
    assert rows(again) == wanted
    again.add(batch(spark, "xyzab", 2), 2)
    assert rows(again) == sorted([*wanted, ("x", 2), ("y", 2), ("z", 2)]) and again.buckets == 4


def test_folders_are_merged_and_removed(spark, tmp_path):
    path = str(tmp_path / "m")
    master = Master(spark, path, "k", buckets=2, merge_at=4)
    for i in range(14):
        master.add(batch(spark, [f"{i}-{j}" for j in range(6)] + ["0-0"], i), i)
        live, _ = master.live()
        assert all(len(f) < 4 for f in live.values())
    assert rows(master) == sorted((f"{i}-{j}", i) for i in range(14) for j in range(6))
    master.add(batch(spark, ["last"], 14), 14)
    live, obsolete = master.live()
    assert set(folders(path)) == {f"{x}" for f in live.values() for x in f} | set(obsolete)
    assert len(master.batches()) == 2


def test_empty_batches(spark, tmp_path):
    master = Master(spark, str(tmp_path / "m"), "k")
    master.add(batch(spark, [], 0), 0)
    with pytest.raises(FileNotFoundError):
        master.scan()
    master.add(batch(spark, ["a"], 1), 1)
    master.add(batch(spark, [], 2), 2)
    assert rows(master) == [("a", 1)]
    with pytest.raises(ValueError):
        Master(spark, str(tmp_path / "m"), "day").live()


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    from checks.queries import QUERIES
    from checks.views import Tables

    for name, files in (("many", 3), ("one", 1)):
        pages = spark.createDataFrame([(i, f"http://h{i % 4}.example.com/a", "<p>x</p>") for i in range(6)], "page_id long, url string, html string")
        written = tmp_path / f"{name}-files"
        pages.repartition(files).write.parquet(str(written))
        parts = list(written.glob("part-*.parquet"))
        assert len(parts) == files
        (tmp_path / name).mkdir()
        (tmp_path / name / "pages.parquet").symlink_to(written if files > 1 else parts[0])
        # A table beside it stays out of the stream.
        spark.range(1).write.parquet(str(tmp_path / name / "events.parquet"))
        assert Tables(spark, str(tmp_path / name)).stream("pages").columns == pages.columns
        found = QUERIES["stream_new_urls"](spark, str(tmp_path / name)).collect()
        assert sorted(r["canonical_url"] for r in found) == [f"http://h{i}.example.com/a" for i in range(4)], name
