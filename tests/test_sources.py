import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from hostlens.schemas import EVENT, NORMALIZED, require_columns
from hostlens.sources import feeds, sinks, tables


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("raw"))
    put(f"{d}/openphish/openphish_2026-04-02.txt", "http://a.com/1\n\nhttp://a.com/2\n")
    put(f"{d}/openphish_snapshots/openphish_2026-04-05_10-00.txt", "http://a.com/3\n")
    put(f"{d}/openphish/openphish_undated.txt", "http://a.com/never\n")
    put(f"{d}/phishtank/phishtank_2026-04-03.json", json.dumps([{"url": "http://p.com", "phish_id": "7", "target": "Bank"}, {"url": "http://q.com"}]))
    put(
        f"{d}/news_sitemaps/news_sitemaps_2026-04-04.json",
        json.dumps([{"url": "http://n.com/x", "publisher": "npr", "sitemap_url": "m", "collected_at": "2026-04-01"}, {"url": "http://n.com/y", "collected_at": " "}]),
    )
    put(f"{d}/tranco/tranco_2026-04-05.csv", "1,one.com\n2,two.com\n3,three.com\n")
    put(f"{d}/mendeley_phishing_url/mendeley_phishing_url_2026-01-01.csv", "id,url,type\n1,http://m.com, Phishing\n2,http://k.com,legitimate\n3,http://z.com,other\n4,,phishing\n")
    os.makedirs(f"{d}/mendeley_legitphish")
    with gzip.open(f"{d}/mendeley_legitphish/mendeley_legitphish_2026-01-01.csv.gz", "wt") as f:
        f.write("URL,x,ClassLabel\nhttp://l.com,9,0\nhttp://b.com,9,1.0\nhttp://c.com,9,abc\n")
    return d


def by_value(df):
    return {r.original_value: r for r in df.collect()}


def test_all_sources(spark, raw):
    out = feeds.normalize(spark, raw, list(feeds.V.FEEDS), allow_opt_in=("openphish",), top_n=2)
    assert out.schema.simpleString() == NORMALIZED.simpleString()
    got = by_value(out)
    assert set(got) == {
        "http://a.com/1", "", "http://a.com/2", "http://a.com/3", "http://p.com", "http://q.com", "http://n.com/x", "http://n.com/y",
        "one.com", "two.com", "http://m.com", "http://k.com", "http://l.com", "http://b.com",
    }
    assert (got["http://p.com"].source_record_id, got["http://p.com"].source_target, got["http://p.com"].collected_at) == ("7", "Bank", "2026-04-03")
    assert got["http://n.com/x"].collected_at == "2026-04-01" and got["http://n.com/y"].collected_at == "2026-04-04"
    assert (got["two.com"].source_rank, got["two.com"].record_type, got["two.com"].label) == (2, "domain", 0)
    assert got["http://m.com"].label == 1 and got["http://m.com"].collected_at == "2024-04-02"
    assert (got["http://l.com"].label, got["http://b.com"].label) == (1, 0)


def test_date_window_and_opt_in(spark, raw):
    with pytest.raises(PermissionError):
        feeds.normalize(spark, raw, ["openphish"])
    out = feeds.normalize(spark, raw, ["openphish"], allow_opt_in=("openphish",), start="2026-04-03", end="2026-04-05")
    assert set(by_value(out)) == {"http://a.com/3"}
    with pytest.raises(ValueError):
        feeds.normalize(spark, raw, ["nothing"])
    with pytest.raises(FileNotFoundError):
        feeds.normalize(spark, raw + "/empty", ["tranco"])


def test_column_pruning_reaches_the_csv_scan(spark, raw):
    out = feeds.scan_feed(spark, raw, "mendeley_phishing_url")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string,type:string>" in plan


def test_latest_snapshot(spark, tmp_path):
    for i, day in enumerate(("2026-04-01", "2026-04-02")):
        put(f"{tmp_path}/openphish_{day}.txt", f"http://{day}.com/a\nhttp://{day}.com/b\n")
        os.utime(f"{tmp_path}/openphish_{day}.txt", (2000 - i, 2000 - i))
    rows = feeds.latest_snapshot(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.value for r in rows] == ["http://2026-04-01.com/a", "http://2026-04-01.com/b"]
    assert rows[0].snapshot == "openphish_2026-04-01.txt"


def test_seed_and_addon_csv(spark, tmp_path):
    put(f"{tmp_path}/seed.csv", 'sample_id,category,dataset_kind,input_value,expected_label,priority,note\nB1,u,domain,a.vn,benign,high,"one, ""two""\nlines"\n')
    row = tables.scan_validation_seed(spark, f"{tmp_path}/seed.csv").first()
    assert row.note == 'one, "two"\nlines' and row.sample_id == "B1"
    put(f"{tmp_path}/bad.csv", "sample_id\n1\n")
    with pytest.raises(ValueError, match="category"):
        tables.scan_validation_seed(spark, f"{tmp_path}/bad.csv")
    put(f"{tmp_path}/addon/a.csv", "source,input_value\nx,a.com\n")
    put(f"{tmp_path}/addon/b.csv", "input_value,collected_at\nb.com,2026-01-01\n")
    put(f"{tmp_path}/addon/c.csv", "other\nz\n")
    got = {r.input_value: (r.source, r.collected_at) for r in tables.scan_addon_dir(spark, f"{tmp_path}/addon").collect()}
    assert got == {"a.com": ("x", None), "b.com": (None, "2026-01-01")}


def test_event_log_skips_broken_lines(spark, tmp_path):
    good = {"event_id": "1", "received_at": "2026-01-01T00:00:00+07:00", "score": 0.5, "signals": ["a"], "parsed": {"hostname": "h"}, "metadata": {"k": "v"}}
    put(f"{tmp_path}/log/e.jsonl", json.dumps(good) + "\n\n{broken\n[]\n" + json.dumps({**good, "event_id": "2"}) + "\n")
    rows = tables.scan_event_log(spark, f"{tmp_path}/log").orderBy("event_id").collect()
    assert [r.event_id for r in rows] == ["1", "2"] and rows[0].parsed.hostname == "h" and rows[0].metadata.toPython() == {"k": "v"}
    sinks.append_events(tables.scan_event_log(spark, f"{tmp_path}/log"), f"{tmp_path}/log")
    assert tables.scan_event_log(spark, f"{tmp_path}/log").count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "2026-01-01", "train"), ("b", "2026-01-02", "test")], "v string, collected_at string, split string")
    sinks.write_stage(df, f"{tmp_path}/stage")
    assert sorted(os.listdir(tmp_path / "stage"))[-2:] == ["collected_at=2026-01-01", "collected_at=2026-01-02"]
    sinks.write_stage(df.where("v = 'a'"), f"{tmp_path}/stage")
    assert tables.scan_stage(spark, f"{tmp_path}/stage").count() == 1
    again = tables.scan_stage(spark, f"{tmp_path}/stage", df.schema)
    assert again.schema["collected_at"].dataType.typeName() == "string" and again.first().collected_at == "2026-01-01"
    sinks.write_stage(df.coalesce(1), f"{tmp_path}/sorted", None, ("v",))
    assert [r.v for r in tables.scan_stage(spark, f"{tmp_path}/sorted").collect()] == ["a", "b"]
    sinks.write_splits(df, f"{tmp_path}/splits")
    assert spark.read.parquet(f"{tmp_path}/splits").where("split = 'train'").count() == 1
    sinks.write_table_csv(df.withColumn("tags", F.array(F.lit("x"), F.lit("y"))), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first().tags == "x | y"
    sinks.write_stats(df.groupBy("split").count(), f"{tmp_path}/stats")
    assert spark.read.json(f"{tmp_path}/stats").count() == 2


def test_require_columns(spark):
    with pytest.raises(ValueError, match="x is missing required columns: b, c"):
        require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b", "c"], "x")
