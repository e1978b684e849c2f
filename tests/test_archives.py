"""Zip archives read like the same files plain or gzipped; files are chosen by name before any is opened."""

import gzip
import os
import zipfile

import pytest

from hostlens.sources import archives, feeds, tables

RANKED = "1,one.com\n2,two.com\n\n3,\"three,3.com\"\nx,bad.rank\n5\n"
TEXT = 'id,url,type\n1,http://m.com, Phishing\r\n2,"http://k.com/a,b",legitimate\n3,http://z.com,other\n4,,phishing\n\n5,"say ""x""",phishing\n6,http://é.com/中,PHISHING\n7,http://short.com\n'
NUMBERS = "URL,x,ClassLabel\nhttp://l.com,9,0\nhttp://b.com,9,1.0\nhttp://c.com,9,abc\n,9,0\n"
FEEDS = {
    "tranco": ("tranco_2026-04-05", RANKED), "mendeley_phishing_url": ("mendeley_phishing_url_2026-01-01", TEXT),
    "mendeley_legitphish": ("mendeley_legitphish_2026-01-02", NUMBERS), "openphish": ("openphish_2026-04-02", "http://a.com/1\n\n http://a.com/2\r\nhttp://a.com/3"),
}


def land(folder, form):
    for source, (name, text) in FEEDS.items():
        os.makedirs(f"{folder}/{source}")
        path, data = f"{folder}/{source}/{name}", text.encode()
        if form == "plain":
            with open(f"{path}.csv", "wb") as f:
                f.write(data)
        elif form == "gz":
            with gzip.open(f"{path}.csv.gz", "wb") as f:
                f.write(data)
        else:
            with zipfile.ZipFile(f"{path}.ZIP", "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("folder/inner.csv", data)
                z.writestr("__MACOSX/folder/._inner.csv", b"\x00\x05junk\n")
                z.writestr("empty.csv", b"")
    return str(folder)


@pytest.mark.parametrize("source", list(FEEDS))
def test_equal_rows_from_plain_gz_and_zip(spark, tmp_path, source):
    found = []
    for form in ("plain", "gz", "zip"):
        df = feeds.scan_feed(spark, land(tmp_path / form, form), source)
        found.append(sorted(map(tuple, df.collect()), key=repr))
    assert found[0] == found[1] == found[2] and len(found[0]) >= 2


def test_archives_beside_plain_files(spark, tmp_path):
    land(tmp_path, "zip")
    with open(f"{tmp_path}/tranco/tranco_2026-04-06.csv", "w") as f:
        f.write("9,nine.com\n")
    rows = feeds.scan_feed(spark, str(tmp_path), "tranco").collect()
    assert {(r.original_value, r.collected_at) for r in rows} >= {("one.com", "2026-04-05"), ("nine.com", "2026-04-06")}
    late = feeds.scan_feed(spark, str(tmp_path), "tranco", start="2026-04-06")
    assert [r.original_value for r in late.collect()] == ["nine.com"]


def test_members_are_partitions_and_stream_in_batches(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for m in range(5):
            z.writestr(f"m{m}.txt", "".join(f"{m} line {i}\n" for i in range(3000)))
    df = archives.lines(spark, [f"{tmp_path}/a.zip"])
    assert df.rdd.getNumPartitions() == 5
    assert df.count() == 15000 and df.where("value = concat(substr(member, 2, 1), ' line ', line)").count() == 15000
    monkeypatch.setattr(archives, "_BATCH_LINES", 700)
    reader = archives._Reader([f"{tmp_path}/a.zip"], False)
    batches = [b.num_rows for b in reader.read(reader.partitions()[0])]
    assert batches == [700, 700, 700, 700, 200]
    head = archives.lines(spark, [f"{tmp_path}/a.zip"], head=True).collect()
    assert sorted(r.value for r in head) == [f"{m} line 0" for m in range(5)]


def test_bad_archives_are_named(spark, tmp_path):
    with open(f"{tmp_path}/bad.zip", "wb") as f:
        f.write(b"no archive at all")
    with pytest.raises(Exception, match="bad.zip is no zip archive"):
        archives.lines(spark, [f"{tmp_path}/bad.zip"]).count()
    assert archives.lines(spark, []).count() == 0
    assert archives.csv_rows(spark, [], columns=("a",)).count() == 0


def test_files_outside_the_window_are_never_opened(spark, tmp_path):
    folder = tmp_path / "openphish"
    os.makedirs(folder)
    for i in range(100_000):
        year = 1999 if i % 1000 == 0 else 2000 + i // 400
        day = 1 + (i // 1000 if year == 1999 else i) % 28
        (folder / f"openphish_{year}-01-{day:02d}_{i}.txt").write_text(f"http://h{i}.com/\n" if year == 1999 else "never opened\n")
    paths = feeds.landed(spark, str(tmp_path), "openphish", "1999-01-05", "1999-01-06")
    assert len(paths) == 8 and all("1999-01-05" in p or "1999-01-06" in p for p in paths)
    rows = feeds.scan_feed(spark, str(tmp_path), "openphish", "1999-01-05", "1999-01-06")
    assert rows.count() == 8 and len(rows.inputFiles()) == 8


def test_addon_folder_is_one_read_per_header(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"a{i:02d}.csv").write_text(f"input_value,note\n\"h{i}.com\",\"two\nlines\"\n")
    (tmp_path / "b.csv").write_text("﻿collected_at,input_value,input_value\n2025-01-01,b.com,again\n")
    (tmp_path / "c.csv").write_text("other\nx\n")
    (tmp_path / "d.csv").write_text("")
    df = tables.scan_addon_dir(spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    rows = df.collect()
    assert len(rows) == 31 and {r.input_value for r in rows} == {"b.com", *[f"h{i}.com" for i in range(30)]}
    assert [r.collected_at for r in rows if r.input_value == "b.com"] == ["2025-01-01"]
    assert tables.scan_addon_dir(spark, f"{tmp_path}/none").count() == 0
