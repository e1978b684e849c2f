"""Counters observed while stages are written, and profiles from merged sketches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from checks.queries import LINEAR
from hostlens.operators import corpus, counters, reports
from hostlens.plans import batch
from hostlens.schemas import NORMALIZED
from hostlens.session import Stages
from hostlens.sources import sinks
from hostlens.streaming import flows


def normalized(spark, n=60):
    rows = []
    for i in range(n):
        host = f"h{i % 17}.com"
        rows.append((f"http://{host}/{i % 9}", int(i % 5 == 0), f"s{i % 3}", f"2024-01-{1 + i % 4:02d}", "url", "", None, ""))
        rows.append((host if i % 6 else ["", "nohost", "a..b", "x.com"][i // 6 % 4], 0, "s9", "2024-01-02", "domain" if i % 7 else "mail", "", i, ""))
    rows += [(v, 1, "s0", "2024-01-01", "url", "", None, "") for v in ("javascript:x", "ftp://a.com", "http://", "http://a_b.com/", "http://a.com:70000/", "http://[::1")]
    return spark.createDataFrame(rows, NORMALIZED)


def test_observed_stats_equal_those_read_from_the_stages(spark, tmp_path):
    parsed = corpus.parse_normalized(normalized(spark))
    found = batch.observed_clean(parsed, str(tmp_path)).first().asDict()
    assert found == corpus.clean_stats(parsed).first().asDict()
    assert found["overlap_rows_removed"] > 0 and found["deduplicated_rows_removed"] > 0 and found["invalid_rows_removed"] > 5
    from hostlens.operators.parse import invalid_reasons

    want = {(r.invalid_reason, r.rows) for r in invalid_reasons(parsed).collect()}
    assert {(r.invalid_reason, r.rows) for r in spark.read.json(f"{tmp_path}/invalid_reasons").collect()} == want and len(want) >= 5
    written = spark.read.parquet(f"{tmp_path}/clean")
    assert sorted(written.drop("collected_at").collect()) == sorted(corpus.clean(parsed).drop("collected_at").collect())


def test_counters_of_nothing(spark, tmp_path):
    empty = corpus.parse_normalized(normalized(spark).limit(0))
    row = batch.observed_clean(empty, str(tmp_path)).first()
    assert set(row.asDict().values()) == {0}
    assert os.path.exists(f"{tmp_path}/invalid_reasons")


def test_known_values(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("", 0), (None, 0)], "source string, label int")
    found = sinks.write_stage(df, str(tmp_path / "t"), None, counters=counters.of_labels() | counters.per_value("source", ["a", "", "zz"]))
    assert (found["benign"], found["phishing"]) == (3, 2)
    assert {(r.source, r.rows) for r in counters.as_rows(spark, found, "source").collect()} == {("a", 2), ("", 1)}


def test_counters_of_a_stream(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    for k in range(2):
        with open(f"{tmp_path}/in/{k}.json", "w") as f:
            f.write("\n".join(json.dumps({"value": v}) for v in ("https://a.com/x", " ", "http://nohost/", f"login-{k}.tk")))
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = flows.write_scores(stream, LINEAR, f"{tmp_path}/log", f"{tmp_path}/cp", f"{tmp_path}/rejects", counts=f"{tmp_path}/counts")
    assert q.awaitTermination(120) and q.exception() is None
    rows = spark.read.json(f"{tmp_path}/counts").collect()
    assert len(rows) == 2 and all((r.requests, r.events, r.rejects) == (4, 2, 2) for r in rows)
    phishing = spark.read.json(f"{tmp_path}/log").where("predicted_label = 1").count()
    assert sum(r.phishing for r in rows) == phishing


def table(spark, n=20_000):
    return spark.range(n).select(
        F.format_string("2024-01-%02d", 1 + F.col("id") % 5).alias("collected_at"), F.col("id").alias("own"), (F.col("id") % 37).cast("int").alias("few"),
        F.when(F.col("id") % 3 > 0, F.md5((F.col("id") % 5000).cast("string"))).alias("text"), (F.col("id") % 900 / 7).alias("real"),
        F.when(F.col("id") < 0, "x").alias("never"), F.array(F.col("id") % 11).alias("list"), F.create_map(F.lit("k"), F.col("id") % 13).alias("map"),
        F.to_date(F.lit("2024-01-01")).alias("day"),
    )


def test_exact_profile(spark):
    df = table(spark, 500).withColumn("few", F.when(F.col("own") % 10 > 0, F.col("few")))
    got = {r.column_name: r for r in reports.column_profile(df).collect()}
    assert [got[c].unique_non_null_values for c in ("own", "few", "real", "never", "list", "map", "day")] == [500, 37, 500, 0, 11, 13, 1]
    assert (got["few"].null_count, got["few"].non_null_count, got["few"].null_ratio, got["few"].dtype) == (50, 450, 0.1, "int")
    assert (got["never"].null_count, got["never"].null_ratio) == (500, 1.0)
    plan = reports.column_profile(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def test_sketches_of_days_merge_within_the_error_bound(spark):
    df = table(spark)
    exact = {r.column_name: r.asDict() for r in reports.column_profile(df.drop("collected_at")).collect()}
    sketches = reports.profile_sketches(df, ["collected_at"])
    merged = {r.column_name: r.asDict() for r in reports.merged_profile(sketches).collect()}
    assert set(merged) == set(exact)
    for name, row in exact.items():
        estimate = merged[name].pop("unique_non_null_values")
        truth = row.pop("unique_non_null_values")
        assert merged[name] == row and abs(estimate - truth) <= 1 + 3 * 0.0083 * truth


def test_known_days_are_not_read_again(spark, tmp_path, monkeypatch):
    df = table(spark)
    df.where("collected_at < '2024-01-04'").write.partitionBy("collected_at").parquet(f"{tmp_path}/data")
    path = f"{tmp_path}/profile"
    first = batch.update_profile(spark.read.parquet(f"{tmp_path}/data"), path).collect()
    assert all(r.null_count + r.non_null_count == 12_000 for r in first)
    df.where("collected_at >= '2024-01-04'").write.mode("append").partitionBy("collected_at").parquet(f"{tmp_path}/data")
    seen = []
    plain = reports.profile_sketches
    monkeypatch.setattr(reports, "profile_sketches", lambda d, by: seen.append(d._jdf.queryExecution().executedPlan().toString()) or plain(d, by))
    both = batch.update_profile(spark.read.parquet(f"{tmp_path}/data"), path).collect()
    assert all(r.null_count + r.non_null_count == 20_000 for r in both)
    assert "PartitionFilters" in seen[0] and "2024-01-03" in seen[0]
    again = batch.update_profile(spark.read.parquet(f"{tmp_path}/data"), path)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, both))


def test_stage_owner_and_counters_together(spark):
    with Stages():
        df, watch = counters.observed(spark.range(7), {"n": F.count("*")})
        from hostlens.session import materialize

        assert materialize(df, "watched").count() == 7 and watch.get == {"n": 7}


@pytest.fixture(autouse=True)
def _quiet(spark):
    spark.sparkContext.setLogLevel("ERROR")
