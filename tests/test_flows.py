import json
import os

import pytest
from pyspark.sql import functions as F

from checks.queries import LINEAR
from hostlens.operators import models, reports, sampling, scoring
from hostlens.operators.parse import parse_records
from hostlens.plans import batch
from hostlens.session import materialize, shared_folder
from hostlens.sources.tables import scan_event_log
from hostlens.streaming import flows


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def done(q):
    assert q.awaitTermination(120) and q.exception() is None


def test_new_urls_over_batches_equal_the_batch_result(spark, tmp_path):
    land, master, cp = str(tmp_path / "land"), str(tmp_path / "master"), str(tmp_path / "cp")
    files = {
        "openphish_2026-04-01_10-00.txt": ["http://a.com/1", "http://a.com/1?utm_id=3", "bad"],
        "openphish_2026-04-02_10-00.txt": ["http://a.com/1", "http://b.com/2", ""],
        "openphish_2026-04-03_10-00.txt": ["http://b.com/2#x", "http://c.com/3"],
        "notes.txt": ["http://undated.com/"],
    }
    for name, lines in files.items():
        put(f"{land}/{name}", "\n".join(lines) + "\n")
        done(flows.write_new_urls(flows.stream_snapshots(spark, land), master, cp))
    rows = flows.master_urls(spark, master).orderBy("canonical_url").collect()
    assert [(r.canonical_url, r.collected_at) for r in rows] == [
        ("http://a.com/1", "2026-04-01"), ("http://b.com/2", "2026-04-02"), ("http://c.com/3", "2026-04-03"),
    ]


def test_new_within_watermark(spark, tmp_path):
    put(f"{tmp_path}/land/openphish_2026-04-01.txt", "http://a.com/1\nhttp://a.com/1\nhttp://b.com/\n")
    parsed = parse_records(flows.stream_snapshots(spark, f"{tmp_path}/land")).withColumn("at", F.col("collected_at").cast("timestamp"))
    q = flows.new_within(parsed, "at").select("canonical_url").writeStream.format("parquet").option("path", f"{tmp_path}/out")
    done(q.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


REQUESTS = [
    {"value": "https://login.example.com/a?x=1", "source": "proxy", "metadata": json.dumps({"ip": "10.0.0.1", "port": 443, "tls": {"ok": True, "names": ["a", None, 1.5]}})},
    {"value": " paypal-secure.tk ", "dataset_kind": "AUTO", "metadata": "[1]"},
    {"value": "https://shop.example.com/x", "dataset_kind": "domain"},
    {"value": "  "},
    {"value": "a.com", "dataset_kind": "mail"},
    {"value": "http://nohost/"},
]


def test_scores_stream_equals_batch(spark, tmp_path):
    put(f"{tmp_path}/in/r.json", "\n".join(json.dumps(r) for r in REQUESTS))
    schema = "value string, dataset_kind string, source string, metadata string"
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    done(flows.write_scores(stream, LINEAR, f"{tmp_path}/log", f"{tmp_path}/cp", f"{tmp_path}/rejects"))
    got = {r.raw_value: r for r in scan_event_log(spark, f"{tmp_path}/log").collect()}
    assert set(got) == {"https://login.example.com/a?x=1", "paypal-secure.tk", "https://shop.example.com/x"}
    shop, pay, login = got["https://shop.example.com/x"], got["paypal-secure.tk"], got["https://login.example.com/a?x=1"]
    assert (shop.dataset_kind, shop.normalized_value, shop.feature_count) == ("domain", "shop.example.com", 15)
    assert shop.parsed.path == "/x" and shop.source == "ids_sensor" and shop.metadata.toPython() == {}
    assert pay.metadata.toPython() == {"raw_metadata": "[1]"} and login.source == "proxy"
    nested = json.loads(login.metadata.toJson())  # through the scoring, the JSON log and back
    assert nested == json.loads(REQUESTS[0]["metadata"]) and type(nested["port"]) is int
    assert len(pay.signals) == 4 and "`.tk`" in pay.signals[3] and len(login.event_id) == 32
    rejects = spark.read.json(f"{tmp_path}/rejects").collect()
    assert sorted(r.reject_reason[:10] for r in rejects) == ["Could not ", "`dataset_k", "`value` is"]
    good, bad = scoring.score_requests(spark.read.schema(schema).json(f"{tmp_path}/in"), LINEAR)
    assert {(r.raw_value, r.score, r.predicted_label) for r in good.collect()} == {(r.raw_value, r.score, r.predicted_label) for r in got.values()}
    assert bad.count() == 3 and good.count() + bad.count() == len(REQUESTS)
    log = scan_event_log(spark, f"{tmp_path}/log")
    live = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").json(f"{tmp_path}/log")
    done(flows.write_summary(live, f"{tmp_path}/summary", f"{tmp_path}/cp2"))
    assert spark.read.parquet(f"{tmp_path}/summary").collect() == reports.event_summary(log).collect()


def test_error_rows_keep_their_reason(spark):
    df = spark.createDataFrame([("http://nohost/", "url"), ("no host", "domain"), ("none", "domain"), ("a.com", "ip"), ("b.com", None)], "raw_value string, dataset_kind string")
    got = {r.raw_value: r for r in scoring.score_table(df, LINEAR).collect()}
    assert got["http://nohost/"].error == "Could not parse URL input. Reason: invalid_hostname"
    assert got["no host"].error == "Could not parse domain input. Reason: invalid_domain"
    assert got["none"].error == "Could not parse domain input. Reason: empty_value"
    assert got["a.com"].error == "'ip'" and got["b.com"].error == "'nan'"
    assert all(r.predicted_label == -1 and r.predicted_class == "error" and r.score is None and r.signals == [] for r in got.values())


@pytest.fixture(scope="module")
def url_rows(spark):
    rows = []
    for i in range(240):
        bad = i % 3 == 0
        host = f"secure-login{i}.xyz" if bad else f"site{i}.example.com"
        rows.append((f"http://{host}/verify?a={i}" if bad else f"https://{host}/news/{i}", "url", int(bad), f"2024-01-{1 + i // 3 % 6:02d}"))
    df = spark.createDataFrame(rows, "value string, record_type string, label int, collected_at string")
    parsed = parse_records(df, "value").withColumn("sample_text", F.col("canonical_url"))
    return materialize(sampling.temporal_split(parsed), "url_rows")


def test_train_compare_save_load_score(spark, url_rows, tmp_path):
    names = ("logistic_regression", "xgboost", "ann_mlp", "hybrid_lr_xgboost_ann")
    result = models.train_compare(url_rows, "url", "v1", sizes=models.SMALL, names=names)
    table = result.comparison.collect()
    assert {r.model for r in table} == set(names) and sum(r.is_selected_model for r in table) == 1
    assert all(0 <= r[c] <= 1 for r in table for c in result.comparison.columns if c.endswith(("_test", "_validation")))
    assert max(r.pr_auc_test for r in table) > 0.9
    result.best.save(str(tmp_path / "model"))
    again = models.Scorer.load(spark, str(tmp_path / "model"))
    requests = spark.createDataFrame([("http://secure-login7.xyz/verify", "url"), ("https://site9.example.com/news/9", "url")], "raw_value string, dataset_kind string")
    a, b = (scoring.score_table(requests, {"url": s, "domain": LINEAR["domain"]}).orderBy("raw_value").collect() for s in (result.best, again))
    assert a == b and [r.predicted_label for r in a] == [1, 0] and a[0].model_name == again.name
    variants = models.compare_variants({"a": result, "b": result})
    assert variants.groupBy("variant").count().count() == 2
    with pytest.raises(ValueError):
        models.train_compare(url_rows, "url", by="accuracy")


def test_linear_scorer_equals_the_fitted_pipeline(spark, url_rows, tmp_path):
    from hostlens.operators.features import url_features
    from hostlens.sources.sinks import write_stage

    write_stage(url_rows, str(tmp_path / "observed"), None, counters={"n": F.count("*")})  # observing must not keep models from travelling
    data, n = models.weighted(url_features(url_rows))
    filling = models.medians(data, models.feature_names("url"))
    fitted = models.portable(models.build_estimator("linear_svm", "url", n, filling, models.SMALL).fit(data), spark)
    slow = models.Scorer("linear_svm", "url", "v", [fitted]).normalized(data).select("sample_text", "score", "prediction")
    fast = models.LinearScorer.from_pipeline("linear_svm", "url", "v", fitted).normalized(data).select("sample_text", F.col("score").alias("s2"), F.col("prediction").alias("p2"))
    both = slow.join(fast, "sample_text").agg(F.max(F.abs(F.col("score") - F.col("s2"))).alias("d"), F.count_if(F.col("prediction") != F.col("p2")).alias("n")).first()
    assert both.d < 1e-9 and both.n == 0
    assert "BatchEvalPython" not in fast._jdf.queryExecution().executedPlan().toString()


def test_whole_corpus_flow(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    for d in range(1, 6):
        put(f"{raw}/openphish/openphish_2026-04-0{d}.txt", "\n".join(f"http://login{d}-{i}.xyz/pay?i={i}" for i in range(8)) + "\n\n")
        put(f"{raw}/tranco/tranco_2026-04-0{d}.csv", "\n".join(f"{i},good{d}x{i}.com" for i in range(1, 12)) + "\n12,login1-1.xyz\n")
    put(f"{raw}/addon/a.csv", "input_value\nextra.vn\n")
    batch.build_corpus(spark, raw, out, ["openphish", "tranco"], ("openphish",), addon_dir=f"{raw}/addon")
    stats = spark.read.json(f"{out}/clean_stats").first()
    assert (stats.input_rows, stats.invalid_rows_removed, stats.overlap_rows_removed, stats.output_rows) == (5 * 21, 5, 5, 95)
    assert spark.read.json(f"{out}/invalid_reasons").first().invalid_reason == "empty_value"
    domains = spark.read.parquet(f"{out}/domain_dataset")
    assert domains.count() == 96 and spark.read.parquet(f"{out}/url_dataset").count() == 40
    result = batch.train(
        domains.withColumn("collected_at", F.col("collected_at").cast("string")), "domain", f"{out}/model", sizes=models.SMALL,
        names=("logistic_regression", "random_forest"), write_splits=True,
    )
    assert spark.read.csv(f"{out}/model/model_comparison", header=True).count() == 2
    assert spark.read.parquet(f"{out}/model/domain_splits").groupBy("split").count().count() == 3
    seed = spark.createDataFrame(
        [("B1", "c1", "domain", "good9x9.com", "benign", "high", ""), ("P1", "c2", "domain", "login9-9.xyz", "phishing", "high", ""), ("U1", "c2", "url", "http://nohost/", "phishing", None, "")],
        "sample_id string, category string, dataset_kind string, input_value string, expected_label string, priority string, note string",
    )
    tables = batch.validate(seed, {"domain": result.best, "url": LINEAR["url"]}, f"{out}/validation", "20260406_000000")
    assert tables["summary"].first().total_cases == 3 and tables["summary"].first().errors == 1
    assert spark.read.csv(f"{out}/validation/run_ts=20260406_000000/details", header=True, multiLine=True).count() == 3
    batch.review_tables(domains, spark.read.parquet(f"{out}/model/domain_splits"), "domain", f"{out}/review")
    assert spark.read.csv(f"{out}/review/domain_dataset_overview", header=True).count() == 4
    rows = batch.phishing_seed(spark, f"{raw}/openphish", f"{out}/seed")
    assert rows.count() == 2 * min(15, 4) and spark.read.csv(f"{out}/seed", header=True).columns[0] == "sample_id"


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_training_rows_are_parsed_before_they_are_split(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from checks import queries

    rows = [(i, f"2024-01-{1 + i % 9:02d} 00:00:00", i, ("view", "click", "error")[i % 3], 1.0, "{}") for i in range(54)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    monkeypatch.setattr(queries.models, "train_compare", lambda data, *a, **k: seen.append(data) or SimpleNamespace(comparison=data))
    queries.QUERIES["train_compare"](spark, str(tmp_path))
    files = seen[0].inputFiles()
    assert files and all("/rows-" in f for f in files)  # no fit, count or check parses the events again
    assert seen[0].count() == 36 and "split" in seen[0].columns  # the hosts of error events have one label and do not parse
