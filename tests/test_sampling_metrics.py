import random

import pytest
from pyspark.sql import functions as F

from hostlens.operators import evaluation, metrics, reports, sampling


def dated(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(f"k{i}", int(rnd.random() < 0.3), f"2024-01-{1 + min(9, int(rnd.expovariate(0.4))):02d}") for i in range(n)]
    return spark.createDataFrame(rows, "sample_text string, label int, collected_at string")


def test_per_date_balance_is_exact_and_stable(spark):
    df = sampling.drop_single_class_dates(dated(spark))
    out = sampling.undersample_per_date(df)
    counts = {(r.collected_at, r.label): r["count"] for r in out.groupBy("collected_at", "label").count().collect()}
    want = {r.collected_at: min(r.benign, r.phishing) for r in sampling.date_labels(df).collect()}
    assert counts == {(d, c): n for d, n in want.items() for c in (0, 1)}
    assert sorted(out.collect()) == sorted(sampling.undersample_per_date(df.repartition(5)).collect())
    assert sorted(out.collect()) != sorted(sampling.undersample_per_date(df, seed=7).collect())


def test_global_balance(spark):
    out = sampling.balance(dated(spark), "global_under")
    counts = [r["count"] for r in out.groupBy("label").count().collect()]
    assert counts[0] == counts[1] and out.select("sample_text").distinct().count() == sum(counts)


def test_balance_guards(spark):
    one = spark.createDataFrame([("a", 1, "2024-01-01")], "sample_text string, label int, collected_at string")
    for strategy in ("per_date_under", "global_under"):
        with pytest.raises(ValueError):
            sampling.balance(one, strategy)
    assert sampling.balance(one, "none").count() == 1
    with pytest.raises(ValueError):
        sampling.balance(one, "other")


@pytest.mark.parametrize("n", [3, 4, 5, 10, 15, 20, 30])
def test_split_sizes(spark, n):
    train, val = max(1, round(n * 0.7)), max(1, round(n * 0.15))
    if n - train - val < 1:
        train -= 1
    df = spark.createDataFrame([(f"2024-01-{i + 1:02d}",) for i in range(n)], "collected_at string")
    got = [r.split for r in sampling.temporal_split(df).orderBy("collected_at").collect()]
    assert got == ["train"] * train + ["val"] * val + ["test"] * (n - train - val)


def test_split_guards(spark):
    two = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "collected_at string")
    with pytest.raises(Exception, match="at least 3"):
        sampling.temporal_split(two).collect()
    days = spark.createDataFrame([(f"2024-01-0{i}", int(i < 3)) for i in range(1, 6)], "collected_at string, label int")
    with pytest.raises(ValueError):
        sampling.check_both_classes(sampling.temporal_split(days))


def test_addon_goes_to_training_days_only(spark):
    split = sampling.temporal_split(dated(spark))
    addon = spark.createDataFrame([(f"x{i}", 0, "1999-01-01") for i in range(30)], "sample_text string, label int, collected_at string")
    out = sampling.augment_train(split, addon)
    new = out.join(addon.select("sample_text"), "sample_text", "left_semi")
    days = {r[0] for r in split.where("split = 'train'").select("collected_at").distinct().collect()}
    assert new.count() == 30 and {r.split for r in new.collect()} == {"train"} and {r.collected_at for r in new.collect()} <= days


def brute(rows):
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, tp, fp = 0.0, 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        hit = sum(1 for y, t in rows if t == s and y)
        fp += sum(1 for y, t in rows if t == s and not y)
        tp += hit
        ap += hit / len(pos) * tp / (tp + fp)
    return auc, ap


@pytest.mark.parametrize("levels", [1, 2, 7, 5000])
def test_ranking_metrics_match_brute_force(spark, levels):
    rnd = random.Random(levels)
    rows = [(int(rnd.random() < 0.3), rnd.randrange(levels) / levels - 0.4) for _ in range(1500)]
    df = spark.createDataFrame(rows, "label int, score double")
    m = metrics.ranking_metrics(df).first()
    assert (m.roc_auc, m.pr_auc) == pytest.approx(brute(rows), abs=1e-12)
    squeezed = metrics.ranking_metrics(df.withColumn("score", F.exp("score"))).first()
    assert (squeezed.roc_auc, squeezed.pr_auc) == pytest.approx((m.roc_auc, m.pr_auc), abs=1e-12)


def test_undefined_metrics_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    m = metrics.classification_metrics(df).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)


def test_model_order_breaks_ties(spark):
    df = spark.createDataFrame([("xgboost", 0.5), ("logistic_regression", 0.5), ("ann_mlp", 0.4)], "model string, pr_auc double")
    assert [r.model for r in metrics.rank_models(df).collect()] == ["logistic_regression", "xgboost", "ann_mlp"]


SEED = [
    ("1", "url", "critical", "bank", "phishing", 1, 0.9, ""), ("2", "url", "critical", "bank", "phishing", 0, 0.2, ""),
    ("3", "domain", "high", "cloud", "phishing", 0, 0.1, ""), ("4", "domain", None, None, "phishing", -1, None, "bad host"),
]


def seed(spark):
    ddl = "sample_id string, dataset_kind string, priority string, category string, expected_label string, predicted_label int, score double, error string"
    return evaluation.confusion_flags(spark.createDataFrame(SEED, ddl))


def test_group_summary(spark):
    rows = {(r.grouped_by, r.group_key): r for r in evaluation.all_summaries(seed(spark)).collect()}
    assert len(rows) == 2 + 3 + 3 + 1
    none = rows[("category", None)]
    assert (none.total_cases, none.errors, none.matched_cases, none.average_score) == (1, 1, 0, None)
    bank = rows[("category", "bank")]
    assert (bank.matched_cases, bank.false_negatives, bank.match_rate) == (1, 1, 0.5) and bank.average_score == pytest.approx(0.55)
    assert rows[("overall", None)].total_cases == 4 and rows[("overall", None)].false_negatives == 2


def test_modes_and_issues(spark):
    df = seed(spark)
    assert evaluation.evaluation_mode(df).first()[0] == "phishing_only"
    assert [r.sample_id for r in evaluation.top_issues(df, "phishing_only").collect()] == ["2", "3"]
    assert [r.sample_id for r in evaluation.top_issues(df, "mixed").collect()] == ["2", "3", "4"]
    with pytest.raises(ValueError):
        evaluation.top_issues(df, "none")


def test_column_profile(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, None, None)], "x int, y string, z double")
    got = {r.column_name: (r.dtype, r.null_count, r.non_null_count, r.unique_non_null_values) for r in reports.column_profile(df).collect()}
    assert got == {"x": ("int", 0, 3, 2), "y": ("string", 1, 2, 2), "z": ("double", 3, 0, 0)}


def test_recent_events_limit(spark):
    df = spark.range(600).selectExpr("cast(id as string) event_id", "lpad(cast(id as string), 4, '0') received_at")
    assert reports.recent_events(df, 9999).count() == df.count() and reports.recent_events(df, 1).first().event_id == "599"
    with pytest.raises(ValueError):
        reports.recent_events(df, 0)
