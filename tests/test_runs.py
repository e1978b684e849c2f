"""The table of runs: rows by run, replaced when a run is tried again."""

import pytest
from pyspark.sql import functions as F

from hostlens.plans import batch, runs


@pytest.fixture(scope="module")
def dataset(spark):
    rows = []
    for i in range(120):
        day = f"2024-01-{1 + i % 6:02d}"
        rows.append((f"h{i}.com", int(i % 5 == 0 and i % 6 != 3), "s", day))
    return spark.createDataFrame(rows, "sample_text string, label int, source string, collected_at string")


def test_training_facts(spark, dataset):
    rows = batch.training_rows(dataset, "domain")
    r = runs.training_facts(dataset, rows, "domain", "per_date_under").first()
    kept = rows.collect()
    assert r.dropped_dates == ["2024-01-04"] and (r.before.benign + r.before.phishing, r.after.benign, r.after.phishing) == (120, len(kept) // 2, len(kept) // 2)
    assert [s.split for s in r.splits] == ["train", "val", "test"] and [d for s in r.splits for d in s.dates] == sorted({k.collected_at for k in kept})
    assert sum(s.rows for s in r.splits) == len(kept) and sum(b.rows_removed for b in r.balancing) == 100 - len(kept)
    assert len(r.feature_columns) == 15
    plain = runs.training_facts(dataset, batch.training_rows(dataset, "url"), "url", "none").first()
    assert plain.balancing == [] and plain.after.benign + plain.after.phishing == 100 and len(plain.feature_columns) == 37


def test_a_run_tried_again_replaces_its_row(spark, dataset, tmp_path):
    path = str(tmp_path / "runs")
    facts = runs.training_facts(dataset, batch.training_rows(dataset, "domain"), "domain", "per_date_under")
    for run_id, best in (("a", "first"), ("b", "other"), ("a", "second")):
        runs.record(runs._with_facts(facts, {"run_id": run_id, "best_model": best}), path)
    found = runs.runs(spark, path)
    assert {(r.run_id, r.best_model) for r in found.collect()} == {("a", "second"), ("b", "other")}
    assert found.schema.simpleString() == spark.createDataFrame([], runs.RUN).schema.simpleString()


def test_training_writes_its_row_last(spark, dataset, tmp_path, monkeypatch):
    from hostlens.operators import models

    out = str(tmp_path / "out")
    dated = dataset.withColumns({"canonical_hostname": F.col("sample_text"), "hostname": F.col("sample_text")})
    for c in ("registered_domain", "subdomain", "suffix"):
        dated = dated.withColumn(c, F.lit(""))
    names = ("logistic_regression",)
    monkeypatch.setattr(models.Scorer, "save", lambda *_: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        batch.train(dated, "domain", out, sizes=models.SMALL, names=names)
    assert not (tmp_path / "out" / "runs").exists()
    monkeypatch.undo()
    batch.train(dated, "domain", out, sizes=models.SMALL, names=names, input_path="in.parquet")
    row = runs.runs(spark, f"{out}/runs").first()
    assert (row.run_id, row.kind, row.input_path, row.selection_metric, row.best_model) == ("domain-default", "domain", "in.parquet", "pr_auc", "logistic_regression")
    assert row.candidate_models == ["logistic_regression"] and 0 <= row.test_results[0].pr_auc <= 1 and row.artifacts["model"] == f"{out}/model" and row.finished_at
    assert row.balance_strategy == "per_date_under"
