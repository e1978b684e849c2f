"""One table of runs: what went into a training or validation run, and what came out.

A run's row is written last, by its id: it is there only if the run ended, and a run that is tried again replaces its own row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators import evaluation, sampling
from hostlens.operators.features import feature_names

_CLASSES = "struct<benign:bigint,phishing:bigint>"
_METRICS = "array<struct<model:string,precision:double,recall:double,f1:double,roc_auc:double,pr_auc:double>>"
_DAYS = "array<struct<collected_at:string,original_benign:bigint,original_phishing:bigint,balanced_benign:bigint,balanced_phishing:bigint,rows_removed:bigint>>"
TRAINING = (
    f"before {_CLASSES}, after {_CLASSES}, balancing {_DAYS}, dropped_dates array<string>, "
    "splits array<struct<split:string,rows:bigint,benign:bigint,phishing:bigint,dates:array<string>>>, feature_columns array<string>"
)
RUN = (
    "run_id string, finished_at string, kind string, input_path string, selection_metric string, best_model string, candidate_models array<string>, "
    f"balance_strategy string, {TRAINING}, validation_results {_METRICS}, test_results {_METRICS}, artifacts map<string,string>"
)
_SPLITS = ("train", "val", "test")


def training_facts(dataset: DataFrame, rows: DataFrame, kind: str, strategy: str) -> DataFrame:
    """One row of counts and days: `dataset` as it came in, `rows` as split and balanced.

    Two small aggregates by day; the driver sees days, never rows.
    """
    days = sorted(sampling.date_labels(dataset).collect(), key=lambda r: str(r["collected_at"]))
    parts = rows.groupBy("split", "collected_at").agg(
        F.count("*").alias("rows"), F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("phishing")
    )
    kept = sorted(parts.collect(), key=lambda r: str(r["collected_at"]))
    both = [r for r in days if r["benign"] and r["phishing"]]
    balanced = []
    if strategy == "per_date_under":
        for r in both:
            least = min(r["benign"], r["phishing"])
            balanced.append((str(r["collected_at"]), r["benign"], r["phishing"], least, least, r["benign"] + r["phishing"] - 2 * least))
    splits = []
    for name in _SPLITS:
        own = [r for r in kept if r["split"] == name]
        splits.append((name, *[sum(r[c] for r in own) for c in ("rows", "benign", "phishing")], [str(r["collected_at"]) for r in own]))
    total = lambda of: tuple(sum(r[c] for r in of) for c in ("benign", "phishing"))
    dropped = [str(r["collected_at"]) for r in days if not (r["benign"] and r["phishing"])]
    row = (total(days), total(kept), balanced, dropped, splits, list(feature_names(kind)))
    return dataset.sparkSession.createDataFrame([row], TRAINING)


def _metrics(table: DataFrame) -> list[tuple]:
    names = ("model", "precision", "recall", "f1", "roc_auc", "pr_auc")
    return [tuple(r[n] for n in names) for r in table.select(*names).collect()]  # one row per candidate


def _with_facts(facts: DataFrame, known: dict[str, object]) -> DataFrame:
    schema = facts.sparkSession.createDataFrame([], RUN).schema
    return facts.select(*[(F.col(f.name) if f.name in facts.columns else _literal(known.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])


def _literal(value):
    if isinstance(value, dict):
        return F.create_map(*[F.lit(x) for pair in value.items() for x in pair])
    if isinstance(value, list):
        return F.array(*[F.struct(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v) for v in value])
    return F.lit(value)


def training_run(facts: DataFrame, run_id: str, kind: str, strategy: str, by: str, result, input_path: str, artifacts: dict[str, str]) -> DataFrame:
    """The row of a training run, from its facts and its `models.Comparison`."""
    validation, test = _metrics(result.validation), _metrics(result.test)
    known = {
        "run_id": run_id, "kind": kind, "input_path": input_path, "selection_metric": by, "best_model": result.best.name, "candidate_models": [m[0] for m in validation],
        "balance_strategy": strategy if kind == "domain" else None, "validation_results": validation, "test_results": test, "artifacts": artifacts,
    }
    return _with_facts(facts, known).withColumn("finished_at", _now())


def _now():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def record(run: DataFrame, path: str) -> None:
    """Append the row, or replace that of the same run."""
    run.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """All finished runs, oldest first."""
    table = spark.read.schema(RUN).parquet(path)
    return table.select("run_id", *[c for c in table.columns if c != "run_id"]).orderBy("finished_at", "run_id")


def validation_summary(details: DataFrame, input_path: str, artifacts: dict[str, str]) -> DataFrame:
    """The overall figures of a validation run, with its mode, its input and where its tables lie."""
    overall = evaluation.overall_summary(details)
    known = {k: _literal(v) for k, v in (("input_path", input_path), ("details_path", artifacts.get("details")), ("artifacts", artifacts))}
    return overall.crossJoin(evaluation.evaluation_mode(details)).withColumns({"evaluated_at": _now(), **known})  # one row each
