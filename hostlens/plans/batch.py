"""Whole batch flows: corpus, training, validation, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.operators import corpus, counters, evaluation, metrics, models, reports, sampling, scoring, seeds
from hostlens.operators.parse import parse_records
from hostlens.plans import runs
from hostlens.schemas import CLEAN
from hostlens.session import Stages, materialize, path_exists
from hostlens.sources import feeds, sinks, tables


def observed_clean(parsed: DataFrame, path: str) -> DataFrame:
    """Write parsed rows and the clean master below `path`; the stage statistics come from the writes themselves.

    `parsed` is computed once, for its write; the table of hosts behind the overlap test is written as well, as it is small and
    says how many rows the test drops.
    """
    spark = parsed.sparkSession
    of_parsed = sinks.write_stage(parsed, f"{path}/parsed", None, counters=counters.of_parsed())
    rows = tables.scan_stage(spark, f"{path}/parsed", parsed.schema)
    hosts = corpus.host_conflicts(corpus.valid_rows(rows))
    of_hosts = sinks.write_stage(hosts, f"{path}/hosts", None, counters=counters.of_hosts())
    clean = corpus.clean(rows, hosts=tables.scan_stage(spark, f"{path}/hosts", hosts.schema))
    of_clean = sinks.write_stage(clean, f"{path}/clean", order=("source", "original_value"), counters=counters.of_clean())
    sinks.write_stats(counters.as_rows(spark, of_parsed, "invalid_reason"), f"{path}/invalid_reasons")
    stats = counters.clean_stats(spark, of_parsed, of_hosts, of_clean)
    sinks.write_stats(stats, f"{path}/clean_stats")
    return stats


def build_corpus(spark: SparkSession, raw_dir: str, out: str, sources=V.DEFAULT_FEEDS, allow_opt_in=(), addon_dir: str | None = None, **window) -> None:
    """Raw feeds to clean master and both datasets, with their statistics.

    Every stage is written once, and its counters are observed in that write.
    """
    normalized = feeds.normalize(spark, raw_dir, sources, allow_opt_in, **window)
    sinks.write_stage(normalized, f"{out}/normalized")
    observed_clean(corpus.parse_normalized(tables.scan_stage(spark, f"{out}/normalized", normalized.schema)), out)
    master = tables.scan_stage(spark, f"{out}/clean", CLEAN)
    addon = corpus.addon_rows(tables.scan_addon_dir(spark, addon_dir)) if addon_dir else None
    # Sources are known before: the feeds chosen, and those that the curated files name.
    names = [*sources, *([r["source"] for r in addon.select("source").distinct().collect()] if addon else [])]
    for name, df in (("domain", corpus.domain_dataset(master, addon)), ("url", corpus.url_dataset(master, unique=True))):
        of_dataset = counters.of_labels() | counters.per_value("source", dict.fromkeys(names))
        found = sinks.write_stage(df, f"{out}/{name}_dataset", order=("sample_text",), counters=of_dataset)
        sinks.write_stats(spark.createDataFrame([(found["benign"], found["phishing"])], "benign long, phishing long"), f"{out}/{name}_stats")
        sinks.write_stats(counters.as_rows(spark, found, "source"), f"{out}/{name}_sources")


def usable_rows(dataset: DataFrame, floor: str | None = None) -> DataFrame:
    """Rows from the first day wanted, of days that hold both classes."""
    rows = dataset if floor is None else corpus.from_date(dataset, floor)
    return sampling.drop_single_class_dates(rows)


def training_rows(dataset: DataFrame, kind: str, strategy: str = "per_date_under", floor: str | None = None) -> DataFrame:
    """Both-class days, balanced (domain only), tagged by split."""
    rows = usable_rows(dataset, floor)
    if kind == "domain":
        rows = sampling.balance(rows, strategy)
    return sampling.temporal_split(rows)


def train(
    dataset: DataFrame, kind: str, out: str, variant: str = "default", by: str = "pr_auc", strategy: str = "per_date_under", sizes: models.Sizes = models.Sizes(),
    names=V.MODEL_ORDER, write_splits: bool = False, run_id: str | None = None, input_path: str = "",
) -> models.Comparison:
    """Train, compare and save; the run's row goes last to `runs` below `out`, under `run_id` (by default kind and variant)."""
    sampling.check_labels(dataset)
    with Stages():
        rows = materialize(training_rows(dataset, kind, strategy), "split_rows")
        if write_splits:
            sinks.write_splits(rows, f"{out}/{kind}_splits")
        result = models.train_compare(rows, kind, variant, by, sizes, names)
        facts = runs.training_facts(dataset, rows, kind, strategy if kind == "domain" else "none")
        tables_ = {"validation_metrics": result.validation, "test_metrics": result.test, "model_comparison": result.comparison}
        for name, df in tables_.items():
            sinks.write_table_csv(df, f"{out}/{name}")
        sinks.write_stats(result.splits, f"{out}/splits")
        sinks.write_stats(sampling.balance_summary(usable_rows(dataset), rows, strategy if kind == "domain" else "none"), f"{out}/balance")
        result.best.save(f"{out}/model")
        artifacts = {n: f"{out}/{n}" for n in (*tables_, "splits", "balance", "model")}
        runs.record(runs.training_run(facts, run_id or f"{kind}-{variant}", kind, strategy, by, result, input_path, artifacts), f"{out}/runs")
    return result


def validate(seed: DataFrame, scorers: dict, out: str, run_ts: str, input_path: str = "") -> dict[str, DataFrame]:
    """Score a seed table, then write details, grouped summaries and worst cases."""
    details = materialize(evaluation.confusion_flags(scoring.score_seed(seed, scorers)), "validation")
    mode = evaluation.evaluation_mode(details).first()[0]
    result = {
        "details": details.drop("parsed"),
        **{f"by_{g}": evaluation.group_summary(details, [g]) for g in evaluation.GROUPS},
        "top_issues": evaluation.top_issues(details, mode).drop("parsed"),
    }
    result["summary"] = runs.validation_summary(details, input_path, {n: f"{out}/run_ts={run_ts}/{n}" for n in result})
    for name, df in result.items():
        sinks.write_table_csv(df, f"{out}/run_ts={run_ts}/{name}")
    return result


def phishing_seed(spark: SparkSession, snapshot_dir: str, out: str, max_pairs: int = 15, max_per_category: int = 4) -> DataFrame:
    lines = feeds.latest_snapshot(spark, snapshot_dir)
    parsed = parse_records(lines.withColumn("record_type", F.lit("url")), "value")
    first = lines.select("snapshot").first()
    name = first[0] if first else "(empty)"
    picked = seeds.round_robin(seeds.seed_candidates(parsed, [F.col("position")]), max_pairs, max_per_category)
    rows = seeds.seed_rows(picked, name)
    sinks.write_table_csv(rows, out)
    return rows


def review_tables(dataset: DataFrame, splits: DataFrame, kind: str, out: str) -> None:
    """Overview, label distributions and column profile as tables."""
    frames = {f"{kind}_model_dataset": dataset}
    frames |= {f"{kind}_{s}": splits.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
    sinks.write_table_csv(reports.dataset_overview(frames), f"{out}/{kind}_dataset_overview")
    sinks.write_table_csv(reports.label_distribution(dataset, "source", True), f"{out}/{kind}_by_source")
    sinks.write_table_csv(reports.label_distribution(dataset, "collected_at", False), f"{out}/{kind}_by_date")
    sinks.write_table_csv(reports.column_profile(dataset), f"{out}/{kind}_columns")


def update_profile(dataset: DataFrame, path: str, by: str = "collected_at") -> DataFrame:
    """Profile of a dated dataset that grows by days: only days without a stored sketch are read.

    `path` holds one small sketch row per day and column; a day that is computed again replaces its own folder.
    """
    spark = dataset.sparkSession
    done = [r[by] for r in spark.read.schema(f"`{by}` string").parquet(path).distinct().collect()] if path_exists(spark, path) else []
    # On the dataset's partition column, so that the folders of known days are not even listed for reading.
    fresh = dataset.where(~F.col(by).cast("string").isin(done)) if done else dataset
    new = reports.profile_sketches(fresh.withColumn(by, F.col(by).cast("string")), [by])
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return reports.merged_profile(spark.read.schema(new.schema).parquet(path))


__all__ = ["build_corpus", "training_rows", "train", "validate", "phishing_seed", "review_tables", "observed_clean", "update_profile", "metrics"]
