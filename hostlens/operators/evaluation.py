"""Validation of scored seeds: flags, grouped summaries, worst cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.rules import expected_label_int

GROUPS = ("dataset_kind", "priority", "category")
MAX_ISSUES = 10


def confusion_flags(df: DataFrame) -> DataFrame:
    """Add expected_label_int, match and error flags; an error row (label -1) never matches."""
    want = F.col("expected_label_int")
    got = F.col("predicted_label")
    return df.withColumn("expected_label_int", expected_label_int("expected_label")).withColumns(
        {
            "match_expected": got == want,
            "is_false_positive": (want == 0) & (got == 1),
            "is_false_negative": (want == 1) & (got == 0),
        }
    )


def _measures() -> list[Column]:
    n = F.count("sample_id")
    matched, fp, fn = (F.count_if(c) for c in ("match_expected", "is_false_positive", "is_false_negative"))
    return [
        n.alias("total_cases"),
        matched.alias("matched_cases"),
        F.count_if(F.col("predicted_label") == 0).alias("predicted_benign"),
        F.count_if(F.col("predicted_label") == 1).alias("predicted_phishing"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
        F.avg("score").alias("average_score"),
        *[
            F.when(n > 0, c / n).otherwise(0.0).alias(name)
            for c, name in ((fp, "false_positive_rate"), (fn, "false_negative_rate"), (matched, "match_rate"))
        ],
    ]


def group_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cases, hits, errors, mean score and rates per group; a null group is kept."""
    return df.groupBy(*columns).agg(*_measures())


def overall_summary(df: DataFrame) -> DataFrame:
    return df.agg(*_measures())


def all_summaries(df: DataFrame, groups=GROUPS) -> DataFrame:
    """Every single-column summary and the overall one in one pass (grouping sets).

    `grouped_by` names the column, so a null key is told apart from a column not grouped.
    """
    sets = [[g] for g in groups] + [[]]
    out = df.groupingSets(sets, *groups).agg(
        *_measures(), *[F.grouping(g).alias(f"__off_{g}") for g in groups]
    )
    name, key = F.lit("overall"), F.lit(None).cast("string")
    for g in groups:
        name = F.when(F.col(f"__off_{g}") == 0, g).otherwise(name)
        key = F.when(F.col(f"__off_{g}") == 0, F.col(g)).otherwise(key)
    measures = [c for c in out.columns if c not in groups and not c.startswith("__off_")]
    return out.select(name.alias("grouped_by"), key.alias("group_key"), *measures)


def evaluation_mode(df: DataFrame) -> DataFrame:
    text = F.lower(F.trim(F.col("expected_label")))
    return df.agg(F.min(text).alias("__a"), F.max(text).alias("__b")).select(
        F.when((F.col("__a") == "benign") & (F.col("__b") == "benign"), "benign_only")
        .when((F.col("__a") == "phishing") & (F.col("__b") == "phishing"), "phishing_only")
        .otherwise("mixed")
        .alias("evaluation_mode")
    )


def top_issues(df: DataFrame, mode: str, limit: int = MAX_ISSUES) -> DataFrame:
    """Worst cases by priority; missed phishing lists the lowest scores first."""
    if mode == "benign_only":
        wrong, by_score = F.col("is_false_positive"), F.col("score").desc_nulls_last()
    elif mode == "phishing_only":
        wrong, by_score = F.col("is_false_negative"), F.col("score").asc_nulls_last()
    elif mode == "mixed":
        wrong, by_score = ~F.col("match_expected"), F.col("score").desc_nulls_last()
    else:
        raise ValueError(f"unknown evaluation mode: {mode}")
    return df.where(wrong).orderBy(F.col("priority").asc_nulls_last(), by_score, "sample_id").limit(limit)
