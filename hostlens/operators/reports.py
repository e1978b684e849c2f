"""Review tables and event summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

def label_distribution(df: DataFrame, by: str, largest_first: bool) -> DataFrame:
    out = df.groupBy(by).agg(
        F.count_if(F.col("label") == 0).alias("benign_count"),
        F.count_if(F.col("label") == 1).alias("phishing_count"),
    )
    total = F.col("benign_count") + F.col("phishing_count")
    out = out.withColumn("total_rows", total).withColumn(
        "phishing_ratio", F.col("phishing_count") / F.greatest(F.col("total_rows"), F.lit(1))
    )
    return out.orderBy(F.col("total_rows").desc(), by) if largest_first else out.orderBy(by)


def dataset_overview(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset: size, classes, sources, days."""
    def one(name: str, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        zero = F.lit(0).cast("long")
        rows = F.count("*")
        phishing = F.count_if(F.col("label") == 1) if "label" in have else zero
        benign = F.count_if(F.col("label") == 0) if "label" in have else zero
        dated = "collected_at" in have
        return df.agg(
            rows.alias("rows"),
            F.lit(len(df.columns)).alias("columns"),
            phishing.alias("phishing_rows"),
            benign.alias("benign_rows"),
            F.when(rows > 0, phishing / rows).otherwise(0.0).alias("phishing_ratio"),
            (F.countDistinct("source") if "source" in have else zero).alias("unique_sources"),
            (F.countDistinct("collected_at") if dated else zero).alias("unique_dates"),
            F.coalesce(F.min("collected_at").cast("string") if dated else F.lit(""), F.lit("")).alias("min_date"),
            F.coalesce(F.max("collected_at").cast("string") if dated else F.lit(""), F.lit("")).alias("max_date"),
        ).select(F.lit(name).alias("dataset_name"), "*")

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in frames.items()])


def _countable(f: StructField) -> Column:
    """The column as something that can be told apart: maps and variants as their JSON text."""
    return F.to_json(f.name) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`")


def _profile(figures: DataFrame, unique: Column) -> DataFrame:
    total = F.col("rows")
    missing = total - F.col("non_null_count")
    return figures.select(
        "column_name", "dtype", missing.alias("null_count"), "non_null_count",
        F.when(total > 0, missing / total).otherwise(0.0).alias("null_ratio"), unique.alias("unique_non_null_values"),
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, non-nulls, null share, exact distinct non-null values.

    One pass: values keep their types, and repeats of a value are combined before the shuffle, so its size follows the number of
    different values per task.  Where that is too much, `profile_sketches` is the approximate form.
    """
    fields = df.schema.fields
    one = df.agg(
        F.count("*").alias("rows"), *[F.count(f"`{f.name}`").alias(f"n{i}") for i, f in enumerate(fields)],
        *[F.count_distinct(_countable(f)).alias(f"u{i}") for i, f in enumerate(fields)],
    )
    each = [
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").alias("non_null_count"), F.col(f"u{i}").alias("u"))
        for i, f in enumerate(fields)
    ]
    return _profile(one.select("rows", F.inline(F.array(*each))), F.col("u"))


#: Sketches of 2^14 registers: a standard error of 0.8 % of the number of distinct values.
SKETCH_LOG_K = 14


def profile_sketches(df: DataFrame, by: list[str]) -> DataFrame:
    """`by`, column_name, dtype, rows, non_null_count, sketch: what `merged_profile` needs of each part of a table (such as a day)."""
    fields = [f for f in df.schema.fields if f.name not in by]
    plain = ("integer", "long", "string", "binary")
    sketched = [_countable(f) if f.dataType.typeName() in plain else _countable(f).cast("string") for f in fields]
    parts = df.groupBy(*by).agg(
        F.count("*").alias("rows"), *[F.count(f"`{f.name}`").alias(f"n{i}") for i, f in enumerate(fields)],
        *[F.hll_sketch_agg(c, F.lit(SKETCH_LOG_K)).alias(f"s{i}") for i, c in enumerate(sketched)],
    )
    each = [
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").alias("non_null_count"), F.col(f"s{i}").alias("sketch"))
        for i, f in enumerate(fields)
    ]
    return parts.select(*by, "rows", F.inline(F.array(*each)))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """`column_profile` over all parts, with the distinct values estimated from merged sketches: no part's rows are read."""
    merged = sketches.groupBy("column_name", "dtype").agg(
        F.sum("rows").alias("rows"), F.sum("non_null_count").alias("non_null_count"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("u")
    )
    return _profile(merged, F.col("u"))


def event_summary(events: DataFrame) -> DataFrame:
    """Counters over an event log, batch or streaming: one aggregate, one row."""
    return events.agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("predicted_label") == 1).alias("phishing_events"),
        (F.count("*") - F.count_if(F.col("predicted_label") == 1)).alias("benign_events"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_events"),
        F.count_if(F.col("dataset_kind") == "domain").alias("domain_events"),
        F.count_if(F.col("dataset_kind") == "url").alias("url_events"),
        F.max("received_at").alias("latest_event_at"),
    )


def recent_events(events: DataFrame, limit: int = 100) -> DataFrame:
    """The `limit` newest events, newest first.  A top-k per task, then of those: no full sort."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    return events.orderBy(F.col("received_at").desc(), "event_id").limit(limit)
