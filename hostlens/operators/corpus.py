"""Clean master corpus and the two model datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.functions.text import clean_text
from hostlens.operators.dedup import keep_first
from hostlens.operators.joins import HOT_KEY_ROWS, drop_marked
from hostlens.operators.parse import parse_records, split_valid
from hostlens.schemas import CLEAN, DOMAIN_DATASET, URL_DATASET, align, require_columns
from hostlens.sources.suffix_rules import SuffixRules


def iso_day(c: Column | str) -> Column:
    return F.date_format(F.to_date(c), "yyyy-MM-dd")


def feed_order() -> list[Column]:
    """Full order behind every keep-first: day, positives first, then fixed tie-breaks."""
    return [
        F.col("collected_at").asc(),
        F.col("label").desc(),
        *[
            F.col(c).asc_nulls_last()
            for c in ("source", "source_rank", "original_value", "source_record_id", "source_target")
        ],
    ]


def identity() -> Column:
    """What makes a row unique: the host of a domain row, the canonical URL of a URL row."""
    return F.when(F.col("record_type") == "domain", F.col("canonical_hostname")).otherwise(F.col("canonical_url"))


def parse_normalized(normalized: DataFrame, rules: SuffixRules | None = None) -> DataFrame:
    require_columns(
        normalized, ["original_value", "label", "source", "collected_at", "record_type"], "normalized dataset"
    )
    return parse_records(normalized.withColumn("collected_at", iso_day("collected_at")), rules=rules)


def host_conflicts(rows: DataFrame) -> DataFrame:
    """Per host: row count, and whether both labels occur (its benign rows are then dropped).

    A shared canonical URL implies a shared host, so this one test on hosts also covers the test
    on URLs.  One aggregate with map-side combine; a hot host costs one row per map task.
    """
    # The join adds this null test to one of its two readers; stated here, both share one shuffle.
    return rows.where(F.col("canonical_hostname").isNotNull()).groupBy("canonical_hostname").agg(
        F.count("*").alias("n"),
        ((F.max(F.col("label") == 1)) & (F.max(F.col("label") == 0))).alias("marked"),
        F.count_if(F.col("label") == 0).alias("benign"),
    )


def remove_overlap(rows: DataFrame, stats: DataFrame | None = None, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Drop benign rows whose host also occurs with a phishing label."""
    stats = host_conflicts(rows) if stats is None else stats
    return drop_marked(
        rows,
        "canonical_hostname",
        stats,
        spread_by=F.concat_ws("|", "record_type", identity()),
        hot_rows=hot_rows,
        only=F.col("label") == 0,
    )


def valid_rows(parsed: DataFrame) -> DataFrame:
    return split_valid(parsed).where(F.col("record_type").isin("domain", "url"))


def clean(parsed: DataFrame, hot_rows: int = HOT_KEY_ROWS, hosts: DataFrame | None = None) -> DataFrame:
    """Clean master corpus from parsed rows (`parse_normalized`, materialised at scale); `hosts` are their `host_conflicts`, if at hand.

    Keep-first runs per (identity, label) *before* the overlap test, which then sees far fewer
    rows.  The result is the same as testing first: rows of one identity share their host, so
    after the test at most one label is left per identity.
    """
    valid = valid_rows(parsed)
    firsts = keep_first(valid, [F.col("record_type"), identity(), F.col("label")], feed_order())
    return align(remove_overlap(firsts, host_conflicts(valid) if hosts is None else hosts, hot_rows), CLEAN)


def clean_stats(parsed: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Stage counters as one row: input, invalid, overlap, duplicates, output, classes, types."""
    total = parsed.agg(
        F.count("*").alias("input_rows"),
        F.count_if(~F.col("parse_ok")).alias("invalid_rows_removed"),
        F.lit(0).cast("long").alias("kept_rows"),
        F.lit(0).cast("long").alias("output_rows"),
        *[F.lit(0).cast("long").alias(c) for c in ("benign_rows", "phishing_rows", "domain_rows", "url_rows")],
    )
    valid = valid_rows(parsed)
    counted = valid.groupBy("record_type", identity().alias("canonical_url"), "canonical_hostname", "label").agg(
        F.count("*").alias("rows")
    )
    kept = remove_overlap(counted, host_conflicts(valid), hot_rows).agg(
        F.lit(0).cast("long").alias("input_rows"),
        F.lit(0).cast("long").alias("invalid_rows_removed"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("kept_rows"),
        F.count("*").alias("output_rows"),
        F.count_if(F.col("label") == 0).alias("benign_rows"),
        F.count_if(F.col("label") == 1).alias("phishing_rows"),
        F.count_if(F.col("record_type") == "domain").alias("domain_rows"),
        F.count_if(F.col("record_type") == "url").alias("url_rows"),
    )
    sums = total.unionByName(kept).agg(*[F.sum(c).alias(c) for c in total.columns])
    parsed_rows = F.col("input_rows") - F.col("invalid_rows_removed")
    return sums.select(
        "input_rows",
        "invalid_rows_removed",
        (parsed_rows - F.col("kept_rows")).alias("overlap_rows_removed"),
        (F.col("kept_rows") - F.col("output_rows")).alias("deduplicated_rows_removed"),
        "output_rows",
        "benign_rows",
        "phishing_rows",
        "domain_rows",
        "url_rows",
    )


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("phishing")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("rows"))


def addon_rows(addon: DataFrame, rules: SuffixRules | None = None) -> DataFrame:
    """Curated benign hosts as domain dataset rows; blank source and date get defaults."""
    require_columns(addon, ["input_value"], "benign domain addon")

    def or_default(name: str, default: str) -> Column:
        have = F.nullif(clean_text(name), F.lit("")) if name in addon.columns else F.lit(None)
        return F.coalesce(have, F.lit(default))

    rows = addon.select(
        F.col("input_value"),
        F.lit("domain").alias("record_type"),
        or_default("source", V.ADDON_SOURCE).alias("source"),
        or_default("collected_at", V.ADDON_DATE).alias("collected_at"),
        F.lit(0).alias("label"),
    )
    parsed = split_valid(parse_records(rows, "input_value", rules=rules))
    return align(parsed.withColumn("sample_text", F.col("canonical_hostname")), DOMAIN_DATASET)


def domain_dataset(clean_rows: DataFrame, addon: DataFrame | None = None) -> DataFrame:
    """One row per host, earliest day first, positives before negatives on the same day.

    Keep-first leaves one row per host, so an overlap test on the same key behind it could not
    match anything and is left out: an earlier benign row evicts a later phishing row.
    """
    require_columns(
        clean_rows,
        ["label", "source", "collected_at", "hostname", "registered_domain", "canonical_hostname"],
        "clean master dataset",
    )
    rows = clean_rows.where("canonical_hostname <> ''").withColumn("sample_text", F.col("canonical_hostname"))
    extra = ["original_value", "source_record_id", "source_target"]
    rows = rows.select(*[f.name for f in DOMAIN_DATASET.fields], *extra)
    if addon is not None:
        rows = rows.unionByName(addon, allowMissingColumns=True)
    return align(keep_first(rows, [F.col("sample_text")], feed_order()), DOMAIN_DATASET)


def url_dataset(clean_rows: DataFrame, unique: bool = False) -> DataFrame:
    """One row per canonical URL.

    Rows straight from `clean` are unique already (`unique=True`): then no shuffle is needed.
    """
    require_columns(
        clean_rows,
        ["label", "source", "collected_at", "canonical_url", "hostname", "path", "query"],
        "clean master dataset",
    )
    rows = clean_rows.where("record_type = 'url' and canonical_url <> ''")
    rows = rows.withColumn("sample_text", F.col("canonical_url"))
    if not unique:
        rows = keep_first(rows, [F.col("sample_text")], feed_order())
    return align(rows, URL_DATASET)


def from_date(df: DataFrame, floor: str) -> DataFrame:
    """Dataset variant: only days at or after the floor."""
    return df.where(F.col("collected_at") >= floor)
