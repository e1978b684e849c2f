"""Explicit schema of every stage hand-off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "strings": T.ArrayType(T.StringType()),
    "map": T.MapType(T.StringType(), T.StringType()),
}


def _struct(text: str) -> T.StructType:
    """Schema from `name type, ...` without needing a session."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, _SIMPLE[kind]) for name, kind in pairs])


NORMALIZED = _struct(
    "original_value string, label int, source string, collected_at string, record_type string, "
    "source_record_id string, source_rank long, source_target string"
)
PARSED_FIELDS = _struct(
    "scheme string, hostname string, subdomain string, domain string, suffix string, "
    "registered_domain string, path string, query string, fragment string, is_ip_host int, "
    "canonical_domain string, canonical_hostname string, canonical_registered_domain string, "
    "canonical_url string, parse_ok boolean, invalid_reason string"
)
CLEAN = T.StructType(NORMALIZED.fields + PARSED_FIELDS.fields[:-2])
DOMAIN_DATASET = _struct(
    "sample_text string, label int, source string, collected_at string, record_type string, "
    "hostname string, registered_domain string, subdomain string, suffix string, is_ip_host int, "
    "canonical_hostname string, canonical_registered_domain string, source_rank long"
)
# `subdomain` is carried on purpose: without it two URL features are constant in training only.
URL_DATASET = _struct(
    "sample_text string, label int, source string, collected_at string, hostname string, "
    "registered_domain string, subdomain string, path string, query string, fragment string, "
    "scheme string, is_ip_host int, canonical_hostname string, canonical_url string"
)
VALIDATION_SEED = _struct(
    "sample_id string, category string, dataset_kind string, input_value string, "
    "expected_label string, priority string, note string"
)
SITE_SEED = _struct(
    "seed_id string, category string, source_name string, homepage_url string, note string"
)
ADDON_ROW = _struct(
    "sample_id string, category string, source_name string, seed_id string, seed_homepage_url string, "
    "dataset_kind string, input_value string, expected_label string, discovery_method string, "
    "hostname string, registered_domain string, note string"
)
NEWS_ROW = _struct(
    "url string, publisher string, publisher_base_url string, sitemap_url string, "
    "publication_date string, lastmod string, title string, collected_at string"
)
PHISH_ENTRY = _struct("url string, phish_id string, target string")
EVENT = _struct(
    "event_id string, received_at string, dataset_kind string, source string, raw_value string, "
    "normalized_value string, predicted_label int, predicted_class string, score double, "
    "score_source string, risk_level string, model_name string, variant_name string, "
    "feature_count int, recommendation string, signals strings"
)
EVENT = T.StructType(
    EVENT.fields
    + [
        T.StructField(
            "parsed",
            _struct("hostname string, registered_domain string, subdomain string, suffix string, path string, query string"),
        ),
        T.StructField("metadata", T.VariantType()),
    ]
)


def require_columns(df: DataFrame, names, what: str) -> DataFrame:
    """Fail at plan time, without a job, when a stage input lacks columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
    return df


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, casting, and adding absent ones as null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
