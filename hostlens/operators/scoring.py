"""Score a table or stream of hosts and URLs into events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.functions import hosts, rules
from hostlens.functions.text import clean_text
from hostlens.operators.features import feature_names, features
from hostlens.operators.parse import parse_records
from hostlens.schemas import EVENT
from hostlens.sources.suffix_rules import SuffixRules

KINDS = ("domain", "url")
_PARSED = ("hostname", "registered_domain", "subdomain", "suffix", "path", "query")


def check_requests(df: DataFrame, value: str = "value", kind: str = "dataset_kind", source: str = "source") -> DataFrame:
    """Normalise requests and add `reject_reason` (empty when acceptable)."""
    have = set(df.columns)
    wanted = F.lower(clean_text(kind)) if kind in have else F.lit("")
    sent_by = clean_text(source) if source in have else F.lit("")
    out = df.withColumns(
        {
            "raw_value": clean_text(value),
            "requested_kind": F.coalesce(F.nullif(wanted, F.lit("")), F.lit("auto")),
            "source": F.coalesce(F.nullif(sent_by, F.lit("")), F.lit("ids_sensor")),
        }
    )
    reason = (
        F.when(F.col("raw_value") == "", "`value` is required.")
        .when(~F.col("requested_kind").isin("auto", *KINDS), "`dataset_kind` must be one of: auto, domain, url.")
        .otherwise("")
    )
    return out.withColumn("reject_reason", reason)


def wrap_metadata(raw: Column) -> Column:
    """Metadata text as a variant, with numbers, lists and nested objects as they are; anything but a JSON object is kept as text under `raw_metadata`."""
    parsed = F.try_parse_json(raw)
    is_object = F.coalesce(raw.rlike(r"^\s*\{"), F.lit(False)) & parsed.isNotNull()
    return F.when(raw.isNull(), no_metadata()).when(is_object, parsed).otherwise(F.parse_json(F.to_json(F.create_map(F.lit("raw_metadata"), raw))))


def no_metadata() -> Column:
    return F.parse_json(F.lit("{}"))


def parse_for_scoring(df: DataFrame, kind: str, rules_: SuffixRules | None = None) -> DataFrame:
    """Parsed rows of one kind with `sample_text` and `error`.

    A value asked for as a domain that only parses as a URL is taken by its host.  The choice is
    made on the host test alone, so every value is parsed once.
    """
    typed = df.withColumn("__as", F.lit("url"))
    if kind == "domain":
        typed = df.withColumn("__own", hosts.host_text("raw_value")).withColumn("__own", hosts.encoded_host("__own"))
        typed = typed.withColumn("__as", F.when(hosts.is_valid_host("__own"), "domain").otherwise("url"))
    domain_reason = F.when(F.col("__own").isNull(), "invalid_domain").otherwise("invalid_hostname")
    parsed = parse_records(typed, "raw_value", "__as", rules_)
    if kind == "domain":
        text = F.col("canonical_hostname")
        reason = F.when(F.col("invalid_reason") == "empty_value", "empty_value").otherwise(domain_reason)
        message = F.concat(F.lit("Could not parse domain input. Reason: "), reason)
    else:
        text = F.col("canonical_url")
        message = F.concat(F.lit("Could not parse URL input. Reason: "), F.col("invalid_reason"))
    return parsed.withColumns(
        {"sample_text": text, "error": F.when(F.col("parse_ok"), F.lit("")).otherwise(message)}
    ).drop("__as", "__own")


def _score_kind(df: DataFrame, kind: str, scorer, rules_: SuffixRules | None) -> DataFrame:
    parsed = parse_for_scoring(df, kind, rules_)
    scored = scorer.normalized(features(parsed, kind))
    ok = F.col("parse_ok")
    score = F.when(ok, F.round("score", 6))
    risk = F.when(ok, rules.risk_level("score"))
    label = F.when(ok, F.col("prediction")).otherwise(F.lit(-1))
    signals = rules.domain_signals() if kind == "domain" else rules.url_signals()
    return scored.select(
        *df.columns,
        F.col("error"),
        F.when(ok, F.col("sample_text")).alias("normalized_value"),
        label.cast("int").alias("predicted_label"),
        F.when(~ok, "error").when(label == 1, "phishing").otherwise("benign").alias("predicted_class"),
        score.alias("score"),
        F.lit(scorer.score_source).alias("score_source"),
        risk.alias("risk_level"),
        F.when(ok, F.lit(scorer.name)).alias("model_name"),
        F.when(ok, F.lit(scorer.variant)).alias("variant_name"),
        F.lit(len(feature_names(kind))).alias("feature_count"),
        F.when(ok, rules.recommendation(label, risk)).alias("recommendation"),
        F.when(ok, signals).otherwise(F.array().cast("array<string>")).alias("signals"),
        F.struct(*[F.col(c).alias(c) for c in _PARSED]).alias("parsed"),
    )


def score_table(df: DataFrame, scorers: dict, rules_: SuffixRules | None = None) -> DataFrame:
    """Score every request row: as many rows go out as come in.

    `df` needs raw_value and dataset_kind (domain / url).  Rows that cannot be parsed, or whose kind is
    another or null, stay with label -1 and the error.  Each kind is one branch behind a filter on the raw
    input, so a row is parsed and scored exactly once, with its own model only.  Works the same on a stream.
    """
    parts = [_score_kind(df.where(F.col("dataset_kind") == k), k, scorers[k], rules_) for k in KINDS]
    scored = parts[0].unionByName(parts[1])
    other = df.where(~F.coalesce(F.col("dataset_kind").isin(*KINDS), F.lit(False)))
    filled = {
        "error": F.concat(F.lit("'"), F.coalesce("dataset_kind", F.lit(V.NO_KIND)), F.lit("'")),
        "predicted_label": F.lit(-1), "predicted_class": F.lit("error"), "feature_count": F.lit(0), "signals": F.array(),
    }
    columns = [filled.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in scored.schema.fields]
    return scored.unionByName(other.select(*columns))


def judge_requests(df: DataFrame, scorers: dict, rules_: SuffixRules | None = None) -> DataFrame:
    """Raw requests (value, optional dataset_kind, source, metadata as JSON text), each with scores or a `reject_reason`."""
    checked = check_requests(df)
    metadata = wrap_metadata(F.col("metadata")) if "metadata" in df.columns else no_metadata()
    received = (
        F.col("received_at").cast("string") if "received_at" in df.columns
        else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    )
    common = [received.alias("received_at"), "source", "raw_value", metadata.alias("metadata"), "requested_kind", "reject_reason"]
    good = checked.where("reject_reason = ''").select(
        F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("event_id"), rules.detect_kind("raw_value", "requested_kind").alias("dataset_kind"), *common,
    )
    scored = score_table(good, scorers, rules_)
    scored = scored.withColumn("reject_reason", F.col("error"))
    refused = checked.where("reject_reason <> ''").select(*common)
    return scored.unionByName(refused, allowMissingColumns=True)


def as_rejects(judged: DataFrame) -> DataFrame:
    return judged.where("reject_reason <> ''").select("received_at", "source", "raw_value", "requested_kind", "metadata", "reject_reason")


def score_requests(df: DataFrame, scorers: dict, rules_: SuffixRules | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of raw requests: every request is in one of them, rejects with their reason."""
    judged = judge_requests(df, scorers, rules_)
    return as_events(judged), as_rejects(judged)


def as_events(scored: DataFrame) -> DataFrame:
    """Scored rows without an error in the event log schema."""
    return scored.where("error = ''").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT.fields])


def score_seed(seed: DataFrame, scorers: dict, rules_: SuffixRules | None = None) -> DataFrame:
    """Validation seed rows with their scores (see `evaluation.confusion_flags`)."""
    return score_table(seed.withColumn("raw_value", clean_text("input_value")), scorers, rules_)
