"""Parse and canonicalise hosts and URLs: a pure column job plus broadcast suffix lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.functions import hosts, urls
from hostlens.functions.text import after_first, clean_text
from hostlens.operators.joins import settled
from hostlens.schemas import PARSED_FIELDS
from hostlens.sources.suffix_rules import EXCEPTION, PLAIN, WILDCARD, SuffixRules, load_suffix_rules

PARSED_COLUMNS = [f.name for f in PARSED_FIELDS.fields]


def host_parts(df: DataFrame, host: str, rules: SuffixRules | None = None) -> DataFrame:
    """Add subdomain, domain, suffix and registered_domain of the column `host`.

    Every tail of the host (last 1..depth labels) is looked up in the rule table by a broadcast
    hash join, so the work stays in the scan's own stage: no explode, no shuffle, no per-row list.
    All joins read the same relation, so Spark builds one broadcast and reuses it.
    """
    rules = rules or load_suffix_rules(df.sparkSession)
    h = F.col(host)
    out = df.withColumn(
        "__labels",
        F.when((F.coalesce(h, F.lit("")) != "") & ~hosts.is_ip(h), F.size(F.split(h, "\\."))).otherwise(F.lit(0)),
    )
    out = out.withColumns(
        {
            f"__tail{k}": F.when(F.col("__labels") >= k, F.substring_index(h, ".", -k))
            for k in range(1, rules.depth + 1)
        }
    )
    for k in range(1, rules.depth + 1):
        out = out.join(rules.table(f"__tail{k}", f"__kind{k}"), f"__tail{k}", "left")

    exception, longest = F.lit(None).cast("int"), F.lit(0)
    for k in range(1, rules.depth + 1):
        kind = F.coalesce(F.col(f"__kind{k}"), F.lit(0))
        exception = F.when(kind.bitwiseAND(EXCEPTION) != 0, F.lit(k - 1)).otherwise(exception)
        longest = F.when(kind.bitwiseAND(PLAIN) != 0, F.lit(k)).otherwise(longest)
        longest = F.when(
            (kind.bitwiseAND(WILDCARD) != 0) & (F.col("__labels") > k), F.lit(k + 1)
        ).otherwise(longest)
    out = out.withColumn("__taken", F.coalesce(exception, longest))

    n, taken = F.col("__labels"), F.col("__taken")
    tail = F.expr(f"substring_index({host}, '.', -__taken)")
    head = F.expr(f"substring_index({host}, '.', __labels - __taken)")
    suffix = F.when(taken > 0, tail).otherwise(F.lit(""))
    named = F.when(n > taken, F.substring_index(head, ".", -1)).otherwise(F.lit(""))
    sub = F.when(n > taken + 1, F.expr(f"substring_index({host}, '.', __labels - __taken - 1)")).otherwise(F.lit(""))
    is_address = (n == 0) & (F.coalesce(h, F.lit("")) != "")
    return (
        out.withColumns(
            {
                "subdomain": F.when(is_address, F.lit("")).otherwise(sub),
                "domain": F.when(is_address, h).otherwise(named),
                "suffix": suffix,
            }
        )
        .withColumn(
            "registered_domain",
            F.concat(
                F.col("domain"),
                F.when((F.col("domain") != "") & (F.col("suffix") != ""), F.lit(".")).otherwise(F.lit("")),
                F.col("suffix"),
            ),
        )
        .drop("__labels", "__taken", *[f"__{x}{k}" for x in ("tail", "kind") for k in range(1, rules.depth + 1)])
    )


def parse_records(
    df: DataFrame,
    value: str = "original_value",
    record_type: str = "record_type",
    rules: SuffixRules | None = None,
) -> DataFrame:
    """Add the 16 parsed columns to every row; rows that cannot be parsed carry a reason.

    Steps are stacked projections, each reading the columns of the step before, so that an
    expensive expression is named once and evaluated once.
    """
    keep = [c for c in df.columns if c not in PARSED_COLUMNS]
    work = df.select(
        *keep,
        clean_text(value).alias("__v"),
        F.lower(clean_text(record_type)).alias("__type"),
    )
    work = work.withColumns(
        {
            "__is_url": F.col("__type") == "url",
            "__tidy": F.when(F.col("__type") == "url", urls.tidy("__v")).otherwise(F.lit("")),
        }
    )
    work = work.withColumn("__scheme", urls.scheme_of(F.col("__tidy")))
    work = work.withColumn(
        "__rest",
        F.when(F.col("__scheme") != "", after_first(F.col("__tidy"), ":")).otherwise(F.col("__tidy")),
    )
    pieces = urls.split_rest(F.col("__rest"))
    work = work.withColumns({f"__{name}": piece for name, piece in pieces.items()})
    netloc_host, port_text = urls.host_and_port(F.col("__netloc"))
    work = work.withColumns(
        {
            "__bad_authority": urls.bad_authority(F.col("__netloc")),
            "__port": urls.port_number(port_text),
            "__raw_host": F.when(F.col("__is_url"), netloc_host).otherwise(F.col("__v")),
        }
    )
    work = work.withColumn("__text", hosts.host_text("__raw_host"))
    work = work.withColumn("__host", hosts.encoded_host("__text"))
    work = work.withColumn("__reason", _reason())
    work = settled(work, keep, [f"__{n}" for n in ("is_url", "scheme", "path", "query", "fragment", "port", "host", "reason")])
    work = work.withColumns(
        {
            "parse_ok": F.col("__reason") == "",
            "__good_host": F.when(F.col("__reason") == "", F.col("__host")).otherwise(F.lit("")),
        }
    )
    work = host_parts(work, "__good_host", rules)

    ok, ok_url = F.col("parse_ok"), F.col("parse_ok") & F.col("__is_url")
    path = F.when(F.col("__path") == "", F.lit("/")).otherwise(F.col("__path"))
    canonical = urls.build_url(
        F.col("__scheme"), F.col("__host"), F.col("__port"), path, urls.canonical_query(F.col("__query"))
    )

    def when_url(c: Column) -> Column:
        return F.when(ok_url, c).otherwise(F.lit(""))

    host = F.col("__good_host")
    final = {
        "scheme": when_url(F.col("__scheme")),
        "hostname": host,
        "path": when_url(path),
        "query": when_url(F.col("__query")),
        "fragment": when_url(F.col("__fragment")),
        "is_ip_host": F.when(ok & hosts.is_ip(host), F.lit(1)).otherwise(F.lit(0)),
        "canonical_domain": host,
        "canonical_hostname": host,
        "canonical_registered_domain": F.col("registered_domain"),
        "canonical_url": when_url(canonical),
        "invalid_reason": F.col("__reason"),
    }
    return work.select(
        *keep, *[final.get(name, F.col(name)).alias(name) for name in PARSED_COLUMNS]
    )


INVALID_REASONS = (
    "empty_value", "unknown_record_type", "unsupported_scheme", "invalid_url_parse", "missing_hostname", "invalid_domain", "invalid_hostname", "invalid_url",
)


def _reason() -> Column:
    """First reason that applies, or empty text."""
    v, is_url, host = F.col("__v"), F.col("__is_url"), F.col("__host")
    refused = F.lit(False)
    for prefix in V.REFUSED_PREFIXES:
        refused = refused | F.startswith(F.lower(v), F.lit(prefix))
    return (
        F.when(F.lower(v).isin(*V.EMPTY_LITERALS), "empty_value")
        .when(~F.col("__type").isin("domain", "url"), "unknown_record_type")
        .when(is_url & refused, "unsupported_scheme")
        .when(is_url & F.col("__bad_authority"), "invalid_url_parse")
        .when(is_url & ~F.col("__scheme").isin(*V.URL_SCHEMES), "unsupported_scheme")
        .when(host.isNull(), F.when(is_url, "missing_hostname").otherwise("invalid_domain"))
        .when(~hosts.is_valid_host(host), "invalid_hostname")
        .when(is_url & ~urls.port_ok(F.col("__port")), "invalid_url")
        .otherwise("")
    )


def split_valid(parsed: DataFrame) -> DataFrame:
    """Rows that parsed, without the two helper columns."""
    return parsed.where("parse_ok").drop("parse_ok", "invalid_reason")


def invalid_reasons(parsed: DataFrame) -> DataFrame:
    return parsed.where("not parse_ok").groupBy("invalid_reason").agg(F.count("*").alias("rows"))
