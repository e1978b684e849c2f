"""Registered queries: the Spark query and, where SQL can say it, its oracle twin."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql as S
from checks.views import HOST_IN_URL, Tables, event_log, event_requests, labelled_pages, page_records
from hostlens import fixed_values as V
from hostlens.functions import rules
from hostlens.functions.dates import first_date, looks_recent
from hostlens.functions.urls import query_pairs
from hostlens.operators import corpus, dedup, evaluation, extract, features, metrics, models, reports, sampling, scoring, seeds
from hostlens.operators.medians import medians
from hostlens.operators.parse import invalid_reasons, parse_records
from hostlens.plans import addon, batch, runs
from hostlens.session import fresh_path, materialize, parsing_tasks
from hostlens.sources import feeds
from hostlens.streaming import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def _r(df: DataFrame, *names: str) -> DataFrame:
    """Round doubles for comparison."""
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- parse ------------------------------------------------------------------


@query(_with(S.CLEAN, "SELECT count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS phishing FROM clean"))
def clean_class_distribution(t: Tables) -> DataFrame:
    return corpus.class_distribution(t.clean)


@query(_with(S.PARSED, "SELECT original_value, scheme, path, query, fragment, canonical_url FROM parsed WHERE parse_ok AND canonical_url <> ''"))
def canonical_urls(t: Tables) -> DataFrame:
    cols = ["original_value", "scheme", "path", "query", "fragment", "canonical_url"]
    return t.parsed.where("parse_ok and canonical_url <> ''").select(*cols)


@query(_with(S.PARSED_REQUESTS, "SELECT event_id, hostname, subdomain, domain, suffix, registered_domain, is_ip_host FROM parsed"))
def host_parts(t: Tables) -> DataFrame:
    return t.parsed_requests.select(
        "event_id", "hostname", "subdomain", "domain", "suffix", "registered_domain", "is_ip_host"
    )


@query(_with(S.PARSED, "SELECT invalid_reason, count(*) AS rows FROM parsed WHERE NOT parse_ok GROUP BY 1"))
def invalid_reason_counts(t: Tables) -> DataFrame:
    return invalid_reasons(t.parsed)


@query(_with(S.DETECTED, "SELECT event_id, record_type AS kind FROM typed"))
def detect_kind(t: Tables) -> DataFrame:
    return t.requests.select("event_id", rules.detect_kind("value").alias("kind"))


@query(
    _with(
        S.DETECTED + "," + S.parsed("typed", "value"),
        "SELECT event_id, q.k AS param, q.v AS value FROM (SELECT event_id, unnest(pairs) AS q FROM parsed_6 WHERE t = 'url')",
    )
)
def query_params_cleaned(t: Tables) -> DataFrame:
    raw = F.regexp_extract("value", r"^[^?#]*\?([^#]*)", 1)
    urls = t.requests.where(rules.detect_kind("value") == "url")
    return urls.select("event_id", F.explode(query_pairs(raw)).alias("q")).select(
        "event_id", F.col("q.k").alias("param"), F.col("q.v").alias("value")
    )


# --- corpus -----------------------------------------------------------------


@query(
    _with(
        S.PAGES,
        """SELECT url AS original_value, 1 AS label, 'openphish' AS source, day AS collected_at, 'url' AS record_type, '' AS source_record_id, CAST(NULL AS BIGINT) AS source_rank, '' AS source_target FROM labelled_pages
        UNION ALL SELECT host, 0, 'tranco', '2024-01-15', 'domain', '', first_page, '' FROM page_hosts WHERE first_page <= 100
        UNION ALL SELECT url, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END, 'mendeley_phishing_url', '2024-04-02', 'url', '', NULL, '10.17632/vfszbj9b36.1' FROM labelled_pages WHERE page_id % 3 < 2
        UNION ALL SELECT url, CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END, 'mendeley_legitphish', '2025-04-07', 'url', '', NULL, '10.17632/hx4m73v2sf.1' FROM labelled_pages WHERE page_id % 4 < 2
        UNION ALL SELECT url, 0, 'news_sitemaps', CASE WHEN page_id % 2 = 0 THEN day ELSE '2024-06-01' END, 'url', 'map', NULL, source FROM labelled_pages
        UNION ALL SELECT url, 1, 'phishtank', '2024-05-05', 'url', CAST(page_id AS VARCHAR), NULL, source FROM labelled_pages""",
    )
)
def normalize_union(t: Tables) -> DataFrame:
    """Every feed shape over the page table, united in the standard columns."""
    pages = t.pages
    text = F.when(F.col("page_id") % 3 == 0, " Phishing ").when(F.col("page_id") % 3 == 1, "LEGITIMATE").otherwise("spam")
    own_day = F.when(F.col("page_id") % 2 == 0, F.col("day")).otherwise(F.lit("  "))
    ranked = t.hosts.select(F.col("first_page").alias("source_rank"), F.col("host").alias("original_value"))
    news = pages.select("url", F.col("source").alias("publisher"), F.lit("map").alias("sitemap_url"), own_day.alias("collected_at"))
    entries = pages.select("url", F.col("page_id").cast("string").alias("phish_id"), F.col("source").alias("target"))
    return feeds.union_sources(
        [
            feeds.shape_url_lines(pages, "url", F.col("day")),
            feeds.shape_ranked_domains(ranked, F.lit("2024-01-15"), 100),
            feeds.shape_text_labels(pages.withColumn("kind", text), "url", "kind", F.lit(V.FEEDS["mendeley_phishing_url"][2])),
            feeds.shape_number_labels(
                pages.withColumn("cls", (F.col("page_id") % 4).cast("string")), "url", "cls", F.lit(V.FEEDS["mendeley_legitphish"][2])
            ),
            feeds.shape_news(news, F.lit("2024-06-01")),
            feeds.shape_phish_entries(entries, F.lit("2024-05-05")),
        ]
    )


def _land_zips(rows: DataFrame, folder: str) -> None:
    """Archives of the lines `line` by `source`, `file` and `member`, in order of `at`, each member under its `header`."""
    root = urlparse(folder).path

    def write(group):
        first = group.iloc[0]
        os.makedirs(f"{root}/{first.source}", exist_ok=True)
        with zipfile.ZipFile(f"{root}/{first.source}/{first.file}", "w", zipfile.ZIP_DEFLATED) as archive:
            for member, lines in group.sort_values(["member", "at"]).groupby("member"):
                header = [lines.iloc[0].header] if lines.iloc[0].header else []
                archive.writestr(f"inner/{member}.csv", "\r\n".join([*header, *lines.line]) + "\n")
        return group.iloc[:1][["file"]]

    rows.groupBy("source", "file").applyInPandas(write, "file string").count()


@query(
    _with(
        S.PAGES,
        """SELECT host AS original_value, 0 AS label, 'tranco' AS source, '2024-01-' || CAST(10 + (first_page // 2000) % 15 AS VARCHAR) AS collected_at, 'domain' AS record_type,
        '' AS source_record_id, first_page AS source_rank, '' AS source_target FROM page_hosts
        UNION ALL SELECT url, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END, 'mendeley_phishing_url', '2024-04-02', 'url', '', NULL, '10.17632/vfszbj9b36.1' FROM labelled_pages WHERE page_id % 3 < 2""",
    )
)
def zipped_feeds(t: Tables) -> DataFrame:
    """Zip archives that Spark writes from the pages, of 2,000 lines each, read back as two feeds."""
    folder = fresh_path(t.spark, "landed")
    number = (F.col("first_page") / 2000).cast("int")
    day = F.concat(F.lit("2024-01-"), (10 + number % 15).cast("string"))
    ranked = t.hosts.select(
        F.lit("tranco").alias("source"), F.format_string("tranco_%s_%d.zip", day, number).alias("file"), (F.col("first_page") % 2).alias("member"),
        F.col("first_page").alias("at"), F.lit("").alias("header"), F.concat_ws(",", "first_page", "host").alias("line"),
    )
    kind = F.when(F.col("page_id") % 3 == 0, " Phishing ").when(F.col("page_id") % 3 == 1, "LEGITIMATE").otherwise("spam")
    labelled = t.pages.select(
        F.lit("mendeley_phishing_url").alias("source"), F.format_string("mendeley_phishing_url_2024-05-01_%d.zip", (F.col("page_id") / 2000).cast("int")).alias("file"),
        (F.col("page_id") % 3).alias("member"), F.col("page_id").alias("at"), F.lit("id,url,type").alias("header"), F.concat("page_id", F.lit(',"'), "url", F.lit('",'), kind).alias("line"),
    )
    _land_zips(ranked.unionByName(labelled), folder)
    return feeds.normalize(t.spark, folder, ["tranco", "mendeley_phishing_url"])


_CLEAN_COLS = "original_value, label, source, collected_at, record_type, hostname, canonical_url"


@query(_with(S.CLEAN, f"SELECT {_CLEAN_COLS} FROM kept"))
def overlap_removed(t: Tables) -> DataFrame:
    valid = t.parsed_stage.where("parse_ok").drop("parse_ok", "invalid_reason")
    return corpus.remove_overlap(valid).select(*_CLEAN_COLS.split(", "))


@query(_with(S.CLEAN, f"SELECT {_CLEAN_COLS} FROM clean WHERE record_type = 'domain'"))
def dedup_hosts(t: Tables) -> DataFrame:
    return t.clean.where("record_type = 'domain'").select(*_CLEAN_COLS.split(", "))


@query(_with(S.CLEAN, f"SELECT {_CLEAN_COLS} FROM clean WHERE record_type = 'url'"))
def dedup_urls(t: Tables) -> DataFrame:
    return t.clean.where("record_type = 'url'").select(*_CLEAN_COLS.split(", "))


_DOMAIN_COLS = "sample_text, label, source, collected_at, record_type, registered_domain, subdomain, suffix, is_ip_host, source_rank"


@query(_with(S.DOMAIN_DATASET, f"SELECT {_DOMAIN_COLS} FROM domain_dataset"))
def domain_dataset(t: Tables) -> DataFrame:
    return corpus.domain_dataset(t.clean, corpus.addon_rows(t.addon)).select(*_DOMAIN_COLS.split(", "))


@query(
    _with(
        S.DOMAIN_DATASET,
        """SELECT count(*) AS evicted_hosts FROM domain_dataset d WHERE d.label = 0
        AND d.sample_text IN (SELECT canonical_hostname FROM clean WHERE label = 1)""",
    )
)
def domain_dataset_eviction(t: Tables) -> DataFrame:
    """Hosts whose earlier benign addon row evicted a phishing row."""
    benign = corpus.domain_dataset(t.clean, corpus.addon_rows(t.addon)).where("label = 0").select("sample_text")
    positive = t.clean.where("label = 1").select(F.col("canonical_hostname").alias("sample_text")).distinct()
    return benign.join(positive, "sample_text", "left_semi").agg(F.count("*").alias("evicted_hosts"))


_URL_COLS = "sample_text, label, source, collected_at, hostname, registered_domain, subdomain, path, query, fragment, scheme, is_ip_host"


@query(
    _with(
        S.CLEAN,
        f"SELECT {_URL_COLS.replace('sample_text', 'canonical_url AS sample_text')} FROM clean WHERE record_type = 'url' AND canonical_url <> ''",
    )
)
def url_dataset(t: Tables) -> DataFrame:
    return corpus.url_dataset(t.clean, unique=True).select(*_URL_COLS.split(", "))


@query(
    _with(
        S.CLEAN,
        """SELECT (SELECT count(*) FROM parsed) AS input_rows, (SELECT count(*) FROM parsed WHERE NOT parse_ok) AS invalid_rows_removed,
        (SELECT count(*) FROM valid) - (SELECT count(*) FROM kept) AS overlap_rows_removed,
        (SELECT count(*) FROM kept) - (SELECT count(*) FROM clean) AS deduplicated_rows_removed,
        count(*) AS output_rows, count(*) FILTER (label = 0) AS benign_rows, count(*) FILTER (label = 1) AS phishing_rows,
        count(*) FILTER (record_type = 'domain') AS domain_rows, count(*) FILTER (record_type = 'url') AS url_rows FROM clean""",
    )
)
def stage_stats(t: Tables) -> DataFrame:
    return corpus.clean_stats(t.parsed_stage)


@query(ORACLES["stage_stats"])
def observed_stats(t: Tables) -> DataFrame:
    """The same counters, observed while the stages are written."""
    return batch.observed_clean(t.parsed, fresh_path(t.spark, "corpus"))


@query(ORACLES["invalid_reason_counts"])
def observed_reasons(t: Tables) -> DataFrame:
    out = fresh_path(t.spark, "corpus")
    batch.observed_clean(t.parsed, out)
    return t.spark.read.schema("invalid_reason string, rows long").json(f"{out}/invalid_reasons")


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
    FROM lineitem) WHERE rn = 1"""
)
def keep_first_lines(t: Tables) -> DataFrame:
    cols = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    firsts = dedup.keep_first(t.raw("lineitem"), [F.col("l_orderkey")], [F.col(c) for c in cols])
    return firsts.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


@query(_with(S.CLEAN, "SELECT source, count(*) AS rows FROM clean GROUP BY 1"))
def source_counts(t: Tables) -> DataFrame:
    return corpus.value_counts(t.clean, "source")


# --- features ---------------------------------------------------------------


@query(_with(S.PARSED_REQUESTS, f"SELECT event_id, {S.feature_list(S.DOMAIN_FEATURES)} FROM parsed WHERE parse_ok"))
def domain_features(t: Tables) -> DataFrame:
    out = features.domain_features(t.parsed_requests.where("parse_ok"))
    return _r(out.select("event_id", *V.DOMAIN_FEATURES), *V.DOMAIN_FEATURES)


_SAMPLES = S.PARSED_REQUESTS + ", samples AS (SELECT *, canonical_url AS sample_text FROM parsed WHERE parse_ok AND record_type = 'url')"


@query(_with(_SAMPLES, f"SELECT event_id, {S.feature_list(S.URL_FEATURES)} FROM samples"))
def url_features(t: Tables) -> DataFrame:
    rows = t.parsed_requests.where("parse_ok and record_type = 'url'").withColumn("sample_text", F.col("canonical_url"))
    return _r(features.url_features(rows).select("event_id", *V.URL_FEATURES), *V.URL_FEATURES)


def _texts(pairs) -> str:
    shown = ", ".join(f"CASE WHEN {test} THEN {text} END" for test, text in pairs)
    return f"list_filter([{shown}], lambda m: m IS NOT NULL)[1:4]"


def _q(key: str) -> str:
    return "'" + V.SIGNAL_TEXT[key].replace("'", "''") + "'"


_D, _U = S.DOMAIN_FEATURES, S.URL_FEATURES
_TLD_TEXT = "'" + V.SIGNAL_TEXT["risky_tld"].replace("{suffix}", "' || suffix || '") + "'"
_DOMAIN_SIGNALS = _texts(
    [
        (_D["contains_brand_name"], _q("brand")), (_D["contains_sensitive_keyword"], _q("host_keyword")),
        (f"{_D['edit_distance_to_top_brand']} <= 1", _q("near_brand")), (f"{_D['tld_risk_score']} >= 0.7", _TLD_TEXT),
        (f"{_D['digit_ratio']} >= 0.2", _q("host_digits")), (_D["is_idn_or_punycode"], _q("punycode")),
    ]
)
_URL_SIGNALS = _texts(
    [
        (f"{_U['suspicious_token_count']} >= 1", _q("url_keyword")), (_U["uses_http_scheme"], _q("plain_http")),
        (_U["has_https_token_in_host"], _q("https_in_host")), (f"{_U['has_ip_host']} >= 1", _q("ip_host")),
        (f"{_U['query_param_count']} >= 4", _q("many_params")), (f"{_U['special_char_ratio']} >= 0.35", _q("special_chars")),
    ]
)


@query(
    _with(
        _SAMPLES,
        f"""SELECT event_id, 'domain' AS kind, array_to_string({_DOMAIN_SIGNALS}, ' | ') AS signals FROM parsed WHERE parse_ok
        UNION ALL SELECT event_id, 'url', array_to_string({_URL_SIGNALS}, ' | ') FROM samples""",
    )
)
def signals(t: Tables) -> DataFrame:
    rows = t.parsed_requests.where("parse_ok").withColumn("sample_text", F.col("canonical_url"))
    hosts = features.domain_features(rows).select(
        "event_id", F.lit("domain").alias("kind"), F.array_join(rules.domain_signals(), " | ").alias("signals")
    )
    urls = features.url_features(rows.where("record_type = 'url'")).select(
        "event_id", F.lit("url").alias("kind"), F.array_join(rules.url_signals(), " | ").alias("signals")
    )
    return hosts.unionByName(urls)


def _category_sql(text: str) -> str:
    tests = " ".join(f"WHEN {S.any_of(text, tokens)} THEN '{name}'" for name, tokens in V.CATEGORY_TOKENS.items())
    return f"CASE {tests} ELSE 'generic_portal' END"


_PRIORITY = "CASE {0} WHEN 'banking_payment' THEN 'critical' WHEN 'crypto_wallet' THEN 'critical' WHEN 'generic_portal' THEN 'medium' ELSE 'high' END"


@query(
    f"""WITH c AS (SELECT doc_id, {_category_sql('lower(text)')} AS category FROM documents)
    SELECT doc_id, category, {_PRIORITY.format('category')} AS priority FROM c"""
)
def category_of_text(t: Tables) -> DataFrame:
    named = t.spread("documents").select("doc_id", rules.category("text").alias("category"))
    return named.withColumn("priority", rules.priority("category"))


@query(
    """SELECT event_id, CASE WHEN s >= 0.5 THEN 'high' WHEN s >= 0.6 THEN 'medium' WHEN s >= 0.35 THEN 'low' ELSE 'minimal' END AS risk,
    CASE WHEN s >= 0.6 THEN 'medium' WHEN s >= 0.5 THEN 'high' WHEN s >= 0.35 THEN 'low' ELSE 'minimal' END AS risk_by_floor,
    round(1 / (1 + exp(-(value - 50) / 25)), 6) AS squeezed
    FROM (SELECT event_id, value, least(value / 100.0, 1.0) AS s FROM events)"""
)
def risk_levels(t: Tables) -> DataFrame:
    score = F.least(F.col("value") / 100.0, F.lit(1.0))
    by_floor = sorted(V.RISK_BANDS, key=lambda b: -b[1])
    return t.raw("events").select(
        "event_id", rules.risk_level(score).alias("risk"), rules.risk_level(score, by_floor).alias("risk_by_floor"),
        F.round(rules.sigmoid((F.col("value") - 50) / 25), 6).alias("squeezed"),
    )


# --- balance and split ------------------------------------------------------

_RARE = S.LABELLED + ", rare AS (SELECT event_id, rare AS label, source, collected_at FROM labelled)"
_BOTH = "(SELECT collected_at FROM rare GROUP BY 1 HAVING count(DISTINCT label) = 2)"


def _rare(t: Tables) -> DataFrame:
    return t.labelled.withColumn("label", F.col("rare")).drop("rare")


@query(_with(_RARE, "SELECT collected_at FROM rare GROUP BY 1 HAVING count(DISTINCT label) < 2"))
def single_class_dates(t: Tables) -> DataFrame:
    return sampling.single_class_dates(_rare(t))


@query(_with(_RARE, f"SELECT event_id, label, collected_at FROM rare WHERE collected_at IN {_BOTH}"))
def both_class_rows(t: Tables) -> DataFrame:
    return sampling.drop_single_class_dates(_rare(t)).select("event_id", "label", "collected_at")


_TARGET = "SELECT collected_at, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS target FROM labelled GROUP BY 1"


_SIZES = """days AS (SELECT collected_at, row_number() OVER (ORDER BY collected_at) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT collected_at FROM labelled)),
sizes AS (SELECT *, greatest(1, CAST(round_even(n * 0.7, 0) AS INTEGER)) AS tr, greatest(1, CAST(round_even(n * 0.15, 0) AS INTEGER)) AS va FROM days),
split_days AS (SELECT collected_at, CASE WHEN rn <= tr - CASE WHEN n - tr - va < 1 THEN 1 ELSE 0 END THEN 'train'
  WHEN rn <= tr - CASE WHEN n - tr - va < 1 THEN 1 ELSE 0 END + va THEN 'val' ELSE 'test' END AS split FROM sizes)"""
_DAY_LIST = "(SELECT coalesce(string_agg({0}, ',' ORDER BY {0}), '') FROM {1})"


@query(
    _with(
        _RARE + f", kept AS (SELECT collected_at, 2 * least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS n FROM rare WHERE collected_at IN {_BOTH} GROUP BY 1), "
        + _SIZES.replace("FROM labelled", "FROM kept"),
        "SELECT "
        + ", ".join(f"(SELECT count(*) FROM rare WHERE label = {i}) AS {n}_before, (SELECT CAST(coalesce(sum(n), 0) / 2 AS BIGINT) FROM kept) AS {n}_after" for i, n in enumerate(("benign", "phishing")))
        + ", (SELECT count(*) FROM rare) - (SELECT count(*) FROM rare WHERE collected_at NOT IN (SELECT collected_at FROM kept)) - (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM kept) AS rows_removed, "
        + _DAY_LIST.format("collected_at", "(SELECT DISTINCT collected_at FROM rare WHERE collected_at NOT IN (SELECT collected_at FROM kept))") + " AS dropped_dates, "
        + ", ".join(
            f"(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM kept JOIN split_days USING (collected_at) WHERE split = '{s}') AS {s}_rows, "
            + _DAY_LIST.format("collected_at", f"(SELECT collected_at FROM split_days WHERE split = '{s}')") + f" AS {s}_dates" for s in ("train", "val", "test")
        )
        + f", {len(V.DOMAIN_FEATURES)} AS features",
    )
)
def run_summary(t: Tables) -> DataFrame:
    """The facts of a training run, recorded twice under one id and read back from the run table."""
    rare = _rare(t).withColumn("sample_text", F.col("event_id").cast("string"))
    rows = materialize(batch.training_rows(rare, "domain"), "rows")
    facts = runs.training_facts(rare, rows, "domain", "per_date_under")
    path = fresh_path(t.spark, "runs")
    for kind in ("url", "domain"):
        runs.record(runs._with_facts(facts, {"run_id": "r1", "kind": kind}), path)
    found = runs.runs(t.spark, path).where("kind = 'domain'")
    split = {s: F.get("splits", F.lit(i)) for i, s in enumerate(("train", "val", "test"))}
    removed = F.aggregate("balancing", F.lit(0).cast("long"), lambda a, d: a + d["rows_removed"])
    return found.select(
        *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in ("benign", "phishing") for side in ("before", "after")],
        removed.alias("rows_removed"), F.array_join("dropped_dates", ",").alias("dropped_dates"),
        *[c for s, x in split.items() for c in (x["rows"].alias(f"{s}_rows"), F.array_join(x["dates"], ",").alias(f"{s}_dates"))], F.size("feature_columns").alias("features"),
    )


@query(
    _with(
        S.LABELLED,
        f"""SELECT event_id, label, collected_at FROM (SELECT *, row_number() OVER (PARTITION BY collected_at, label
        ORDER BY md5('42:' || event_id), event_id) AS rn FROM labelled) JOIN ({_TARGET}) USING (collected_at) WHERE rn <= target""",
    )
)
def undersample_per_date(t: Tables) -> DataFrame:
    return sampling.undersample_per_date(t.labelled, "event_id").select("event_id", "label", "collected_at")


@query(
    _with(
        S.LABELLED,
        """SELECT event_id, label, collected_at FROM (SELECT *, row_number() OVER (PARTITION BY label
        ORDER BY md5('42:' || event_id), event_id) AS rn FROM labelled)
        WHERE rn <= (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) FROM labelled)""",
    )
)
def undersample_global(t: Tables) -> DataFrame:
    return sampling.undersample_global(t.labelled, "event_id").select("event_id", "label", "collected_at")


_LINES = """
lines AS (SELECT CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || CAST(l_quantity AS INTEGER) AS k,
  CAST(l_returnflag = 'R' AS INTEGER) AS label, l_extendedprice AS score, strftime(l_shipdate, '%Y') AS collected_at FROM lineitem)"""


def _lines(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_quantity").cast("int").cast("string"))
    return (t.raw("lineitem") if lines is None else lines).select(
        key.alias("k"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_extendedprice").alias("score"),
        F.date_format(F.to_date("l_shipdate"), "yyyy").alias("collected_at"),
    )


@query(
    _with(
        _LINES,
        """SELECT k, label, collected_at FROM (SELECT *, row_number() OVER (PARTITION BY collected_at, label ORDER BY md5('42:' || k), k) AS rn FROM lines)
        JOIN (SELECT collected_at, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS target FROM lines GROUP BY 1) USING (collected_at)
        WHERE rn <= target""",
    )
)
def undersample_lines(t: Tables) -> DataFrame:
    return sampling.undersample_per_date(_lines(t, t.spread("lineitem")), "k").select("k", "label", "collected_at")


@query(_with(S.LABELLED + "," + _SIZES, "SELECT event_id, label, collected_at, split FROM labelled JOIN split_days USING (collected_at)"))
def temporal_split(t: Tables) -> DataFrame:
    return sampling.temporal_split(t.labelled).select("event_id", "label", "collected_at", "split")


@query(
    _with(
        S.LABELLED + "," + _SIZES,
        """SELECT split, count(*) AS rows, count(DISTINCT label) AS labels, min(collected_at) AS first_date, max(collected_at) AS last_date
        FROM labelled JOIN split_days USING (collected_at) GROUP BY 1""",
    )
)
def split_sizes(t: Tables) -> DataFrame:
    return sampling.check_both_classes(sampling.temporal_split(t.labelled))


@query(_with(_RARE, f"SELECT event_id, label, collected_at FROM rare WHERE collected_at >= '2024-01-10' AND collected_at IN {_BOTH}"))
def variant_from_date(t: Tables) -> DataFrame:
    rows = sampling.drop_single_class_dates(corpus.from_date(_rare(t), "2024-01-10"))
    return rows.select("event_id", "label", "collected_at")


@query(
    _with(
        S.LABELLED,
        """SELECT collected_at, b AS original_benign, p AS original_phishing, least(b, p) AS balanced_benign, least(b, p) AS balanced_phishing,
        b + p - 2 * least(b, p) AS rows_removed FROM (SELECT collected_at, count(*) FILTER (label = 0) AS b, count(*) FILTER (label = 1) AS p FROM labelled GROUP BY 1)""",
    )
)
def per_date_balance(t: Tables) -> DataFrame:
    return sampling.per_date_balance(t.labelled)


@query(
    _with(
        S.LABELLED + f", t AS ({_TARGET})",
        """SELECT 'per_date_under' AS strategy, 'before' AS stage, count(*) AS rows, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS phishing FROM labelled
        UNION ALL SELECT 'per_date_under', 'after', CAST(sum(2 * target) AS BIGINT), CAST(sum(target) AS BIGINT), CAST(sum(target) AS BIGINT) FROM t""",
    )
)
def balance_summary(t: Tables) -> DataFrame:
    after = sampling.balance(t.labelled, "per_date_under", "event_id")
    return sampling.balance_summary(t.labelled, after, "per_date_under")


@query(_with(S.LABELLED, "SELECT label, count(*) AS rows, round((SELECT count(*) FROM labelled) / (2 * count(*)), 6) AS weight FROM labelled GROUP BY 1"))
def class_weights(t: Tables) -> DataFrame:
    return _r(metrics.class_weights(t.labelled), "weight")


# --- reports ----------------------------------------------------------------

_DIST = """SELECT {0}, count(*) FILTER (label = 0) AS benign_count, count(*) FILTER (label = 1) AS phishing_count, count(*) AS total_rows,
    round(count(*) FILTER (label = 1) / count(*), 6) AS phishing_ratio FROM {1} GROUP BY 1"""


@query(_with(S.CLEAN, _DIST.format("source", "clean")))
def label_distribution_by_source(t: Tables) -> DataFrame:
    return _r(reports.label_distribution(t.clean, "source", True), "phishing_ratio")


@query(_with(S.LABELLED, _DIST.format("collected_at", "labelled")))
def label_distribution_by_date(t: Tables) -> DataFrame:
    return _r(reports.label_distribution(t.labelled, "collected_at", False), "phishing_ratio")


_OVERVIEW = """SELECT '{1}' AS dataset_name, count(*) AS rows, {2} AS columns, count(*) FILTER (label = 1) AS phishing_rows, count(*) FILTER (label = 0) AS benign_rows,
    round(count(*) FILTER (label = 1) / count(*), 6) AS phishing_ratio, count(DISTINCT source) AS unique_sources, count(DISTINCT collected_at) AS unique_dates,
    coalesce(min(collected_at), '') AS min_date, coalesce(max(collected_at), '') AS max_date FROM {0}"""


@query(_with(_RARE, _OVERVIEW.format("labelled", "labelled", 5) + " UNION ALL " + _OVERVIEW.format("rare", "rare", 4)))
def dataset_overview(t: Tables) -> DataFrame:
    return _r(reports.dataset_overview({"labelled": t.labelled, "rare": _rare(t)}), "phishing_ratio")


_PROFILED = (("sample_id", "string"), ("dataset_kind", "string"), ("category", "string"), ("priority", "string"), ("score", "double"), ("label", "int"))


@query(
    _with(
        S.SCORED,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, '{d}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count, count({c}) AS non_null_count,
            round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS null_ratio, count(DISTINCT {c}) AS unique_non_null_values FROM scored"""
            for c, d in _PROFILED
        ),
    )
)
def column_profile(t: Tables) -> DataFrame:
    return _r(reports.column_profile(t.scored.select(*[c for c, _ in _PROFILED])), "null_ratio")


_ORDER_COLS = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string"))


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{d}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count, count({c}) AS non_null_count,
        round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS null_ratio, count(DISTINCT {c}) AS unique_non_null_values FROM orders"""
        for c, d in _ORDER_COLS
    )
)
def orders_profile(t: Tables) -> DataFrame:
    return _r(reports.column_profile(t.raw("orders").select(*[c for c, _ in _ORDER_COLS])), "null_ratio")


_LINE_COLS = (
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_returnflag", "string"),
    ("l_shipdate", "date"),
)


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, count({c}) AS non_null_count, count(DISTINCT {c}) AS exact, true AS within FROM lineitem"""
        for c, _ in _LINE_COLS
    )
)
def sketched_profile(t: Tables) -> DataFrame:
    """Columns profiled year by year; the merged estimates lie within three standard errors (and one value) of the exact numbers."""
    lines = t.raw("lineitem").select(*[c for c, _ in _LINE_COLS])
    dated = lines.withColumn("collected_at", F.date_format("l_shipdate", "yyyy"))
    stored = fresh_path(t.spark, "profile")
    batch.update_profile(dated.where("collected_at < '1999'"), stored)
    merged = batch.update_profile(dated, stored)
    exact = reports.column_profile(lines).select("column_name", F.col("unique_non_null_values").alias("exact"))
    error = F.abs(F.col("unique_non_null_values") - F.col("exact"))
    return merged.join(exact, "column_name").select("column_name", "null_count", "non_null_count", "exact", (error <= 1 + 0.025 * F.col("exact")).alias("within"))


_MEDIAN_OF = {
    "l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "CASE WHEN l_orderkey % 3 > 0 THEN l_discount END",
    "wide": "CASE WHEN l_linenumber % 2 = 0 THEN -exp(l_quantity) ELSE l_extendedprice END", "never": "CASE WHEN l_orderkey < 0 THEN 1.5 END", "flag": "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS column_name, round(CAST(median({e}) AS DOUBLE), 6) AS median FROM lineitem" for n, e in _MEDIAN_OF.items()))
def exact_medians(t: Tables) -> DataFrame:
    """Medians as the models' filling takes them, with missing values, ties and no value at all."""
    rows = t.raw("lineitem").select(*[F.expr(e).cast("double").alias(n) for n, e in _MEDIAN_OF.items()])
    found = medians(rows, list(_MEDIAN_OF))
    return _r(t.spark.createDataFrame(list(found.items()), "column_name string, median double"), "median")


_SUMMARY = """SELECT count(*) AS total_events, count(*) FILTER (predicted_label = 1) AS phishing_events, count(*) FILTER (predicted_label <> 1) AS benign_events,
    count(*) FILTER (risk_level = 'high') AS high_risk_events, count(*) FILTER (dataset_kind = 'domain') AS domain_events,
    count(*) FILTER (dataset_kind = 'url') AS url_events, max(received_at) AS latest_event_at FROM log"""


@query(_with(S.LOG, _SUMMARY))
def event_summary(t: Tables) -> DataFrame:
    return reports.event_summary(t.log)


@query(_with(S.LOG, "SELECT event_id, received_at, dataset_kind, predicted_label, score, risk_level FROM log ORDER BY received_at DESC, event_id LIMIT 700"))
def recent_events(t: Tables) -> DataFrame:
    """The top-k report of the event log."""
    return reports.recent_events(t.log, 700)


# --- evaluation -------------------------------------------------------------

_PRF = """tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


@query(
    _with(
        S.SCORED,
        f"""SELECT {_PRF} FROM (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
        count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM scored)""",
    )
)
def classification_metrics(t: Tables) -> DataFrame:
    return _r(metrics.classification_metrics(t.scored), "precision", "recall", "f1")


def _curve(rows: str) -> str:
    return f"""curve AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {rows} GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM curve)"""


_RANKING = """SELECT CAST(max(p) AS BIGINT) AS positives, CAST(max(n) AS BIGINT) AS negatives,
    round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(p), 6) AS pr_auc FROM cum"""


@query(_with(S.SCORED + "," + _curve("scored"), _RANKING))
def ranking_metrics(t: Tables) -> DataFrame:
    return _r(metrics.ranking_metrics(t.scored), "roc_auc", "pr_auc")


@query(_with(_LINES + "," + _curve("lines"), _RANKING))
def ranking_metrics_lines(t: Tables) -> DataFrame:
    return _r(metrics.ranking_metrics(_lines(t)), "roc_auc", "pr_auc")


@query(_with(S.SCORED + "," + _curve("scored"), "SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM cum"))
def ranking_curve(t: Tables) -> DataFrame:
    return metrics.ranking_curve(t.scored).select("score", "tp", "fp")


def _summary_sql(group: str) -> str:
    key = group if group != "overall" else "CAST(NULL AS VARCHAR)"
    tail = f"GROUP BY {group}" if group != "overall" else ""
    return f"SELECT '{group}' AS grouped_by, {key} AS group_key, {S.MEASURES} FROM scored {tail}"


_RATES = ("average_score", "false_positive_rate", "false_negative_rate", "match_rate")


@query(_with(S.SCORED, " UNION ALL ".join(_summary_sql(g) for g in ("dataset_kind", "priority", "category", "overall"))))
def group_summaries(t: Tables) -> DataFrame:
    return _r(evaluation.all_summaries(evaluation.confusion_flags(t.scored)), *_RATES)


@query(_with(S.SCORED, f"SELECT dataset_kind, priority, {S.MEASURES} FROM scored GROUP BY 1, 2"))
def group_summary(t: Tables) -> DataFrame:
    return _r(evaluation.group_summary(evaluation.confusion_flags(t.scored), ["dataset_kind", "priority"]), *_RATES)


def _issues(where: str, order: str, mode: str) -> str:
    return f"""SELECT * FROM (SELECT '{mode}' AS mode, sample_id, priority, score, predicted_label FROM scored WHERE {where}
    ORDER BY priority NULLS LAST, score {order} NULLS LAST, sample_id LIMIT 10)"""


@query(
    _with(
        S.SCORED,
        " UNION ALL ".join(
            [
                _issues("is_false_positive", "DESC", "benign_only"), _issues("is_false_negative", "ASC", "phishing_only"),
                _issues("NOT match_expected", "DESC", "mixed"),
            ]
        ),
    )
)
def top_issues(t: Tables) -> DataFrame:
    flagged, out = evaluation.confusion_flags(t.scored), None
    for mode in ("benign_only", "phishing_only", "mixed"):
        part = evaluation.top_issues(flagged, mode).select(F.lit(mode).alias("mode"), "sample_id", "priority", "score", "predicted_label")
        out = part if out is None else out.unionByName(part)
    return out


@query(_with(S.SCORED, "SELECT 'mixed' AS evaluation_mode FROM scored HAVING count(DISTINCT expected_label) = 2"))
def evaluation_mode(t: Tables) -> DataFrame:
    return evaluation.evaluation_mode(t.scored)


_MODELS = ("logistic_regression", "random_forest", "xgboost")


def _model_rows(t: Tables, months: str) -> DataFrame:
    rows = t.scored.select("label", "prediction", "score", "dataset_kind").where(F.col("dataset_kind").isin("en", "fr") == (months == "v"))
    out = None
    for i, name in enumerate(_MODELS):
        guess = (F.col("score") >= 0.01 * (i + 1)).cast("int")
        m = metrics.classification_metrics(rows.withColumn("prediction", guess)).select(F.lit(name).alias("model"), "precision", "recall", "f1")
        out = m if out is None else out.unionByName(m)
    return out


def _model_sql(name: str, lang: str) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{m}' AS model, {i} AS o, count(*) FILTER (label = 1 AND score >= {0.01 * (i + 1)}) AS tp,
        count(*) FILTER (label = 0 AND score >= {0.01 * (i + 1)}) AS fp, count(*) FILTER (label = 1 AND score < {0.01 * (i + 1)}) AS fn FROM scored WHERE {lang}"""
        for i, m in enumerate(_MODELS)
    )
    return f"{name} AS (SELECT model, o, {_PRF} FROM ({parts}))"


@query(
    _with(
        S.SCORED + "," + _model_sql("va", "dataset_kind IN ('en', 'fr')") + "," + _model_sql("te", "dataset_kind NOT IN ('en', 'fr')"),
        """SELECT va.model, va.model = (SELECT model FROM va ORDER BY f1 DESC, o LIMIT 1) AS is_selected_model, va.precision AS precision_validation, va.recall AS recall_validation,
        va.f1 AS f1_validation, te.precision AS precision_test, te.recall AS recall_test, te.f1 AS f1_test FROM va JOIN te USING (model)""",
    )
)
def model_comparison(t: Tables) -> DataFrame:
    validation, test = _model_rows(t, "v"), _model_rows(t, "t")
    best = metrics.best_model(validation, "f1").first()["model"]
    out = metrics.model_comparison(validation, test, best, "f1")
    return _r(out, *[c for c in out.columns if c.endswith(("_validation", "_test"))])


# --- seeds and extraction ---------------------------------------------------

_TOKENS_ALL = [tok for group in V.CATEGORY_TOKENS.values() for tok in group]
_TURN = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(V.CATEGORY_TURN)) + " END"
_CANDIDATES = f"""
cand_0 AS (SELECT * FROM (SELECT canonical_url AS url, canonical_hostname AS hostname,
  row_number() OVER (PARTITION BY canonical_hostname ORDER BY event_id) AS rn FROM parsed WHERE parse_ok AND canonical_url <> '') WHERE rn = 1),
cand AS (SELECT url, hostname, {_category_sql('lower(url)')} AS category FROM cand_0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {S.hits('lower(url)', _TOKENS_ALL)} DESC,
  {S.count_char('url', '?')} + {S.count_char('url', '=')} + {S.count_char('url', '&')} + {S.parts('hostname', '.')} DESC, lower(url)) AS r FROM cand),
picked AS (SELECT *, row_number() OVER (ORDER BY r, {_TURN}) AS i FROM ranked WHERE r <= 9 QUALIFY i <= 15)"""


@query(
    _with(
        S.PARSED_REQUESTS + "," + _CANDIDATES,
        f"""SELECT 'P' || lpad(CAST(i AS VARCHAR), 3, '0') AS sample_id, category, 'domain' AS dataset_kind, hostname AS input_value, 'phishing' AS expected_label,
        {_PRIORITY.format('category')} AS priority FROM picked
        UNION ALL SELECT 'U' || lpad(CAST(i AS VARCHAR), 3, '0'), category, 'url', url, 'phishing', {_PRIORITY.format('category')} FROM picked""",
    )
)
def round_robin_seed(t: Tables) -> DataFrame:
    """The sampling report of a feed: at most 15 pairs, taking turns over categories."""
    found = seeds.seed_candidates(t.parsed_requests, [F.col("event_id")])
    return seeds.seed_rows(seeds.round_robin(found, 15, 9), "events").drop("note")


@query(_with(S.LINKS, "SELECT page_id, position, href, link FROM links"))
def extract_links(t: Tables) -> DataFrame:
    return t.links.select("page_id", "position", "href", "link")


@query(
    _with(
        S.LINKS,
        """SELECT page_id, position + 1 AS position, href, link FROM links UNION ALL
        SELECT page_id, 0, '/hard', regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/hard' FROM labelled_pages""",
    )
)
def extract_links_hard(t: Tables) -> DataFrame:
    """Every page between a link of very long attributes and one that never ends."""
    first = F.concat(F.lit('<a title="'), F.repeat(F.lit("x>"), F.lit(20_000)), F.lit('" '), F.repeat(F.lit("k='v' "), F.lit(2_000)), F.lit('href="/h&#97;rd">'))
    last = F.concat(F.lit("<a "), F.repeat(F.lit('word "w" '), F.lit(10_000)))
    pages = t.pages.withColumn("html", F.concat(first, "html", last))
    return extract.extract_links(pages).select("page_id", "position", "href", "link")


# A site seed per host; found pages are the parsed links of its pages.
_FOUND = S.LINKS + """,
found_in AS (SELECT page_id, position, link, regexp_extract(url, '://([^/?#]+)', 1) AS seed_id, 'url' AS record_type FROM links),""" + S.parsed("found_in", "link", "found") + """,
seeds AS (SELECT host AS seed_id, first_page FROM page_hosts),
internal AS (SELECT * EXCLUDE (rn) FROM (SELECT seed_id, canonical_url, canonical_hostname, registered_domain, page_id * 100000 + position AS position,
  row_number() OVER (PARTITION BY seed_id, canonical_url ORDER BY page_id, position) AS rn FROM found WHERE parse_ok) WHERE rn = 1)"""


def _site_seeds(t: Tables) -> DataFrame:
    base = t.hosts.select(
        F.col("host").alias("seed_id"), F.col("first_page").alias("seed_order"), F.lit("site").alias("category"),
        F.col("host").alias("source_name"), F.concat(F.lit("https://"), "host", F.lit("/")).alias("homepage_url"), F.lit("").alias("note"),
        F.lit("url").alias("record_type"),
    )
    parsed = parse_records(base, "homepage_url")
    return parsed.select("seed_id", "seed_order", "category", "source_name", "homepage_url", "note", "registered_domain")


def _internal(t: Tables) -> DataFrame:
    found = t.links.select(
        F.regexp_extract("url", "://([^/?#]+)", 1).alias("seed_id"), F.lit("homepage").alias("discovery_method"),
        (F.col("page_id") * 100000 + F.col("position")).alias("position"), "link", F.lit("url").alias("record_type"),
    )
    return materialize(seeds.internal_pages(parse_records(found, "link"), _site_seeds(t)), "internal")


@query(_with(_FOUND, "SELECT seed_id, canonical_url, canonical_hostname, registered_domain, position FROM internal"))
def internal_links(t: Tables) -> DataFrame:
    return _internal(t).select("seed_id", "canonical_url", "canonical_hostname", "registered_domain", "position")


_PICKED = f""",
best AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY {S.hits('lower(canonical_url)', V.PORTAL_KEYWORDS)} DESC,
  {S.parts('canonical_hostname', '.')} DESC, lower(canonical_url), canonical_url) AS rank FROM internal),
top_pages AS (SELECT * FROM best WHERE rank <= 3)"""


@query(_with(_FOUND + _PICKED, "SELECT seed_id, canonical_url, CAST(rank AS INTEGER) AS rank FROM top_pages"))
def portal_topk_per_site(t: Tables) -> DataFrame:
    return seeds.pick_urls(_internal(t), 3).select("seed_id", "canonical_url", "rank")


@query(
    _with(
        _FOUND + _PICKED,
        """SELECT s.seed_id, s.seed_id AS source_name, 'site' AS category, count(p.canonical_url) AS selected_url_count,
        CAST(max(CASE WHEN p.seed_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS selected_domain_count FROM seeds s LEFT JOIN top_pages p ON s.seed_id = p.seed_id GROUP BY 1""",
    )
)
def seed_rollup(t: Tables) -> DataFrame:
    pages = _internal(t)
    picked = seeds.pick_urls(pages, 3)
    return seeds.seed_rollup(_site_seeds(t), picked, seeds.pick_hosts(pages, picked, 3)).drop("registered_domain")


@query(
    _with(
        _FOUND + _PICKED,
        """SELECT 'VU' || lpad(CAST(row_number() OVER (ORDER BY first_page, rank) AS VARCHAR), 4, '0') AS sample_id, seed_id, canonical_url AS input_value,
        canonical_hostname AS hostname, registered_domain, 'benign' AS expected_label, 'homepage' AS discovery_method
        FROM top_pages JOIN seeds USING (seed_id)""",
    )
)
def addon_urls(t: Tables) -> DataFrame:
    """Addon rows with running ids over all sites."""
    rows = seeds.addon_table(seeds.pick_urls(_internal(t), 3), _site_seeds(t), "url", "VU")
    return rows.select("sample_id", "seed_id", "input_value", "hostname", "registered_domain", "expected_label", "discovery_method")


@query(
    _with(
        _FOUND.replace("ORDER BY page_id, position) AS rn", "ORDER BY page_id, position) AS rn, page_id") + _PICKED,
        """SELECT 'VU' || lpad(CAST(row_number() OVER (ORDER BY top_pages.seed_id, rank) AS VARCHAR), 4, '0') AS sample_id, top_pages.seed_id, canonical_url AS input_value,
        CASE WHEN page_id = first_page THEN 'homepage' ELSE 'sitemap' END AS discovery_method, 'url' AS dataset_kind FROM top_pages JOIN seeds USING (seed_id)
        UNION ALL SELECT 'VD' || lpad(CAST(row_number() OVER (ORDER BY seed_id) AS VARCHAR), 4, '0'), seed_id, canonical_hostname,
        CASE WHEN page_id = first_page THEN 'homepage' ELSE 'sitemap' END, 'domain'
        FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, canonical_hostname ORDER BY position) AS first FROM internal) JOIN seeds USING (seed_id) WHERE first = 1""",
    )
)
def addon_flow(t: Tables) -> DataFrame:
    """The whole addon flow: a host's first page is its homepage, a sitemap lists the links of the others."""
    sites = t.hosts.select(
        F.col("host").alias("seed_id"), F.lit("site").alias("category"), F.col("host").alias("source_name"), F.concat(F.lit("https://"), "host", F.lit("/")).alias("homepage_url"), F.lit("").alias("note")
    )
    pages = t.pages.select("page_id", "html", F.regexp_extract("url", HOST_IN_URL, 1).alias("host"), "url").join(t.hosts, "host")
    root = F.concat(F.substring_index("url", ":", 1), F.lit("://"), "host")
    # Links are relative: the homepage's own scheme is that of the other pages once it stands in the text.
    homes = pages.where("page_id = first_page").select(F.concat(F.lit("https://"), "host", F.lit("/")).alias("doc_url"), F.concat(F.lit('<base>'), F.regexp_replace("html", 'href="/', F.concat(F.lit('href="'), root, F.lit("/")))).alias("body"))
    rest = t.links.join(pages.where("page_id > first_page").select("page_id", "host"), "page_id")
    entry = F.concat(F.lit("<url><loc><![CDATA["), "link", F.lit("]]></loc></url>"))
    listed = rest.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "position", entry.alias("e")))), lambda x: x["e"]), "").alias("items"))
    maps = listed.select(F.concat(F.lit("https://"), "host", F.lit("/all.xml")).alias("doc_url"), F.concat(F.lit("<urlset>"), "items", F.lit("</urlset>")).alias("body"))
    robots = sites.select(F.concat("homepage_url", F.lit("robots.txt")).alias("doc_url"), F.concat(F.lit("Sitemap: "), "homepage_url", F.lit("all.xml")).alias("body"))
    documents = materialize(homes.unionByName(maps).unionByName(robots), "documents")
    found = addon.addon(t.spark, sites, documents, "2024-01-27", 3)
    return found["urls"].unionByName(found["domains"]).select("sample_id", "seed_id", "input_value", "discovery_method", "dataset_kind")


@query(
    """SELECT c_custkey, n AS seq, price AS o_totalprice FROM (SELECT o_custkey AS c_custkey, min(o_orderkey) AS n, max_by(o_totalprice, o_orderkey) AS price
    FROM orders GROUP BY 1)"""
)
def addon_last_wins(t: Tables) -> DataFrame:
    """Last record per key, at the place of the first one."""
    rows = t.raw("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("seq"), "o_totalprice")
    return dedup.last_wins(rows, "c_custkey", "seq").select("c_custkey", "seq", "o_totalprice")


_BLOCKED = "list_bool_or(list_transform(" + S.text_list(V.NEWS_BLOCKED_TOKENS) + ", lambda w: contains(lower(link), w)))"
_ENDING = "list_bool_or(list_transform(" + S.text_list(V.NEWS_BLOCKED_ENDINGS) + ", lambda w: ends_with(lower(path), w)))"


@query(
    _with(
        S.LINKS + ", news_in AS (SELECT page_id, position, link, 'url' AS record_type FROM links UNION ALL SELECT page_id, -1, url, 'url' FROM labelled_pages),"
        + S.parsed("news_in", "link", "news"),
        f"""SELECT page_id, position, link, CASE registered_domain WHEN 'example.com' THEN 'com_press' ELSE 'net_press' END AS publisher FROM news
        WHERE parse_ok AND registered_domain IN ('example.com', 'example.net') AND path <> '/' AND NOT {_BLOCKED} AND NOT {_ENDING}""",
    )
)
def news_url_filter(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.lit(-1).alias("position"), F.col("url").alias("link"))
    rows = t.links.select("page_id", "position", "link").unionByName(pages)
    press = t.spark.createDataFrame(
        [("com_press", "https://www.example.com"), ("net_press", "https://news.example.net/")], "publisher string, publisher_base_url string"
    )
    return extract.allowed_news(rows, "link", press).select("page_id", "position", "link", "publisher")


def _documents(t: Tables, root: str, item: str) -> DataFrame:
    """One sitemap document per page, listing its links."""
    links = extract.page_links(F.col("html"))
    base = F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1)

    def entry(href: Column) -> Column:
        loc = F.replace(F.concat(base, href), F.lit("&"), F.lit("&amp;"))
        return F.concat(
            F.lit(f"<{item}><loc> "), loc, F.lit(" </loc><lastmod>"), F.col("day"), F.lit(f"T08:00:00Z</lastmod></{item}>")
        )

    body = F.concat(
        F.lit(f'<?xml version="1.0"?><{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        F.array_join(F.transform(links, entry), ""), F.lit(f"</{root}>"),
    )
    return t.pages.select("page_id", body.alias("body"))


@query(_with(S.LINKS, "SELECT page_id, 'urlset' AS doc_type, position, link AS loc, day || 'T08:00:00Z' AS lastmod FROM links"))
def sitemap_entries(t: Tables) -> DataFrame:
    return extract.sitemap_entries(_documents(t, "urlset", "url")).select("page_id", "doc_type", "position", "loc", "lastmod")


@query(
    _with(
        S.LINKS + """, scored_maps AS (SELECT page_id, link AS loc, CASE WHEN contains(lower(link), 'news') THEN 4 ELSE 0 END
          + CASE WHEN contains(lower(link), 'article') OR contains(lower(link), 'post') THEN 2 ELSE 0 END
          + CASE WHEN day >= '2024-01-20' THEN 1 ELSE 0 END AS score FROM (SELECT DISTINCT page_id, link, day FROM links)),
        ranked_maps AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, loc DESC) AS rn, max(score) OVER (PARTITION BY page_id) AS best FROM scored_maps)""",
        "SELECT page_id, loc, score FROM ranked_maps WHERE score > 0 OR best = 0",
    )
)
def child_sitemaps(t: Tables) -> DataFrame:
    entries = extract.sitemap_entries(_documents(t, "sitemapindex", "sitemap"))
    return extract.select_child_sitemaps(entries, ["page_id"], "2024-01-27").select("page_id", "loc", "score")


@query(_with(S.LINKS, "SELECT page_id, CAST(position + 1 AS INTEGER) AS position, link AS sitemap_url FROM links"))
def robots_sitemaps(t: Tables) -> DataFrame:
    base = F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1)
    lines = F.transform(extract.page_links(F.col("html")), lambda h: F.concat(F.lit("Sitemap : "), base, h))
    docs = t.pages.select("page_id", F.concat(F.lit("User-agent: *\n"), F.array_join(lines, "\r\n")).alias("body"))
    return extract.robots_sitemaps(docs)


def _fallback_sql(rule: str, base: str, paths) -> str:
    return (
        f"SELECT host, '{rule}' AS rule, CAST(i - 1 AS INTEGER) AS position, {base} || paths[i] AS sitemap_url FROM (SELECT host, {S.text_list(paths)} AS paths FROM page_hosts), "
        f"unnest(range(1, {len(paths) + 1})) AS t(i)"
    )


@query(
    _with(
        S.PAGES,
        _fallback_sql("below", "'https://' || host || '/en/index.html'", V.NEWS_SITEMAP_PATHS) + " UNION ALL " + _fallback_sql("root", "'https://' || host", V.SITE_SITEMAP_PATHS),
    )
)
def default_sitemaps(t: Tables) -> DataFrame:
    """Fallbacks of news sites, below the home address, and of seeds, at the root."""
    sites = t.hosts.select("host", F.concat(F.lit("https://"), "host", F.lit("/en/index.html/")).alias("home"))
    kinds = (("below", V.NEWS_SITEMAP_PATHS, True), ("root", V.SITE_SITEMAP_PATHS, False))
    parts = [extract.default_sitemaps(sites, "home", paths, below).select("host", F.lit(rule).alias("rule"), "position", "sitemap_url") for rule, paths, below in kinds]
    return parts[0].unionByName(parts[1])


@query(
    _with(
        S.LINKS + ", news_in AS (SELECT page_id, position, link, day, 'url' AS record_type FROM links)," + S.parsed("news_in", "link", "news")
        + ", home_in AS (SELECT host AS publisher, 'https://' || host || '/' AS home, 'url' AS record_type FROM page_hosts)," + S.parsed("home_in", "home", "homes"),
        f"""SELECT url, publisher, sitemap_url, publication_date, title, collected_at FROM (
        SELECT link AS url, homes.publisher AS publisher, 'https://' || homes.publisher || '/map-' || page_id || '-news.xml' AS sitemap_url, news.day || 'T07:00:00Z' AS publication_date,
          'A & B < ' || position AS title, news.day AS collected_at, row_number() OVER (PARTITION BY homes.publisher, link ORDER BY 'https://' || homes.publisher || '/map-' || page_id || '-news.xml' DESC, position) AS rn
        FROM (SELECT * FROM news WHERE parse_ok) news JOIN (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM labelled_pages) p USING (page_id) JOIN homes ON homes.publisher = p.host
        WHERE news.registered_domain = homes.registered_domain AND news.path <> '/' AND page_id % 5 <> 0 AND news.day >= '2024-01-20' AND NOT {_BLOCKED} AND NOT {_ENDING.replace('path', 'news.path')})
        WHERE rn = 1""",
    )
)
def news_collection(t: Tables) -> DataFrame:
    """From robots files and fallbacks over indexes to news pages, on documents with nested and namespaced fields and broken ones."""
    spark = t.spark
    home = F.concat(F.lit("https://"), "host", F.lit("/press"))
    sites = t.hosts.select(F.col("host").alias("publisher"), home.alias("home"), "first_page")
    robots = sites.where("first_page % 2 = 0").select("publisher", F.concat(F.lit("User-agent: *\nSitemap: https://"), "publisher", F.lit("/robots-map.xml")).alias("body"))
    roots = extract.root_sitemaps(sites.drop("first_page"), extract.robots_sitemaps(robots), "publisher", "home", False, V.NEWS_SITEMAP_PATHS)
    pages = t.pages.select("page_id", "day", F.regexp_extract("url", HOST_IN_URL, 1).alias("publisher"))
    name = F.concat(F.lit("https://"), "publisher", F.lit("/map-"), "page_id", F.lit("-news.xml"))
    index = pages.groupBy("publisher").agg(F.min("page_id").alias("first_page"), F.array_join(F.transform(F.collect_set(name), lambda n: F.concat(F.lit("<s:sitemap><x><s:loc> "), n, F.lit(" </s:loc></x></s:sitemap>"))), "").alias("items"))
    place = F.when(F.col("first_page") % 2 == 0, "/robots-map.xml").otherwise("/press/news.xml")
    index = index.select(
        F.concat(F.lit("https://"), "publisher", place).alias("doc_url"), F.concat(F.lit('<?xml version="1.0"?><s:sitemapindex xmlns:s="http://s">'), "items", F.lit("</s:sitemapindex>")).alias("body")
    )
    entry = F.concat(
        F.lit("<url><wrap><loc><![CDATA["), "link", F.lit("]]></loc></wrap><n:news><n:title/><x><n:title>A &amp; B &lt; "), "position", F.lit("</n:title></x><n:publication_date>"), "day",
        F.lit("T07:00:00Z</n:publication_date></n:news></url>"),
    )
    listed = t.links.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", entry.alias("e")))), lambda x: x["e"]), "").alias("items"))
    end = F.when(F.col("page_id") % 5 == 0, "</broken>").otherwise("</urlset>")
    maps = pages.join(listed, "page_id").select(name.alias("doc_url"), F.concat(F.lit('<urlset xmlns="http://s" xmlns:n="http://n">'), "items", end).alias("body"))
    docs = materialize(index.unionByName(maps), "documents")
    press = sites.select("publisher", F.col("home").alias("publisher_base_url"))
    found = extract.expand_sitemaps(roots, docs, "publisher", "2024-01-27")
    return extract.news_rows(found, docs, press, "2024-01-27").select("url", "publisher", "sitemap_url", "publication_date", "title", "collected_at")


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(ts AS DATE) >= DATE '2024-01-13' AS recent FROM events"""
)
def recent_dates(t: Tables) -> DataFrame:
    """Dates written in several ways, read by the cascade."""
    ts = F.col("ts").cast("timestamp")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd"))
        .when(F.col("event_id") % 4 == 2, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" local")))
        .otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(" morning")))
    )
    return t.raw("events").select(
        "event_id", first_date(F.lit("soon"), text).alias("day"),
        looks_recent(F.lit(None).cast("string"), text, today="2024-01-20", lookback_days=7).alias("recent"),
    )


# --- scoring, learning, streaming -------------------------------------------

LINEAR = {
    "domain": models.LinearScorer(
        "domain", {"digit_ratio": 3.0, "num_hyphens": 0.75, "contains_sensitive_keyword": 1.5, "tld_risk_score": 1.0}, -1.0
    ),
    "url": models.LinearScorer(
        "url", {"sample_length": 0.015625, "suspicious_token_count": 0.75, "query_param_count": 0.25, "uses_http_scheme": 0.5}, -3.0
    ),
}


def _margin(kind: str) -> str:
    scorer = LINEAR[kind]
    table = S.DOMAIN_FEATURES if kind == "domain" else S.URL_FEATURES
    return f"{scorer.bias}" + "".join(f" + {w} * CAST({table[f]} AS DOUBLE)" for f, w in scorer.weights.items())


_ADVICE = "CASE WHEN predicted_label = 1 AND risk_level = 'high' THEN '{alert_now}' WHEN predicted_label = 1 THEN '{keep_in_log}' ELSE '{no_alert}' END".format(**V.ADVICE)
_SCORING = _SAMPLES + f""",
margins AS (
  SELECT event_id, record_type AS dataset_kind, value AS raw_value, canonical_hostname AS normalized_value, {_margin('domain')} AS m, '' AS error FROM parsed WHERE parse_ok AND record_type = 'domain'
  UNION ALL SELECT event_id, record_type, value, canonical_url, {_margin('url')}, '' FROM samples
  UNION ALL SELECT event_id, record_type, value, NULL, NULL, CASE record_type WHEN 'url' THEN 'Could not parse URL input. Reason: ' ELSE 'Could not parse domain input. Reason: ' END || invalid_reason
  FROM parsed WHERE NOT parse_ok),
scores AS (SELECT *, round(1 / (1 + exp(-m)), 6) AS score, CASE WHEN error <> '' THEN -1 WHEN m > 0 THEN 1 ELSE 0 END AS predicted_label FROM margins),
risks AS (SELECT *, CASE WHEN error <> '' THEN NULL WHEN score >= 0.5 THEN 'high' WHEN score >= 0.6 THEN 'medium' WHEN score >= 0.35 THEN 'low' ELSE 'minimal' END AS risk_level FROM scores)"""
_SCORE_COLS = ("event_id", "dataset_kind", "raw_value", "normalized_value", "predicted_label", "predicted_class", "score", "risk_level", "recommendation")
_SCORE_SELECT = f"""event_id, dataset_kind, raw_value, normalized_value, predicted_label,
    CASE predicted_label WHEN -1 THEN 'error' WHEN 1 THEN 'phishing' ELSE 'benign' END AS predicted_class, score, risk_level,
    CASE WHEN error <> '' THEN NULL ELSE {_ADVICE} END AS recommendation"""


def _requests(t: Tables) -> DataFrame:
    return t.requests.select("event_id", F.col("value").alias("raw_value"), rules.detect_kind("value").alias("dataset_kind"))


@query(_with(_SCORING, f"SELECT {_SCORE_SELECT}, error FROM risks"))
def score_table(t: Tables) -> DataFrame:
    return scoring.score_table(_requests(t), LINEAR).select(*_SCORE_COLS, "error")


@query(
    _with(
        _SCORING,
        """SELECT event_id, CASE WHEN event_id % 5 > 1 THEN dataset_kind WHEN event_id % 5 = 0 THEN 'ip' END AS dataset_kind,
        CASE WHEN event_id % 5 > 1 THEN predicted_label ELSE -1 END AS predicted_label, CASE WHEN event_id % 5 > 1 THEN score END AS score,
        CASE WHEN event_id % 5 > 1 THEN error WHEN event_id % 5 = 0 THEN '''ip''' ELSE '''nan''' END AS error FROM risks""",
    )
)
def score_seed_kinds(t: Tables) -> DataFrame:
    """Rows of another kind or none come out as errors: none is lost."""
    turn = F.col("event_id") % 5
    kind = F.when(turn > 1, F.col("dataset_kind")).when(turn == 0, "ip")
    scored = scoring.score_table(_requests(t).withColumn("dataset_kind", kind), LINEAR)
    return scored.select("event_id", "dataset_kind", "predicted_label", "score", "error")


@query(
    _with(
        S.REQUESTS,
        """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '`value` is required.' WHEN event_id % 7 = 0 THEN '`dataset_kind` must be one of: auto, domain, url.'
        ELSE '' END AS reject_reason, CASE WHEN event_id % 7 = 0 THEN 'ip' WHEN event_id % 7 = 1 THEN 'url' ELSE 'auto' END AS requested_kind,
        CASE WHEN event_id % 2 = 0 THEN 'proxy' ELSE 'ids_sensor' END AS source FROM requests""",
    )
)
def request_checks(t: Tables) -> DataFrame:
    e = F.col("event_id")
    asked = t.requests.select(
        "event_id", F.when(e % 5 == 0, "  ").otherwise(F.col("value")).alias("value"),
        F.when(e % 7 == 0, "IP").when(e % 7 == 1, " URL ").otherwise("").alias("dataset_kind"),
        F.when(e % 2 == 0, "proxy").otherwise(" ").alias("source"),
    )
    return scoring.check_requests(asked).select("event_id", "reject_reason", "requested_kind", "source")


@query()
def train_compare(t: Tables) -> DataFrame:
    """Six candidates at small sizes on the host features of the event requests, split by date."""
    dated = event_requests(t.raw("events")).join(t.labelled.select("event_id", "collected_at", "source"), "event_id")
    tasks = parsing_tasks(t.raw("events"))  # the join's own partitions go by bytes and are few
    typed = (dated.repartition(tasks) if tasks > 1 else dated).withColumn("record_type", rules.detect_kind("value"))
    rows = parse_records(typed, "value").where("parse_ok").select(
        F.col("canonical_hostname").alias("sample_text"), "hostname", "registered_domain", "subdomain", "suffix", "collected_at",
        F.col("source").isin("purchase", "view").cast("int").alias("label"),
    )
    rows = materialize(rows, "rows")  # parsed once: the split dates, the checks and the features read it
    return models.train_compare(sampling.temporal_split(rows), "domain", sizes=models.SMALL).comparison


def _wait(running) -> None:
    running.awaitTermination(600)
    if running.isActive:
        running.stop()
        raise TimeoutError("stream did not finish")
    if running.exception() is not None:
        raise running.exception()


@query(_with(S.LOG, _SUMMARY))
def stream_event_summary(t: Tables) -> DataFrame:
    out = fresh_path(t.spark, "summary")
    _wait(flows.write_summary(event_log(t.stream("events")), f"{out}/table", f"{out}/checkpoint"))
    return t.spark.read.parquet(f"{out}/table")


@query(
    _with(
        S.PAGES + ", first_in AS (SELECT *, 'url' AS record_type FROM labelled_pages)," + S.parsed("first_in", "url", "pp"),
        """SELECT canonical_url, original_value, source, collected_at FROM (SELECT canonical_url, url AS original_value, source, day AS collected_at, row_number() OVER (
        PARTITION BY canonical_url ORDER BY day, source, url, CAST(page_id AS VARCHAR)) AS rn FROM pp WHERE parse_ok) WHERE rn = 1""",
    )
)
def stream_new_urls(t: Tables) -> DataFrame:
    out = fresh_path(t.spark, "new-urls")
    _wait(flows.write_new_urls(page_records(labelled_pages(t.stream("pages"))), f"{out}/table", f"{out}/checkpoint"))
    return flows.master_urls(t.spark, f"{out}/table").select("canonical_url", "original_value", "source", "collected_at")


_EVENT_COLS = [c for c in _SCORE_COLS if c != "event_id"]


@query(_with(_SCORING, f"SELECT {_SCORE_SELECT.replace('event_id, ', '', 1)} FROM risks WHERE error = ''"))
def stream_score(t: Tables) -> DataFrame:
    out = fresh_path(t.spark, "events")
    requests = event_requests(t.stream("events")).select("value", F.lit("auto").alias("dataset_kind"))
    _wait(flows.write_scores(requests, LINEAR, f"{out}/log", f"{out}/checkpoint", f"{out}/rejects"))
    from hostlens.sources.tables import scan_event_log

    return scan_event_log(t.spark, f"{out}/log").select(*_EVENT_COLS)


@query(
    """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN user_id END AS user_id, CASE WHEN event_id % 3 < 2 THEN round(value, 6) END AS number, CASE WHEN event_id % 3 < 2 THEN event_type END AS kind,
    CASE WHEN event_id % 3 = 2 THEN '[' || event_id || ']' END AS raw_text FROM events"""
)
def event_metadata(t: Tables) -> DataFrame:
    """Nested metadata through a JSON log and back: numbers, lists and objects keep their types; what is no object is kept as text."""
    nested = F.to_json(F.struct("user_id", F.struct("value", F.array(F.lit(None), F.col("event_type")).alias("kinds")).alias("inner")), {"ignoreNullFields": "false"})
    raw = F.when(F.col("event_id") % 3 < 2, nested).otherwise(F.concat(F.lit("["), "event_id", F.lit("]")))
    out = fresh_path(t.spark, "log")
    t.raw("events").select(F.col("event_id").cast("string").alias("event_id"), scoring.wrap_metadata(raw).alias("metadata")).write.json(out)
    log = t.spark.read.schema("event_id string, metadata variant").json(out)
    get = lambda path, kind: F.try_variant_get("metadata", path, kind)
    return log.select(
        F.col("event_id").cast("long").alias("event_id"), get("$.user_id", "bigint").alias("user_id"), F.round(get("$.inner.value", "double"), 6).alias("number"),
        get("$.inner.kinds[1]", "string").alias("kind"), get("$.raw_metadata", "string").alias("raw_text"),
    )


@query(
    _with(
        _SCORING,
        """SELECT raw_value, 'event' AS outcome, '' AS reason FROM risks WHERE error = '' AND event_id % 4 <> 0
        UNION ALL SELECT raw_value, 'reject', error FROM risks WHERE error <> '' AND event_id % 4 <> 0
        UNION ALL SELECT CASE WHEN event_id % 8 = 0 THEN 'http://nohost/' ELSE '' END, 'reject',
        CASE WHEN event_id % 8 = 0 THEN 'Could not parse URL input. Reason: invalid_hostname' ELSE '`value` is required.' END FROM risks WHERE event_id % 4 = 0""",
    )
)
def stream_rejects(t: Tables) -> DataFrame:
    """Every request of a stream is an event or a reject with its reason."""
    out = fresh_path(t.spark, "requests")
    value = F.when(F.col("event_id") % 8 == 0, "http://nohost/").when(F.col("event_id") % 4 == 0, " ").otherwise(F.col("value"))
    requests = event_requests(t.stream("events")).select(value.alias("value"), F.lit("auto").alias("dataset_kind"))
    _wait(flows.write_scores(requests, LINEAR, f"{out}/log", f"{out}/checkpoint", f"{out}/rejects"))
    events = t.spark.read.schema("raw_value string").json(f"{out}/log").select("raw_value", F.lit("event").alias("outcome"), F.lit("").alias("reason"))
    rejects = t.spark.read.schema("raw_value string, reject_reason string").json(f"{out}/rejects")
    return events.unionByName(rejects.select("raw_value", F.lit("reject").alias("outcome"), F.col("reject_reason").alias("reason")))
