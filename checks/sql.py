"""The same views and rules in SQL, written independently of the Spark side, for the oracle."""

from __future__ import annotations

from hostlens import fixed_values as V
from checks.views import SPAM_HOSTS


def text_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# Suffixes of the hosts that occur in the tables; the Spark side uses the full public list.
SUFFIXES = text_list(["com", "net", "org", "xyz", "uk", "co.uk"])
LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
IPV4 = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}"

PAGES = rf"""
labelled_pages AS (
  SELECT page_id, url, html,
    CASE WHEN regexp_matches(url, '://[^/]*({SPAM_HOSTS})') OR page_id % 97 = 5 THEN 1 ELSE 0 END AS label,
    'feed' || CAST(page_id % 4 AS VARCHAR) AS source,
    strftime(DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER), '%Y-%m-%d') AS day
  FROM pages),
page_hosts AS (
  SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, min(page_id) AS first_page FROM pages GROUP BY 1)"""

LINKS = PAGES + r""",
link_lists AS (
  SELECT *, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS hrefs FROM labelled_pages),
links AS (
  SELECT page_id, url, label, source, day, CAST(i - 1 AS INTEGER) AS position, hrefs[i] AS href,
    regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || hrefs[i] AS link
  FROM link_lists, unnest(range(1, len(hrefs) + 1)) AS t(i))"""

RECORDS = LINKS + """,
records AS (
  SELECT url AS original_value, label, source, day AS collected_at, 'url' AS record_type,
    CAST(page_id AS VARCHAR) AS source_record_id, CAST(NULL AS BIGINT) AS source_rank, '' AS source_target
  FROM labelled_pages
  UNION ALL
  SELECT host, 0, 'ranked', '2024-01-15', 'domain', '', first_page, '' FROM page_hosts
  UNION ALL
  SELECT link, label, 'links', day, 'url', CAST(page_id AS VARCHAR), position, '' FROM links
  UNION ALL
  SELECT href, 0, 'raw', day, CASE WHEN position % 2 = 0 THEN 'url' ELSE 'domain' END,
    CAST(page_id AS VARCHAR), position, '' FROM links)"""

REQUESTS = """
requests AS (
  SELECT event_id,
    CASE event_type
      WHEN 'purchase' THEN 'http://user' || user_id || '-paypal-login.xyz/pay/confirm;s=1?session=' || event_id
        || '&b=' || user_id || '&a=x y&ref=mail#top'
      WHEN 'signup' THEN 'Secure-User' || user_id || '.Example.co.uk.'
      WHEN 'click' THEN 'https://shop' || user_id || '.example.com:443/a/b//c?x=' || event_id || '&utm_source=z'
      WHEN 'view' THEN '10.' || (user_id % 256) || '.0.' || (event_id % 256)
      ELSE 'http://node' || user_id || '/x?q=1' END AS value
  FROM events)"""

DETECTED = REQUESTS + r""",
typed AS (
  SELECT *, CASE WHEN value LIKE '%://%' OR regexp_matches(value, '[/?#]') THEN 'url' ELSE 'domain' END AS record_type
  FROM requests)"""


def parsed(source: str, value: str, name: str = "parsed") -> str:
    """CTEs adding the parsed columns to `source`."""
    decode = "url_decode(replace({0}, '+', ' '))"
    encode = "replace(url_encode({0}), '%20', '+')"
    pair = (
        "{'k': " + decode.format("split_part(x, '=', 1)") + ", 'v': "
        + decode.format("CASE WHEN contains(x, '=') THEN substr(x, instr(x, '=') + 1) ELSE '' END") + "}"
    )
    return rf"""
{name}_1 AS (
  SELECT *, trim({value}) AS v, lower(trim(record_type)) AS t FROM {source}),
{name}_2 AS (
  SELECT *, lower(regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS p_scheme,
    regexp_extract(v, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS netloc,
    regexp_replace(regexp_extract(v, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS p_path,
    regexp_extract(v, '^[^?#]*\?([^#]*)', 1) AS p_query, regexp_extract(v, '#(.*)$', 1) AS p_fragment
  FROM {name}_1),
{name}_3 AS (
  SELECT *, CASE WHEN t = 'domain' THEN trim(lower(v), '.') ELSE trim(lower(regexp_extract(netloc, '^([^:]*)', 1)), '.') END AS host,
    TRY_CAST(regexp_extract(netloc, ':([0-9]+)$', 1) AS INTEGER) AS port
  FROM {name}_2),
{name}_4 AS (
  SELECT *, regexp_full_match(host, '{IPV4}') AS ip,
    CASE WHEN lower(v) IN ('', '-', '--', '---', 'n/a', 'na', 'none', 'null', 'unknown') THEN 'empty_value'
      WHEN t NOT IN ('domain', 'url') THEN 'unknown_record_type'
      WHEN t = 'url' AND p_scheme NOT IN ('http', 'https') THEN 'unsupported_scheme'
      WHEN host = '' THEN CASE WHEN t = 'url' THEN 'missing_hostname' ELSE 'invalid_domain' END
      WHEN NOT (regexp_full_match(host, '{IPV4}') OR (length(host) <= 253 AND regexp_full_match(host, '{LABEL}(\.{LABEL})+')))
        THEN 'invalid_hostname'
      ELSE '' END AS invalid_reason
  FROM {name}_3),
{name}_5 AS (
  SELECT *, invalid_reason = '' AS parse_ok, string_split(host, '.') AS labels FROM {name}_4),
{name}_6 AS (
  SELECT *, CASE WHEN ip OR NOT parse_ok THEN 0
      WHEN list_contains({SUFFIXES}, array_to_string(labels[-2:], '.')) AND len(labels) >= 2 THEN 2
      WHEN list_contains({SUFFIXES}, labels[-1]) THEN 1 ELSE 0 END AS n_suffix,
    list_sort(list_filter(list_transform(list_filter(string_split(p_query, '&'), lambda x: x <> ''), lambda x: {pair}),
      lambda s: NOT list_contains({text_list(V.TRACKING_PARAMS)}, lower(s.k)))) AS pairs
  FROM {name}_5),
{name}_7 AS (
  SELECT *, CASE WHEN n_suffix > 0 THEN array_to_string(labels[len(labels) - n_suffix + 1:], '.') ELSE '' END AS suffix,
    CASE WHEN NOT parse_ok THEN '' WHEN ip THEN host WHEN len(labels) > n_suffix THEN labels[len(labels) - n_suffix] ELSE '' END AS domain,
    CASE WHEN NOT parse_ok OR ip OR len(labels) - n_suffix < 2 THEN ''
      ELSE array_to_string(labels[1:len(labels) - n_suffix - 1], '.') END AS subdomain,
    array_to_string(list_transform(pairs, lambda s: {encode.format('s.k')} || '=' || {encode.format('s.v')}), '&') AS c_query
  FROM {name}_6),
{name} AS (
  SELECT * EXCLUDE (v, t, p_scheme, netloc, p_path, p_query, p_fragment, host, port, ip, labels, n_suffix, pairs, c_query),
    CASE WHEN parse_ok AND t = 'url' THEN p_scheme ELSE '' END AS scheme,
    CASE WHEN parse_ok THEN host ELSE '' END AS hostname,
    CASE WHEN domain <> '' AND suffix <> '' THEN domain || '.' || suffix ELSE domain || suffix END AS registered_domain,
    CASE WHEN parse_ok AND t = 'url' THEN CASE WHEN p_path = '' THEN '/' ELSE p_path END ELSE '' END AS path,
    CASE WHEN parse_ok AND t = 'url' THEN p_query ELSE '' END AS query,
    CASE WHEN parse_ok AND t = 'url' THEN p_fragment ELSE '' END AS fragment,
    CASE WHEN parse_ok AND ip THEN 1 ELSE 0 END AS is_ip_host,
    CASE WHEN parse_ok THEN host ELSE '' END AS canonical_hostname,
    CASE WHEN parse_ok AND t = 'url' THEN p_scheme || '://' || host
      || CASE WHEN port > 0 AND port <> (CASE p_scheme WHEN 'http' THEN 80 ELSE 443 END) THEN ':' || port ELSE '' END
      || CASE WHEN p_path = '' THEN '/' ELSE p_path END
      || CASE WHEN c_query <> '' THEN '?' || c_query ELSE '' END ELSE '' END AS canonical_url
  FROM {name}_7)"""


PARSED = RECORDS + "," + parsed("records", "original_value")
PARSED_REQUESTS = DETECTED + "," + parsed("typed", "value")

FEED_ORDER = (
    "collected_at, label DESC, source NULLS LAST, source_rank NULLS LAST, original_value NULLS LAST, "
    "source_record_id NULLS LAST, source_target NULLS LAST"
)

# Overlap first, on hosts or URLs, then keep-first: the order of the stated rule.
CLEAN = PARSED + f""",
valid AS (SELECT * FROM parsed WHERE parse_ok),
kept AS (
  SELECT * FROM valid WHERE NOT (label = 0 AND (
    canonical_hostname IN (SELECT canonical_hostname FROM valid WHERE label = 1)
    OR canonical_url IN (SELECT canonical_url FROM valid WHERE label = 1 AND canonical_url <> '')))),
clean AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY record_type, CASE WHEN record_type = 'domain' THEN canonical_hostname ELSE canonical_url END
      ORDER BY {FEED_ORDER}) AS rn FROM kept) WHERE rn = 1)"""

ADDON = """
addon_in AS (
  SELECT host AS input_value, CASE WHEN first_page % 2 = 0 THEN '2023-12-31' ELSE '2025-04-07' END AS collected_at,
    'domain' AS record_type FROM page_hosts),""" + parsed("addon_in", "input_value", "addon")

DOMAIN_DATASET = CLEAN + "," + ADDON + f""",
domain_pool AS (
  SELECT canonical_hostname AS sample_text, label, source, collected_at, record_type, registered_domain, subdomain, suffix,
    is_ip_host, source_rank, original_value, source_record_id, source_target
  FROM clean WHERE canonical_hostname <> ''
  UNION ALL
  SELECT canonical_hostname, 0, 'vn_benign_domain_addon', collected_at, 'domain', registered_domain, subdomain, suffix,
    is_ip_host, NULL, NULL, NULL, NULL FROM addon WHERE parse_ok),
domain_firsts AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_text ORDER BY {FEED_ORDER}) AS rn FROM domain_pool) WHERE rn = 1),
domain_dataset AS (
  SELECT * FROM domain_firsts WHERE NOT (label = 0 AND sample_text IN (SELECT sample_text FROM domain_firsts WHERE label = 1)))"""

LABELLED = """
labelled AS (
  SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS label,
    CAST(event_type = 'error' AND value > 224 AS INTEGER) AS rare, event_type AS source,
    strftime(ts, '%Y-%m-%d') AS collected_at FROM events)"""

LOG = """
log AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS received_at,
    CASE WHEN event_type IN ('signup', 'view') THEN 'domain' ELSE 'url' END AS dataset_kind,
    CAST(round(least(value / 100.0, 1.0), 6) >= 0.6 AS INTEGER) AS predicted_label,
    round(least(value / 100.0, 1.0), 6) AS score,
    CASE WHEN round(least(value / 100.0, 1.0), 6) >= 0.5 THEN 'high'
      WHEN round(least(value / 100.0, 1.0), 6) >= 0.6 THEN 'medium'
      WHEN round(least(value / 100.0, 1.0), 6) >= 0.35 THEN 'low' ELSE 'minimal' END AS risk_level
  FROM events)"""

SCORED = """
scored_0 AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, d.lang AS dataset_kind, d.source AS category,
    CASE WHEN l.toxic = 1 THEN 'critical' WHEN d.n_chars > 400 THEN 'high' END AS priority,
    CASE WHEN l.quality = 1 THEN 'phishing' ELSE 'benign' END AS expected_label,
    round(d.n_chars / 20000.0, 6) AS score, l.quality AS label, d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
scored_1 AS (
  SELECT *, CASE WHEN n_chars % 23 = 0 THEN -1 WHEN score >= 0.02 THEN 1 ELSE 0 END AS predicted_label FROM scored_0),
scored AS (
  SELECT *, CASE WHEN predicted_label = -1 THEN 'unreadable' ELSE '' END AS error,
    greatest(predicted_label, 0) AS prediction,
    predicted_label = label AS match_expected,
    label = 0 AND predicted_label = 1 AS is_false_positive,
    label = 1 AND predicted_label = 0 AS is_false_negative
  FROM scored_1)"""

MEASURES = """count(*) AS total_cases, count(*) FILTER (match_expected) AS matched_cases,
    count(*) FILTER (predicted_label = 0) AS predicted_benign, count(*) FILTER (predicted_label = 1) AS predicted_phishing,
    count(*) FILTER (is_false_positive) AS false_positives, count(*) FILTER (is_false_negative) AS false_negatives,
    count(*) FILTER (error <> '') AS errors, round(avg(score), 6) AS average_score,
    round(count(*) FILTER (is_false_positive) / count(*), 6) AS false_positive_rate,
    round(count(*) FILTER (is_false_negative) / count(*), 6) AS false_negative_rate,
    round(count(*) FILTER (match_expected) / count(*), 6) AS match_rate"""


def entropy(text: str) -> str:
    count = f"(length({text}) - length(replace({text}, c, '')))"
    share = f"({count} / length({text}))"
    return (
        f"coalesce(list_sum(list_transform(list_distinct(list_filter(string_split({text}, ''), lambda c: c <> '')), "
        f"lambda c: -{share} * log2({share}))), 0)"
    )


def count_char(text: str, char: str) -> str:
    return f"(length({text}) - length(replace({text}, '{char}', '')))"


def count_re(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def any_of(text: str, words) -> str:
    return f"list_bool_or(list_transform({text_list(words)}, lambda w: contains({text}, w)))"


def hits(text: str, words) -> str:
    return f"CAST(list_sum(list_transform({text_list(words)}, lambda w: CAST(contains({text}, w) AS INTEGER))) AS INTEGER)"


def parts(text: str, sep: str) -> str:
    return f"len(list_filter(string_split({text}, '{sep}'), lambda p: p <> ''))"


_TOKENS = "list_filter(regexp_split_to_array(lower(hostname), '[^a-z0-9]+'), lambda k: k <> '')"
_BRAND_AT = (
    f"list_min(list_filter(list_transform({text_list(V.BRANDS)}, lambda b: instr(lower(hostname), b)), lambda i: i > 0))"
)
_RISK = "CASE lower(suffix) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.TLD_RISK.items()) + " ELSE 0 END"

DOMAIN_FEATURES = {
    "domain_length": "length(hostname)",
    "subdomain_count": parts("subdomain", "."),
    "num_tokens_domain": f"len({_TOKENS})",
    "num_hyphens": count_char("hostname", "-"),
    "digit_ratio": count_re("hostname", "[0-9]") + " / greatest(length(hostname), 1)",
    "entropy_domain": entropy("hostname"),
    "contains_brand_name": any_of("hostname", V.BRANDS),
    "contains_sensitive_keyword": any_of("hostname", V.SENSITIVE_KEYWORDS),
    "edit_distance_to_top_brand": (
        f"coalesce(list_min(list_transform({_TOKENS}, lambda t: list_min(list_transform({text_list(V.BRANDS)}, "
        "lambda b: levenshtein(t, b))))), 13)"
    ),
    "tld_risk_score": _RISK,
    "brand_position_score": f"coalesce(1 - ({_BRAND_AT} - 1) / greatest(length(hostname) - 1, 1), 0)",
    "registered_domain_length": "length(registered_domain)",
    "consonant_run_max": (
        f"coalesce(list_max(list_transform(regexp_extract_all(lower(hostname), '[{V.CONSONANTS}]+'), lambda r: length(r))), 0)"
    ),
    "char_repeat_ratio": (
        "coalesce(list_sum(list_transform(range(2, length(hostname) + 1), "
        "lambda i: CAST(substr(hostname, i, 1) = substr(hostname, i - 1, 1) AS INTEGER))), 0) / greatest(length(hostname), 1)"
    ),
    "is_idn_or_punycode": r"regexp_matches(hostname, '(^|[.\-])xn--')",
}

_S = "sample_text"
URL_FEATURES = {
    "sample_length": f"length({_S})", "hostname_length": "length(hostname)",
    "registered_domain_length": "length(registered_domain)", "subdomain_length": "length(subdomain)",
    "path_length": "length(path)", "query_length": "length(query)", "fragment_length": "length(fragment)",
    **{
        n: count_char(_S, c)
        for n, c in (
            ("dot_count", "."), ("hyphen_count", "-"), ("underscore_count", "_"), ("slash_count", "/"),
            ("question_mark_count", "?"), ("ampersand_count", "&"), ("equal_count", "="), ("at_count", "@"),
            ("percent_count", "%"), ("tilde_count", "~"), ("colon_count", ":"),
        )
    },
    "digit_count": count_re(_S, "[0-9]"),
    "alpha_count": count_re(_S, "[A-Za-z]"), "alnum_count": count_re(_S, "[A-Za-z0-9]"),
    "special_char_count": f"length({_S}) - " + count_re(_S, "[A-Za-z0-9]"),
    "digit_ratio": count_re(_S, "[0-9]") + f" / length({_S})",
    "special_char_ratio": f"(length({_S}) - " + count_re(_S, "[A-Za-z0-9]") + f") / length({_S})",
    "unique_char_ratio": f"len(list_distinct(list_filter(string_split({_S}, ''), lambda c: c <> ''))) / length({_S})",
    "sample_entropy": entropy(_S), "hostname_entropy": entropy("hostname"),
    "subdomain_depth": parts("subdomain", "."), "path_depth": parts("path", "/"),
    "query_param_count": f"CASE WHEN query = '' THEN 0 ELSE {count_char('query', '&')} + 1 END",
    "suspicious_token_count": hits(f"lower({_S})", V.SENSITIVE_KEYWORDS),
    "has_https_token_in_host": "contains(lower(hostname), 'https')",
    "uses_http_scheme": "scheme = 'http'", "uses_https_scheme": "scheme = 'https'",
    "has_fragment": "fragment <> ''", "has_query": "query <> ''", "has_ip_host": "is_ip_host",
}


def feature_list(table: dict[str, str], names=None) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in table.items() if names is None or n in names)
