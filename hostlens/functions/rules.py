"""Scalar scoring rules: kind, risk, advice, signals, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.functions.text import col, contains_any, count_present, occurrences, parts_count


def detect_kind(value: Column | str, requested: Column | str | None = None) -> Column:
    """The explicit kind wins; otherwise URL punctuation makes it a URL."""
    guessed = F.when(col(value).rlike(r"://|[/?#]"), F.lit("url")).otherwise(F.lit("domain"))
    if requested is None:
        return guessed
    return F.when(col(requested).isin("domain", "url"), col(requested)).otherwise(guessed)


def risk_level(score: Column | str, bands=V.RISK_BANDS) -> Column:
    """First band whose floor is reached, tested in the order given."""
    s = col(score)
    level = None
    for name, floor in bands:
        level = F.when(s >= floor, name) if level is None else level.when(s >= floor, name)
    return level.otherwise(F.lit(V.LOWEST_RISK))


def recommendation(predicted: Column | str, risk: Column | str) -> Column:
    p, r = col(predicted), col(risk)
    return (
        F.when((p == 1) & (r == "high"), V.ADVICE["alert_now"])
        .when((p == 1) & (r == "medium"), V.ADVICE["show_and_watch"])
        .when(p == 1, V.ADVICE["keep_in_log"])
        .otherwise(V.ADVICE["no_alert"])
    )


def sigmoid(raw: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-col(raw)))


def domain_signals(suffix: Column | str = "suffix") -> Column:
    """Needs the domain feature columns."""
    before, after = V.SIGNAL_TEXT["risky_tld"].split("{suffix}")
    return _first_signals(
        [
            (F.col("contains_brand_name") >= 1, F.lit(V.SIGNAL_TEXT["brand"])),
            (F.col("contains_sensitive_keyword") >= 1, F.lit(V.SIGNAL_TEXT["host_keyword"])),
            (F.col("edit_distance_to_top_brand") <= 1, F.lit(V.SIGNAL_TEXT["near_brand"])),
            (F.col("tld_risk_score") >= 0.7, F.concat(F.lit(before), col(suffix), F.lit(after))),
            (F.col("digit_ratio") >= 0.2, F.lit(V.SIGNAL_TEXT["host_digits"])),
            (F.col("is_idn_or_punycode") >= 1, F.lit(V.SIGNAL_TEXT["punycode"])),
        ]
    )


def url_signals() -> Column:
    """Needs the URL feature columns."""
    return _first_signals(
        [
            (F.col("suspicious_token_count") >= 1, F.lit(V.SIGNAL_TEXT["url_keyword"])),
            (F.col("uses_http_scheme") >= 1, F.lit(V.SIGNAL_TEXT["plain_http"])),
            (F.col("has_https_token_in_host") >= 1, F.lit(V.SIGNAL_TEXT["https_in_host"])),
            (F.col("has_ip_host") >= 1, F.lit(V.SIGNAL_TEXT["ip_host"])),
            (F.col("query_param_count") >= 4, F.lit(V.SIGNAL_TEXT["many_params"])),
            (F.col("special_char_ratio") >= 0.35, F.lit(V.SIGNAL_TEXT["special_chars"])),
        ]
    )


def _first_signals(rules) -> Column:
    return F.slice(F.array_compact(F.array(*[F.when(test, text) for test, text in rules])), 1, V.MAX_SIGNALS)


def category(value: Column | str) -> Column:
    """First category one of whose tokens occurs in the text."""
    text = F.lower(col(value))
    found = None
    for name, tokens in V.CATEGORY_TOKENS.items():
        test = contains_any(text, tokens)
        found = F.when(test, name) if found is None else found.when(test, name)
    return found.otherwise(F.lit(V.OTHER_CATEGORY))


def category_turn(name: Column | str) -> Column:
    turn = F.lit(None).cast("int")
    for i, key in enumerate(V.CATEGORY_TURN):
        turn = F.when(col(name) == key, i).otherwise(turn)
    return turn


def lookup(key: Column, table: dict, default) -> Column:
    """Small fixed map as a `when` chain: constant-folded, no map built per row."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def priority(name: Column | str) -> Column:
    return lookup(col(name), V.CATEGORY_PRIORITY, None)


def candidate_order(url: Column | str, host: Column | str, name: Column | str) -> list[Column]:
    """Sort key of seed candidates: category, token hits, specials plus host depth, text."""
    text = F.lower(col(url))
    tokens = [t for group in V.CATEGORY_TOKENS.values() for t in group]
    specials = occurrences(text, "?") + occurrences(text, "=") + occurrences(text, "&")
    return [
        category_turn(name).asc(),
        count_present(text, tokens).desc(),
        (specials + parts_count(col(host), "\\.")).desc(),
        text.asc(),
    ]


def portal_order(url: Column | str, host: Column | str) -> list[Column]:
    """Sort key of portal pages: keyword hits, host depth, text."""
    text = F.lower(col(url))
    return [
        count_present(text, V.PORTAL_KEYWORDS).desc(),
        parts_count(col(host), "\\.").desc(),
        text.asc(),
    ]


def expected_label_int(value: Column | str) -> Column:
    text = F.lower(F.trim(col(value)))
    problem = F.raise_error(F.concat(F.lit("Unsupported expected_label: "), F.coalesce(col(value), F.lit("null"))))
    return F.when(text == "benign", 0).when(text == "phishing", 1).otherwise(problem.cast("int"))
