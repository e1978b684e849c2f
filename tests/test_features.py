import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.functions import rules
from hostlens.operators.features import domain_features, features, url_features


def bits(t):
    return -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) if t else 0.0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
    return row[-1]


HOSTS = [
    ("secure-paypa1-login.xyz", "", "xyz", "secure-paypa1-login.xyz"), ("xn--bcher-kva.de", "", "de", "xn--bcher-kva.de"),
    ("a.b.apple.co.uk", "a.b", "co.uk", "apple.co.uk"), ("1.2.3.4", "", "", "1.2.3.4"), ("aaa", "", "", ""), ("", None, None, None),
    ("google.tk", "", "TK", "google.tk"), ("...", "", "", ""), ("bcdfg--zz.com", "", "com", "x"),
]


def expect_domain(h, sub, suffix, reg):
    sub, suffix, reg = sub or "", suffix or "", reg or ""
    tokens = [t for t in re.split("[^a-z0-9]+", h) if t]
    at = [h.find(b) for b in V.BRANDS if b in h]
    return (
        len(h), len([p for p in sub.split(".") if p]), len(tokens), h.count("-"), sum(c.isdigit() for c in h) / max(1, len(h)),
        bits(h), bool(at), any(k in h for k in V.SENSITIVE_KEYWORDS),
        min((lev(t, b) for t in tokens for b in V.BRANDS), default=13), V.TLD_RISK.get(suffix.lower(), 0.0),
        1 - min(at) / max(1, len(h) - 1) if at else 0.0, len(reg),
        max((len(m) for m in re.findall(f"[{V.CONSONANTS}]+", h)), default=0),
        sum(x == y for x, y in zip(h, h[1:])) / len(h) if h else 0.0, bool(re.search(r"(^|[.-])xn--", h)),
    )


def test_domain_features(spark):
    df = spark.createDataFrame(HOSTS, "hostname string, subdomain string, suffix string, registered_domain string")
    out = domain_features(df)
    assert out.columns[-15:] == list(V.DOMAIN_FEATURES)
    assert all(t == "double" for c, t in out.dtypes if c in V.DOMAIN_FEATURES)
    got = {r.hostname: r for r in out.collect()}
    for row in HOSTS:
        assert [got[row[0]][n] for n in V.DOMAIN_FEATURES] == pytest.approx([float(x) for x in expect_domain(*row)], abs=1e-9), row


URLS = [
    "http://a.com/login/verify?x=1&y=2#f", "https://https-oauth.xyz/~a_b/%20?q=a@b:c", "", "http://1.2.3.4/", "http://é.com/١٢٣", "aa",
]


def test_url_features(spark):
    rows = [(u, re.sub(r"^\w+://|[/?#].*", "", u), u.split(":")[0] if ":" in u else None, "/x//y/", "a=1&b" if "?" in u else "", "f" if "#" in u else None, "1" if "1.2" in u else None) for u in URLS]
    df = spark.createDataFrame(rows, "sample_text string, hostname string, scheme string, path string, query string, fragment string, is_ip_host string")
    out = url_features(df)
    assert out.columns[-37:] == list(V.URL_FEATURES)
    got = {r.sample_text: r for r in out.collect()}
    for s, h, scheme, path, q, f, ip in rows:
        alnum = len(re.findall("[A-Za-z0-9]", s))
        n = max(1, len(s))
        want = {
            "sample_length": len(s), "hostname_length": len(h), "path_depth": 2, "query_param_count": 2 if q else 0,
            "digit_count": len(re.findall(r"\d", s)), "alpha_count": len(re.findall("[A-Za-z]", s)), "alnum_count": alnum,
            "special_char_count": len(s) - alnum, "special_char_ratio": (len(s) - alnum) / n, "digit_ratio": len(re.findall(r"\d", s)) / n,
            "unique_char_ratio": len(set(s)) / n, "sample_entropy": bits(s), "hostname_entropy": bits(h),
            "suspicious_token_count": sum(k in s.lower() for k in V.SENSITIVE_KEYWORDS), "has_https_token_in_host": "https" in h,
            "uses_http_scheme": scheme == "http", "uses_https_scheme": scheme == "https", "has_fragment": bool(f), "has_query": bool(q),
            "has_ip_host": ip == "1", "tilde_count": s.count("~"), "percent_count": s.count("%"), "at_count": s.count("@"),
            "colon_count": s.count(":"), "slash_count": s.count("/"), "subdomain_depth": 0, "registered_domain_length": 0,
        }
        for name, value in want.items():
            assert got[s][name] == pytest.approx(float(value), abs=1e-9), (s, name)


def test_dispatch(spark):
    with pytest.raises(ValueError):
        features(spark.range(1), "mail")


def test_rules(spark):
    df = spark.createDataFrame([(0.7,), (0.5,), (0.4,), (0.1,)], "s double")
    assert [r[0] for r in df.select(rules.risk_level("s")).collect()] == ["high", "high", "low", "minimal"]
    bands = (("high", 0.9), ("medium", 0.6), ("low", 0.35))
    assert [r[0] for r in df.select(rules.risk_level("s", bands)).collect()] == ["medium", "low", "low", "minimal"]
    advice = df.select(rules.recommendation(F.lit(1), rules.risk_level("s", bands))).collect()
    assert [r[0] for r in advice] == [V.ADVICE[k] for k in ("show_and_watch", "keep_in_log", "keep_in_log", "keep_in_log")]
    kinds = spark.createDataFrame([("a.com", None), ("a.com/x", None), ("a.com?x", "auto"), ("a.com/x", "domain")], "v string, k string")
    assert [r[0] for r in kinds.select(rules.detect_kind("v", "k")).collect()] == ["domain", "url", "url", "domain"]
    with pytest.raises(Exception, match="Unsupported expected_label"):
        spark.createDataFrame([("maybe",)], "x string").select(rules.expected_label_int("x")).collect()


def test_categories(spark):
    texts = {"http://my-BANK.com": "banking_payment", "trezor.io": "crypto_wallet", "dhl.de": "ecommerce_delivery", "x.com/viewpdf": "cloud_email_docs", "roblox.com": "social_gaming", "netflix.com": "generic_portal"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", rules.category("t").alias("c"), rules.priority(rules.category("t")).alias("p")).collect()
    assert {r.t: r.c for r in rows} == texts and all(r.p == V.CATEGORY_PRIORITY[r.c] for r in rows)
