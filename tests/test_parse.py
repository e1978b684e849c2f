import ipaddress
from urllib.parse import parse_qsl, quote_plus, urljoin, urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.functions import hosts
from hostlens.functions.urls import resolve_reference
from hostlens.operators.parse import host_parts, parse_records
from hostlens.sources.suffix_rules import SuffixRules, parse_rules

LONG = "a" * 64

URLS = {
    # value: (reason, host, path, canonical url)
    "": ("empty_value", "", "", ""),
    "n/a": ("empty_value", "", "", ""),
    " - ": ("empty_value", "", "", ""),
    "　": ("empty_value", "", "", ""),
    "javascript:x": ("unsupported_scheme", "", "", ""),
    "DATA:text/html,x": ("unsupported_scheme", "", "", ""),
    "ftp://a.com": ("unsupported_scheme", "", "", ""),
    "localhost": ("unsupported_scheme", "", "", ""),
    "http://": ("missing_hostname", "", "", ""),
    "http:/a.com": ("missing_hostname", "", "", ""),
    "http://a..b/": ("missing_hostname", "", "", ""),
    f"http://{LONG}.com/": ("missing_hostname", "", "", ""),
    "http://n/a": ("invalid_hostname", "", "", ""),
    "http://a_b.com/": ("invalid_hostname", "", "", ""),
    "http://a.com:70000/": ("invalid_url", "", "", ""),
    "http://a.com:x1/": ("invalid_url", "", "", ""),
    "http://[::1/": ("invalid_url_parse", "", "", ""),
    "http://a[::1]/": ("invalid_url_parse", "", "", ""),
    "http://[1.2.3.4]/": ("invalid_url_parse", "", "", ""),
    "http://a／b.com/": ("invalid_url_parse", "", "", ""),
    "http://1.2.3.4/x": ("", "1.2.3.4", "/x", "http://1.2.3.4/x"),
    "http://01.2.3.4/x": ("", "01.2.3.4", "/x", "http://01.2.3.4/x"),
    "http://[2001:DB8::1]:8080/": ("", "2001:db8::1", "/", "http://2001:db8::1:8080/"),
    "http://[::1]/": ("", "::1", "/", "http://::1/"),
    "HTTP://EX.com:80": ("", "ex.com", "/", "http://ex.com/"),
    "https://ex.com.:443/": ("", "ex.com", "/", "https://ex.com/"),
    "http://a.com:0/": ("", "a.com", "/", "http://a.com/"),
    "http://a.com:/": ("", "a.com", "/", "http://a.com/"),
    "https://a.com:8443?x=%zz": ("", "a.com", "/", "https://a.com:8443/?x=%25zz"),
    "http://u:p@a.com/": ("", "a.com", "/", "http://a.com/"),
    "http://u@v@a.com/": ("", "a.com", "/", "http://a.com/"),
    "http://a.com/p;v=1?b=2&a=1&&c&utm_source=z#f": ("", "a.com", "/p", "http://a.com/p?a=1&b=2&c="),
    "http://a.com/x;y/z;w?q": ("", "a.com", "/x;y/z", "http://a.com/x;y/z?q="),
    "https://a.com/?=v&x": ("", "a.com", "/", "https://a.com/?=v&x="),
    "http://a.com/a|b?q=a|b~*": ("", "a.com", "/a|b", "http://a.com/a|b?q=a%7Cb~%2A"),
    "http://a.com/?REF=1&Q=%C3%A9+x": ("", "a.com", "/", "http://a.com/?Q=%C3%A9+x"),
    "http://a.com//b/../c": ("", "a.com", "//b/../c", "http://a.com//b/../c"),
    "ht\ttp://a.com/\nx": ("", "a.com", "/x", "http://a.com/x"),
    "http://bücher.de/é?é=1": ("", "xn--bcher-kva.de", "/é", "http://xn--bcher-kva.de/é?%C3%A9=1"),
    "http://XN--bcher-kva.de/": ("", "xn--bcher-kva.de", "/", "http://xn--bcher-kva.de/"),
    "http://a.com/?b=%FF&a=1": ("", "a.com", "/", "http://a.com/?a=1&b=%EF%BF%BD"),
}

DOMAINS = {
    "Example.COM.": ("", "example.com"),
    "localhost": ("invalid_hostname", ""),
    "a b.com": ("invalid_domain", ""),
    "..": ("invalid_domain", ""),
    "-a.com": ("invalid_hostname", ""),
    "::1": ("", "::1"),
    "1.2.3.4": ("", "1.2.3.4"),
    "http://a.com": ("invalid_hostname", ""),
    ".".join(["a" * 60] * 5): ("invalid_hostname", ""),
    None: ("empty_value", ""),
}

PARTS = {
    # host: (subdomain, domain, suffix, registered domain)
    "a.b.co.uk": ("a", "b", "co.uk", "b.co.uk"),
    "x.vercel.app": ("x", "vercel", "app", "vercel.app"),
    "www.school.edu.vn": ("www", "school", "edu.vn", "school.edu.vn"),
    "a.b.unknowntld": ("a.b", "unknowntld", "", "unknowntld"),
    "co.uk": ("", "", "co.uk", "co.uk"),
    "foo.kawasaki.jp": ("", "", "foo.kawasaki.jp", "foo.kawasaki.jp"),
    "x.foo.kawasaki.jp": ("", "x", "foo.kawasaki.jp", "x.foo.kawasaki.jp"),
    "a.city.kawasaki.jp": ("a", "city", "kawasaki.jp", "city.kawasaki.jp"),
    "kawasaki.jp": ("", "kawasaki", "jp", "kawasaki.jp"),
    "www.ck": ("", "www", "ck", "www.ck"),
    "x.xn--55qx5d.cn": ("", "x", "xn--55qx5d.cn", "x.xn--55qx5d.cn"),
    "1.2.3.4": ("", "1.2.3.4", "", "1.2.3.4"),
    "": ("", "", "", ""),
}


def parse(spark, values, kind):
    df = spark.createDataFrame([(v, kind) for v in values], "original_value string, record_type string")
    return {r["original_value"]: r for r in parse_records(df).collect()}


def test_url_rows(spark):
    got = parse(spark, URLS, "url")
    for value, (reason, host, path, canonical) in URLS.items():
        r = got[value]
        assert (r.invalid_reason, r.hostname, r.path, r.canonical_url) == (reason, host, path, canonical), value
        assert r.parse_ok == (reason == "") and r.canonical_hostname == host


def test_domain_rows(spark):
    got = parse(spark, DOMAINS, "domain")
    for value, (reason, host) in DOMAINS.items():
        assert (got[value].invalid_reason, got[value].hostname) == (reason, host), value
        assert got[value].canonical_url == "" and got[value].path == ""


def test_unknown_type(spark):
    assert parse(spark, ["a.com"], "mail")["a.com"].invalid_reason == "unknown_record_type"


def test_host_parts(spark):
    df = spark.createDataFrame([(h,) for h in PARTS], "host string")
    for r in host_parts(df, "host").collect():
        assert (r.subdomain, r.domain, r.suffix, r.registered_domain) == PARTS[r.host], r.host


def test_private_rules_on_request(spark):
    rules = SuffixRules(spark, parse_rules(["com", "// x", "===END ICANN DOMAINS===", "blog.com"], True))
    row = host_parts(spark.createDataFrame([("a.b.blog.com",)], "host string"), "host", rules).first()
    assert (row.suffix, row.registered_domain) == ("blog.com", "b.blog.com")


def test_ip_literals(spark):
    texts = [
        "1.2.3.4", "256.1.1.1", "1.2.3", "01.2.3.4", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
        "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "fe80::1%eth0",
        "12345::", "g::1", "1:2:3:4:5:6:7", "1::2:3:4:5:6:7:8", "::1.2.3", "a.b.c.1", "1:2:3:4:5::1.2.3.4",
    ]

    def known(t):
        try:
            ipaddress.ip_address(t)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hosts.is_ip("t").alias("ip"))
    assert {r.t: r.ip for r in df.collect()} == {t: known(t) for t in texts}


def expected_query(raw):
    pairs = [(k, v) for k, v in parse_qsl(raw, keep_blank_values=True) if k.lower() not in V.TRACKING_PARAMS]
    return "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(pairs))


words = st.text(alphabet="abAB019.-_~*+%&=;/?@:|é 漢", max_size=24)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(words, min_size=40, max_size=80))
def test_random_queries_match_urllib(spark, texts):
    urls = list(dict.fromkeys("http://a.com/p?" + t.replace("#", "") for t in texts))
    got = parse(spark, urls, "url")
    for u in urls:
        raw = urlsplit(u.strip()).query
        want = expected_query(raw)
        assert got[u].query == raw
        assert got[u].canonical_url == "http://a.com/p" + ("?" + want if want else ""), u
    again = {r.canonical_url for r in parse(spark, [r.canonical_url for r in got.values()], "url").values()}
    assert again == {r.canonical_url for r in got.values()}


@pytest.mark.parametrize("base", ["http://a.com", "http://a.com/", "http://a.com/b/c?x=1#f", "https://a.com/b/c/"])
def test_references_match_urllib(spark, base):
    refs = [
        "", "x", "/x/y", "//b.com/z", "?q=1", "#frag", "../x", "../../x", "./x", "x/./y/../z", "..", ".", "http://c.com/q",
        "mailto:a@b.c", "x?y=/../z", "x#/../z", "/a/../../b", "a;b/c",
    ]
    df = spark.createDataFrame([(r,) for r in refs], "r string")
    got = {r.r: r.u for r in df.select("r", resolve_reference(F.lit(base), F.col("r")).alias("u")).collect()}
    assert got == {r: urljoin(base, r) for r in refs}


def test_rules_are_broadcast_without_arrow(spark):
    from hostlens.operators.parse import host_parts
    from hostlens.sources.suffix_rules import SuffixRules

    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rules = SuffixRules(spark, {"com": 1, "uk": 1, "co.uk": 1})
    finally:
        spark.conf.set(key, before)
    out = host_parts(spark.createDataFrame([("a.b.com",), ("x.co.uk",)], "host string"), "host", rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == rules.depth and "SortMergeJoin" not in plan  # hosts of one tail stay where they are
    assert sorted(r["registered_domain"] for r in out.collect()) == ["b.com", "x.co.uk"]
