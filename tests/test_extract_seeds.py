import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.operators import extract, seeds
from hostlens.operators.parse import parse_records


def test_links(spark):
    html = """<!-- <a href="/no">x</a> --><script>var s='<a href="/no2">';</script>
    <A class="x" HREF='/one?a=1&amp;b=2'>1</A><a title="a > b href=/no3" href=two.html>2</a><a name=x>none</a>
    <a\nhref = "//c.com/3"\n>3</a><abbr href="/no4">z</abbr><a href="">e</a><a href=" ../up ">5</a>"""
    df = spark.createDataFrame([("http://h.com/d/p", html)], "url string, html string")
    rows = extract.extract_links(df).orderBy("position").collect()
    assert [r.href for r in rows] == ["/one?a=1&b=2", "two.html", "//c.com/3", " ../up "]
    assert [r.link for r in rows] == ["http://h.com/one?a=1&b=2", "http://h.com/d/two.html", "http://c.com/3", "http://h.com/up"]


def test_robots(spark):
    text = "User-agent: *\r\nSITEMAP: https://a.com/s.xml?x=1:2 \nDisallow: /sitemap:\nno colon\nsitemap:\n Sitemap : /rel.xml"
    rows = extract.robots_sitemaps(spark.createDataFrame([("s", text)], "site string, body string")).orderBy("position").collect()
    assert [r.sitemap_url for r in rows] == ["https://a.com/s.xml?x=1:2", "/rel.xml"]


def test_root_sitemaps(spark):
    sites = spark.createDataFrame([("a", "https://a.com/x"), ("b", "https://b.com")], "site string, home string")
    robots = spark.createDataFrame([("a", 3, "https://a.com/sitemap.xml"), ("a", 5, "https://a.com/sitemap.xml")], "site string, position int, sitemap_url string")
    only = extract.root_sitemaps(sites, robots, "site", "home", False, V.NEWS_SITEMAP_PATHS)
    got = defaultdict(list)
    for r in only.orderBy("position").collect():
        got[r.site].append(r.sitemap_url)
    assert got["a"] == ["https://a.com/sitemap.xml"] and got["b"] == ["https://b.com" + p for p in V.NEWS_SITEMAP_PATHS]
    always = extract.root_sitemaps(sites, robots, "site", "home", True, V.SITE_SITEMAP_PATHS, below=False).where("site = 'a'")
    assert [r.sitemap_url for r in always.orderBy("position").collect()] == ["https://a.com" + p for p in V.SITE_SITEMAP_PATHS]


def sitemap(*locs, tag="url", root="urlset", date="2026-04-05"):
    body = "".join(f"<{tag}><loc>{u}</loc><lastmod>{date}</lastmod></{tag}>" for u in locs)
    return f'<?xml version="1.0"?><{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{body}</{root}>'


def test_sitemap_entries(spark):
    news = (
        "﻿junk <urlset xmlns:n='http://x/news' xmlns='http://y'><url><loc> http://a.com/?a=1&b=2 </loc><n:news><n:publication_date>2026-04-05T01:02:03Z"
        "</n:publication_date><n:title>T &amp; U</n:title></n:news></url><url><lastmod>2026-01-01</lastmod></url></urlset>"
    )
    docs = {"news": news, "index": sitemap("http://a.com/s1.xml", tag="sitemap", root="sitemapindex"), "rss": "<rss><url><loc>x</loc></url></rss>", "broken": "<urlset><url><loc>x</url>", "empty": "", "text": "hello"}
    df = spark.createDataFrame(list(docs.items()), "doc string, body string")
    rows = extract.sitemap_entries(df).orderBy("doc", "position").collect()
    assert [(r.doc, r.doc_type, r["loc"], r.lastmod, r.publication_date, r.title) for r in rows] == [
        ("index", "index", "http://a.com/s1.xml", "2026-04-05", "", ""),
        ("news", "urlset", "http://a.com/?a=1&b=2", "", "2026-04-05T01:02:03Z", "T & U"),
        ("news", "urlset", "", "2026-01-01", "", ""),
    ]


def plain_entries(body):
    """The reading rule in plain words: the first descendant of that local name that has text before any child."""
    import xml.etree.ElementTree as ET

    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def first(entry, name):
        return next((e.text.strip() for e in entry.iter() if local(e) == name and e.text), "")

    body = body.lstrip("\ufeff")
    try:
        root = ET.fromstring(re.sub(V.BARE_AMPERSAND, "&amp;", body[body.find("<"):] if "<" in body else body))
    except ET.ParseError:
        return []
    kind = {"sitemapindex": ("index", "sitemap"), "urlset": ("urlset", "url")}.get(local(root))
    if kind is None:
        return []
    dated = ("publication_date", "title") if kind[0] == "urlset" else ()
    return [
        (kind[0], i, first(e, "loc"), first(e, "lastmod"), *[first(e, n) if n in dated else "" for n in ("publication_date", "title")])
        for i, e in enumerate(x for x in root if local(x) == kind[1])
    ]


def test_fields_are_found_among_all_descendants(spark):
    rnd = random.Random(11)
    texts = ["http://a.com/?x=1&amp;y=&lt;2", " padded ", "", " ", "<![CDATA[A <b> & <loc>no</loc>]]>", "one<![CDATA[ & two]]>", "&#60;i&#62; &#x3C;", "é & bare", "t<!-- note -->ail", "a > b"]
    names = ["loc", "n:loc", "lastmod", "title", "n:title", "publication_date", "n:publication_date", "n:news", "wrap", "url", "locs", "titles"]

    def element(depth):
        name = rnd.choice(names)
        inner = rnd.choice(texts)
        if depth and rnd.random() < 0.6:
            inner += "".join(element(depth - 1) for _ in range(rnd.randint(1, 3))) + rnd.choice(texts)
        mark = rnd.choice(["", " k='v'", ' n:k="1 2"'])
        return f"<{name}{mark}>{inner}</{name}>" if inner or rnd.random() < 0.5 else f"<{name}{mark}/>"

    docs = []
    for i in range(150):
        root, tag = rnd.choice([("urlset", "url"), ("n:urlset", "n:url"), ("sitemapindex", "sitemap"), ("feed", "url")])
        entries = "".join(f"<{rnd.choice([tag, tag, 'other'])}>" + "".join(element(3) for _ in range(rnd.randint(0, 4))) + "</%s>" for _ in range(rnd.randint(0, 4)))
        parts = re.split(r"(<(?:%s|other)>)" % tag, entries)
        body, name = "", None
        for p in parts:
            if re.fullmatch(r"<(?:%s|other)>" % tag, p):
                name = p[1:-1]
            body += p.replace("%s", name or "")
        text = f"{rnd.choice(['', chr(0xFEFF), 'junk '])}<?xml version='1.0'?><{root} xmlns='http://s' xmlns:n='http://n'>{body}</{root if rnd.random() < 0.9 else 'x'}>"
        docs.append((i, text))
    rows = extract.sitemap_entries(spark.createDataFrame(docs, "doc int, body string")).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc, r.position)):
        got[r.doc].append((r.doc_type, r.position, r["loc"], r.lastmod, r.publication_date, r.title))
    want = {i: plain_entries(b) for i, b in docs}
    assert {i: e for i, e in want.items() if e} == dict(got)
    assert sum(len(e) for e in got.values()) > 100 and sum(bool(e[2]) for x in got.values() for e in x) > 40


def test_default_sitemaps_keep_the_base_path(spark):
    from urllib.parse import urljoin

    homes = ["https://a.com", "https://a.com/", "https://a.com/en/news//", "https://a.com/x/index.html", "https://a.com:8080/p?q=1", "http://a.com/p/q#frag/"]
    df = spark.createDataFrame([(h,) for h in homes], "home string")
    got = defaultdict(list)
    for r in extract.default_sitemaps(df, "home").orderBy("position").collect():
        got[r.home].append(r.sitemap_url)
    assert got == {h: [urljoin(h.rstrip("/") + "/", p.lstrip("/")) for p in V.NEWS_SITEMAP_PATHS] for h in homes}
    roots = extract.default_sitemaps(df, "home", V.SITE_SITEMAP_PATHS, below=False)
    assert {(r.home, r.sitemap_url) for r in roots.collect()} == {(h, urljoin(h, p)) for h in homes for p in V.SITE_SITEMAP_PATHS}


def test_expansion_and_news_rows(spark):
    docs = {
        "https://npr.org/root.xml": sitemap("https://npr.org/news1.xml", "https://npr.org/old.xml", "https://npr.org/post.xml", "https://npr.org/root.xml", tag="sitemap", root="sitemapindex"),
        "https://npr.org/news1.xml": sitemap("https://npr.org/n/1", "https://www.npr.org/n/2", "https://other.org/n/3", "https://npr.org/", "https://npr.org/login", "https://npr.org/a.PDF"),
        "https://npr.org/post.xml": sitemap("https://npr.org/n/1", "https://npr.org/n/4"),
        "https://npr.org/old.xml": sitemap("https://npr.org/n/5", date="2020-01-01"),
    }
    table = spark.createDataFrame(list(docs.items()), "doc_url string, body string")
    roots = spark.createDataFrame([("npr", "https://npr.org/root.xml", 0)], "publisher string, sitemap_url string, position int")
    maps = extract.expand_sitemaps(roots, table, "publisher", "2026-04-06")
    order = [r.sitemap_url.rsplit("/", 1)[1] for r in maps.orderBy("read_order").collect()]
    assert order == ["root.xml", "news1.xml", "post.xml", "old.xml"]
    assert extract.expand_sitemaps(roots, table, "publisher", "2026-04-06", max_sitemaps=2).count() == 2
    press = spark.createDataFrame([("npr", "https://www.npr.org")], "publisher string, publisher_base_url string")
    rows = extract.news_rows(maps, table, press, "2026-04-06").orderBy("url").collect()
    assert [r.url for r in rows] == ["https://npr.org/n/1", "https://npr.org/n/4", "https://www.npr.org/n/2"]
    assert rows[0].sitemap_url.endswith("news1.xml") and rows[0].collected_at == "2026-04-05"
    assert extract.news_rows(maps, table, press, "2026-04-06", max_urls=1).count() == 1


def loop_round_robin(cands, total, per_category):
    def key(c):
        low = c["url"].lower()
        hits = sum(t in low for g in V.CATEGORY_TOKENS.values() for t in g)
        return (-hits, -(sum(low.count(x) for x in "?=&") + len(c["hostname"].split("."))), low)

    groups = defaultdict(list)
    for c in sorted(cands, key=key):
        groups[c["category"]].append(c)
    picked, taken = [], defaultdict(int)
    while len(picked) < total:
        before = len(picked)
        for name in V.CATEGORY_TURN:
            if groups[name] and taken[name] < per_category and len(picked) < total:
                picked.append(groups[name].pop(0)["hostname"])
                taken[name] += 1
        if len(picked) == before:
            break
    return picked


def test_round_robin_equals_the_turn_taking_loop(spark):
    rnd = random.Random(3)
    bits = ["paypal", "wallet", "dhl", "mail", "roblox", "plain", "bank-pdf"]
    lines = [(i, f"http://{rnd.choice(bits)}{rnd.randint(1, 25)}.com/{rnd.choice(bits)}?x={i}") for i in range(120)] + [(999, "nonsense")]
    df = spark.createDataFrame(lines, "position int, v string").withColumn("record_type", F.lit("url"))
    found = seeds.seed_candidates(parse_records(df, "v"), [F.col("position")])
    cands = [r.asDict() for r in found.collect()]
    first = {}
    for i, u in lines[:-1]:
        first.setdefault(u.split("/")[2], u)
    assert {c["hostname"]: c["url"] for c in cands} == first
    for total, per in ((15, 4), (7, 1), (500, 9)):
        got = [r.hostname for r in seeds.round_robin(found, total, per).orderBy("index").collect()]
        assert got == loop_round_robin(cands, total, per)
    rows = seeds.seed_rows(seeds.round_robin(found, 3, 1), "s.txt").orderBy("sample_id").collect()
    assert [r.sample_id for r in rows] == ["P001", "P002", "P003", "U001", "U002", "U003"]
    assert rows[0].note == "Hostname extracted from OpenPhish snapshot s.txt."


def test_addon_selection(spark):
    sites = spark.createDataFrame(
        [("S1", "uni", "One", "https://www.one.vn/", ""), ("S2", "uni", "Two", "https://two.vn/", ""), ("S3", "bank", "Three", "https://three.vn/", "")],
        "seed_id string, category string, source_name string, homepage_url string, note string",
    )
    homes = parse_records(sites.withColumn("record_type", F.lit("url")), "homepage_url")
    table = seeds.ordered_seeds(sites, homes)
    links = [
        ("S1", "https://sso.one.vn/login"), ("S1", "https://www.one.vn/a"), ("S1", "https://www.one.vn/portal"), ("S1", "https://x.one.vn/z"),
        ("S1", "https://elsewhere.vn/"), ("S2", "https://two.vn/mail"), ("S2", "https://two.vn/mail?utm_source=1"), ("S1", "https://two.vn/no"),
    ]
    df = spark.createDataFrame([(s, u, i, "homepage", "url") for i, (s, u) in enumerate(links)], "seed_id string, link string, position int, discovery_method string, record_type string")
    pages = seeds.internal_pages(parse_records(df, "link"), table)
    assert pages.count() == 5
    urls = seeds.pick_urls(pages, 2)
    assert [r.canonical_url for r in urls.where("seed_id = 'S1'").orderBy("rank").collect()] == ["https://sso.one.vn/login", "https://www.one.vn/portal"]
    hosts = seeds.pick_hosts(pages, urls, 2)
    assert [r.canonical_hostname for r in hosts.where("seed_id = 'S1'").orderBy("rank").collect()] == ["sso.one.vn", "www.one.vn"]
    out = seeds.addon_table(urls, table, "url", "VU").collect()
    assert [(r.sample_id, r.input_value) for r in out] == [("VU0001", "https://sso.one.vn/login"), ("VU0002", "https://www.one.vn/portal"), ("VU0003", "https://two.vn/mail")]
    roll = {r.seed_id: (r.selected_url_count, r.selected_domain_count) for r in seeds.seed_rollup(table, urls, hosts).collect()}
    assert roll == {"S1": (2, 2), "S2": (1, 1), "S3": (0, 0)}


def test_addon_ids_over_ranges_of_seeds(spark, monkeypatch):
    monkeypatch.setattr(seeds, "SEEDS_PER_RANGE", 4)
    rows = [(o, k, f"https://s{o}.vn/{k}", f"S{o:02d}") for o in range(1, 26) if o % 6 for k in range(1, 2 + o % 3)]
    df = spark.createDataFrame(rows, "seed_order int, rank int, canonical_url string, seed_id string").repartition(3)
    rest = ("category", "source_name", "homepage_url", "discovery_method", "canonical_hostname", "registered_domain", "note")
    out = seeds.addon_table(df.select("*", *[F.lit("x").alias(c) for c in rest]), df, "url", "VU")
    assert {(r.sample_id, r.input_value) for r in out.collect()} == {(f"VU{i:04d}", url) for i, (_, _, url, _) in enumerate(rows, 1)}


def test_hosts_fill_up(spark):
    pages = spark.createDataFrame(
        [("S", f"https://a.one.vn/login{i}", "a.one.vn", i) for i in range(3)] + [("S", "https://b.one.vn/", "b.one.vn", 7), ("S", "https://c.one.vn/", "c.one.vn", 8)],
        "seed_id string, canonical_url string, canonical_hostname string, position int",
    )
    hosts = seeds.pick_hosts(pages, seeds.pick_urls(pages, 3), 3)
    assert [r.canonical_hostname for r in hosts.orderBy("rank").collect()] == ["a.one.vn", "b.one.vn", "c.one.vn"]


def test_index_chain_of_depth_20(spark):
    docs = [(f"https://a.com/{i}.xml", sitemap(f"https://a.com/{i + 1}.xml", f"https://a.com/{i}.xml", tag="sitemap", root="sitemapindex")) for i in range(20)]
    docs.append(("https://a.com/20.xml", sitemap("https://a.com/page")))
    table = spark.createDataFrame(docs, "doc_url string, body string")
    roots = spark.createDataFrame([("a", "https://a.com/0.xml", 0)], "site string, sitemap_url string, position int")
    maps = extract.expand_sitemaps(roots, table, "site", "2026-04-06").orderBy("read_order").collect()
    assert [r.sitemap_url for r in maps] == [f"https://a.com/{i}.xml" for i in range(21)]


def test_long_tags_do_not_overflow(spark):
    pages = ["<a " + "x" * 1_000_000, "<a href='/1'>" + "<a " + "k='v' " * 100_000 + "href=/2>", "<a title=\"" + ">" * 500_000 + "\" href='/&eacute;&#47;&#x2F;&amp;lt;'>"]
    rows = spark.createDataFrame([(i, "https://a.com/", p) for i, p in enumerate(pages)], "id int, url string, html string")
    got = {(r.id, r.href) for r in extract.extract_links(rows).collect()}
    assert got == {(1, "/1"), (1, "/2"), (2, "/é//&lt;")}
    prolog = '<?xml version="1.0"?>' + "\n" * 100_000 + "<!-- c -->" * 1000 + "<urlset><url><loc>https://a.com/x</loc></url></urlset>"
    docs = spark.createDataFrame([("d", prolog)], "doc string, body string")
    assert [r.loc for r in extract.sitemap_entries(docs).collect()] == ["https://a.com/x"]


def test_broken_zip_archives_are_refused(spark, tmp_path):
    from hostlens.sources import feeds

    folder = tmp_path / "raw" / "tranco"
    folder.mkdir(parents=True)
    (folder / "tranco_2026-04-01.csv.zip").write_bytes(b"PK")
    with pytest.raises(Exception, match="csv.zip is no zip archive"):
        feeds.scan_feed(spark, str(tmp_path / "raw"), "tranco").count()


def test_news_pages_need_no_valid_labels_or_port(spark):
    press = spark.createDataFrame([("npr", "https://www.npr.org")], "publisher string, publisher_base_url string")
    kept = ["https://a_b.npr.org/n/1", "https://npr.org:99999/n/2", "https://npr.org/n/3?x=1"]
    pages = spark.createDataFrame([(u,) for u in [*kept, "https://npr.org/", "https://other.org/n/4", "ftp://npr.org/n/5", "https:///n/6"]], "url string")
    got = extract.allowed_news(pages, "url", press).collect()
    assert sorted(r.url for r in got) == sorted(kept) and {(r.publisher, r.registered_domain) for r in got} == {("npr", "npr.org")}


def test_links_take_one_pass_over_the_attributes_of_a_tag(spark):
    from hostlens.operators import extract

    assert len(extract._ATTRIBUTE) and not extract._HIDDEN.startswith("(?is)<!--")
    html = "<A class=x HREF \n=\t '/a=b' data-href='/no'><a href==c><!-- <a href=n> --><a title=\"href='/no'\" href=\"/d\"><SCRIPT><a href=/s></script ><style>x</STYLE><a href=''><a href='/e\""
    row = spark.createDataFrame([(html,)], "html string")
    links = extract.page_links(F.col("html"))
    assert row.select(links.alias("l")).first()["l"] == ["/a=b", "=c", "/d"]
    assert str(links._jc.toString()).count("regexp_extract_all") == 2  # the tags, and each tag's attributes once
