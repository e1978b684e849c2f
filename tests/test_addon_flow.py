"""Curated sites to addon tables."""

from hostlens.plans.addon import build_addon
from hostlens.schemas import ADDON_ROW
from hostlens.sources import tables


def xml(root, tag, *locs):
    return f"<{root}>" + "".join(f"<{tag}><a><loc>{u}</loc></a></{tag}>" for u in locs) + f"</{root}>"


def test_whole_flow(spark, tmp_path):
    sites = spark.createDataFrame(
        [
            ("S1", "uni", "One", "https://www.one.vn/", "n1"), ("S2", "bank", "Two", "https://two.vn/start", "n2"), ("S3", "bank", "Three", "https://three.vn/", ""),
            ("S4", "x", "Bad", "nothing", ""),
        ],
        "seed_id string, category string, source_name string, homepage_url string, note string",
    )
    docs = {
        "https://www.one.vn/": '<a href="/a">a</a><a href="https://sso.one.vn/login">l</a><a href="https://two.vn/x">other</a><a href="mailto:x@one.vn">m</a>',
        "https://www.one.vn/robots.txt": "Sitemap: https://www.one.vn/index.xml\nSitemap: https://www.one.vn/missing.xml",
        "https://www.one.vn/index.xml": xml("sitemapindex", "sitemap", "https://www.one.vn/deep.xml", "https://www.one.vn/index.xml"),
        "https://www.one.vn/deep.xml": xml("urlset", "url", "https://www.one.vn/portal", "https://www.one.vn/a", "https://elsewhere.vn/"),
        "https://two.vn/sitemap.xml": xml("urlset", "url", "https://two.vn/mail", "https://m.two.vn/", "https://two.vn/z?utm_source=q"),
        "https://three.vn/sitemap.xml": "<urlset><url><loc>https://three.vn/never</loc></url>",
    }
    documents = spark.createDataFrame(list(docs.items()), "doc_url string, body string")
    found = build_addon(spark, sites, documents, str(tmp_path), "2024-01-27", k=2)
    urls = found["urls"].orderBy("sample_id").collect()
    assert [(r.sample_id, r.input_value, r.discovery_method) for r in urls] == [
        ("VU0001", "https://sso.one.vn/login", "homepage"), ("VU0002", "https://www.one.vn/portal", "sitemap"), ("VU0003", "https://two.vn/mail", "sitemap"),
        ("VU0004", "https://m.two.vn/", "sitemap"),
    ]
    assert found["urls"].columns == [f.name for f in ADDON_ROW.fields] and urls[0].note == "n1" and urls[0].hostname == "sso.one.vn"
    assert {r.input_value for r in found["domains"].collect()} == {"sso.one.vn", "www.one.vn", "two.vn", "m.two.vn"}
    summary = {r.seed_id: (r.selected_url_count, r.selected_domain_count, r.status) for r in found["summary"].collect()}
    assert summary == {"S1": (2, 2, ""), "S2": (2, 2, ""), "S3": (0, 0, ""), "S4": (0, 0, "invalid_seed_domain")}
    assert {(r.table, r.category, r.rows) for r in found["categories"].collect()} == {("urls", "uni", 2), ("urls", "bank", 2), ("domains", "uni", 2), ("domains", "bank", 2)}
    assert tables.scan_addon_dir(spark, f"{tmp_path}/domains").count() == 4
    empty = build_addon(spark, sites, documents.limit(0), str(tmp_path / "none"), "2024-01-27")
    assert empty["urls"].count() == 0 and empty["summary"].count() == 4
