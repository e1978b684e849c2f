"""Benign addon rows from fetched documents of curated sites: links, robots files, sitemaps, picks, ids, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.operators import extract, seeds
from hostlens.operators.parse import parse_records
from hostlens.session import Stages, materialize
from hostlens.sources import sinks
from hostlens.sources.suffix_rules import SuffixRules


def discovered(sites: DataFrame, documents: DataFrame, today: str, max_sitemaps: int | None = None) -> DataFrame:
    """`seed_id, link, discovery_method, position` of every link that a site's homepage and sitemaps name.

    `sites`: seed_id, homepage_url.  `documents`: doc_url, body.  Sitemaps are those of the robots file and the fixed addresses at the
    root of the host, and then what their indexes name, level by level.  The homepage comes before the sitemaps, these in reading order.
    """
    homes = sites.select("seed_id", "homepage_url")
    pages = homes.join(documents.withColumnRenamed("doc_url", "homepage_url"), "homepage_url")
    from_home = extract.extract_links(pages, "homepage_url", "body").select(
        "seed_id", "link", F.lit("homepage").alias("discovery_method"), F.struct(F.lit(0).alias("source"), F.lit(0).alias("map"), F.col("position").alias("place")).alias("position")
    )
    robots_url = extract.resolve_reference(F.col("homepage_url"), F.lit("/robots.txt"))
    robots = homes.withColumn("doc_url", robots_url).join(documents, "doc_url").select("seed_id", "body")
    roots = extract.root_sitemaps(homes, extract.robots_sitemaps(robots), "seed_id", "homepage_url", True, V.SITE_SITEMAP_PATHS, below=False)
    maps = extract.expand_sitemaps(roots, documents, "seed_id", today, max_sitemaps=max_sitemaps)
    read = maps.join(documents.withColumnRenamed("doc_url", "sitemap_url"), "sitemap_url").select("seed_id", "read_order", "body")
    entries = extract.sitemap_entries(read).where("doc_type = 'urlset' and loc <> ''")
    from_maps = entries.select(
        "seed_id", F.col("loc").alias("link"), F.lit("sitemap").alias("discovery_method"),
        F.struct(F.lit(1).alias("source"), F.col("read_order").alias("map"), F.col("position").alias("place")).alias("position"),
    )
    return from_home.unionByName(from_maps)


def addon(
    spark: SparkSession, sites: DataFrame, documents: DataFrame, today: str, k: int = V.SITE_MAX_URLS, max_sitemaps: int | None = None, rules: SuffixRules | None = None
) -> dict[str, DataFrame]:
    """`urls` and `domains` with their ids, `summary` per seed, `categories` of both tables.

    `sites` are site seeds (`schemas.SITE_SEED`); one whose homepage has no usable domain has no rows, and counts of 0 in the summary.
    """
    with Stages() as own:
        homes = parse_records(sites.withColumn("record_type", F.lit("url")), "homepage_url", rules=rules)
        table = seeds.ordered_seeds(sites, homes.where("parse_ok and registered_domain <> ''"))
        found = discovered(sites, documents, today, max_sitemaps).withColumn("record_type", F.lit("url"))
        pages = materialize(seeds.internal_pages(parse_records(found, "link", rules=rules), table), "addon-pages")
        picked = materialize(seeds.pick_urls(pages, k), "addon-urls")
        hosts = materialize(seeds.pick_hosts(pages, picked, k), "addon-hosts")
        known = sites.join(table.select("seed_id", "registered_domain"), "seed_id", "left").withColumn("registered_domain", F.coalesce("registered_domain", F.lit("")))
        status = F.when(F.col("registered_domain") == "", "invalid_seed_domain").otherwise("")
        out = {
            "urls": own.result(seeds.addon_table(picked, table, "url", "VU"), "addon"),
            "domains": own.result(seeds.addon_table(hosts, table, "domain", "VD"), "addon"),
            "summary": own.result(seeds.seed_rollup(known, picked, hosts).withColumn("status", status), "addon"),
        }
    counts = out["urls"].select("category", F.lit("urls").alias("table")).unionByName(out["domains"].select("category", F.lit("domains").alias("table")))
    out["categories"] = counts.groupBy("table", "category").agg(F.count("*").alias("rows"))
    return out


def build_addon(spark: SparkSession, sites: DataFrame, documents: DataFrame, out: str, today: str, **limits) -> dict[str, DataFrame]:
    """The addon tables as CSV folders below `out`; `tables.scan_addon_dir` reads that of the domains."""
    result = addon(spark, sites, documents, today, **limits)
    for name, df in result.items():
        sinks.write_table_csv(df.orderBy("category", "source_name", "input_value") if name in ("urls", "domains") else df, f"{out}/{name}")
    return result
