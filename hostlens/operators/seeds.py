"""Validation seeds from a feed, and the benign addon picked from official sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hostlens import fixed_values as V
from hostlens.functions import rules
from hostlens.operators.dedup import keep_first, last_wins
from hostlens.operators.joins import lookup_join, measured
from hostlens.schemas import ADDON_ROW, align

#: Seeds whose counts are summed in one task.
SEEDS_PER_RANGE = 1024

# --- phishing seed ----------------------------------------------------------


def seed_candidates(parsed: DataFrame, position: list) -> DataFrame:
    """First URL per host in feed order, with category and priority.

    Equal URLs have equal hosts, so first per host covers first per URL.
    """
    rows = parsed.where("parse_ok and canonical_url <> ''")
    firsts = keep_first(rows, [F.col("canonical_hostname")], position)
    named = firsts.select(
        F.col("canonical_url").alias("url"),
        F.col("canonical_hostname").alias("hostname"),
        rules.category("canonical_url").alias("category"),
    )
    return named.withColumn("priority", rules.priority("category"))


def round_robin(candidates: DataFrame, max_total: int = 15, max_per_category: int = 4) -> DataFrame:
    """Best of each category in turn until `max_total`, at most `max_per_category` of one.

    Taking turns equals ordering by (rank inside the category, turn of the category).  The rank
    filter becomes a group limit before the shuffle: a category of any size sends only its
    candidates for the first few ranks.
    """
    w = W.partitionBy("category").orderBy(*rules.candidate_order("url", "hostname", "category"))
    ranked = candidates.withColumn("rank_in_category", F.row_number().over(w)).where(
        F.col("rank_in_category") <= max_per_category
    )
    turn = rules.category_turn("category")
    picked = ranked.orderBy("rank_in_category", turn).limit(max_total)
    order = W.partitionBy(F.lit(0)).orderBy("rank_in_category", turn)  # max_total rows only
    return picked.withColumn("index", F.row_number().over(order))


def seed_rows(selected: DataFrame, snapshot: str) -> DataFrame:
    """One domain row (P001…) and one URL row (U001…) per selected pair."""
    number = F.format_string("%03d", F.col("index"))

    def row(letter: str, kind: str, value: str, note: str):
        return F.struct(
            F.concat(F.lit(letter), number).alias("sample_id"),
            F.col("category"),
            F.lit(kind).alias("dataset_kind"),
            F.col(value).alias("input_value"),
            F.lit("phishing").alias("expected_label"),
            F.col("priority"),
            F.lit(note).alias("note"),
        )

    both = F.array(
        row("P", "domain", "hostname", V.SEED_NOTES["domain"].format(snapshot)),
        row("U", "url", "url", V.SEED_NOTES["url"].format(snapshot)),
    )
    return selected.select(F.inline(both))


# --- benign addon -----------------------------------------------------------


def internal_pages(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pages whose registered domain is the seed's, first discovery per seed and URL.

    `found`: parsed rows with seed_id, discovery_method, position.
    `seeds`: seed columns plus registered_domain and seed_order.
    """
    pages = found.where("parse_ok and canonical_url <> ''").select(
        "seed_id", "discovery_method", "position", "canonical_url", "canonical_hostname", "registered_domain"
    )
    mine = lookup_join(pages, seeds, ["seed_id", "registered_domain"])
    return keep_first(mine, [F.col("seed_id"), F.col("canonical_url")], [F.col("position")])


def pick_urls(pages: DataFrame, k: int = V.SITE_MAX_URLS) -> DataFrame:
    """Best k portal-like pages per seed (group limit before the shuffle)."""
    w = W.partitionBy("seed_id").orderBy(
        *rules.portal_order("canonical_url", "canonical_hostname"), F.col("canonical_url")
    )
    return pages.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pick_hosts(pages: DataFrame, picked: DataFrame, k: int = V.SITE_MAX_URLS) -> DataFrame:
    """Hosts of the picked pages; with fewer hosts than pages, the next best fill up to k."""
    hosts = keep_first(pages, [F.col("seed_id"), F.col("canonical_hostname")], [F.col("position")])
    chosen = picked.groupBy("seed_id", "canonical_hostname").agg(F.lit(True).alias("chosen"))
    sizes = picked.groupBy("seed_id").agg(
        F.count("*").alias("n_urls"), F.countDistinct("canonical_hostname").alias("n_hosts")
    )
    as_url = F.concat(F.lit("https://"), F.col("canonical_hostname"), F.lit("/"))
    best = [*rules.portal_order(as_url, "canonical_hostname"), F.col("canonical_hostname")]
    marked = hosts.join(chosen, ["seed_id", "canonical_hostname"], "left").withColumn(
        "chosen", F.coalesce("chosen", F.lit(False))
    )
    # At most k chosen hosts come first, so a rank limit of k covers the chosen ones and the fill.
    w = W.partitionBy("seed_id").orderBy(F.col("chosen").desc(), *best)
    ranked = marked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    room = F.when(F.col("n_hosts") < F.col("n_urls"), F.lit(k)).otherwise(F.col("n_hosts"))
    return lookup_join(ranked, sizes, "seed_id").where(F.col("rank") <= room).drop("n_urls", "n_hosts")


def addon_table(picked: DataFrame, seeds: DataFrame, kind: str, prefix: str) -> DataFrame:
    """Addon rows with ids: last seed wins a shared value, at the place it first came up.

    Ids number the rows in (seed, rank) order.  They are a per-seed offset plus a place inside the
    seed, so no task numbers the whole table; a seed holds at most a few rows.
    """
    value = "canonical_url" if kind == "url" else "canonical_hostname"
    seq = F.struct("seed_order", "rank")
    rows = picked.select(
        F.col(value).alias("input_value"), seq.alias("seq"), "category", "source_name", "seed_id",
        F.col("homepage_url").alias("seed_homepage_url"), F.lit(kind).alias("dataset_kind"),
        F.lit("benign").alias("expected_label"), "discovery_method",
        F.col("canonical_hostname").alias("hostname"), "registered_domain", "note",
    )
    kept = last_wins(rows, "input_value", "seq").withColumn("seed_order", F.col("seq.seed_order"))
    per_seed = kept.groupBy("seed_order").agg(F.count("*").alias("n"))
    per_seed = per_seed.withColumn("range", F.floor(F.col("seed_order") / SEEDS_PER_RANGE))
    # Only the sums of ranges pass one task.
    earlier = W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = per_seed.groupBy("range").agg(F.sum("n").alias("total"))
    ranges = ranges.select("range", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    before = W.partitionBy("range").orderBy("seed_order").rowsBetween(W.unboundedPreceding, -1)
    within = per_seed.select("range", "seed_order", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("inside"))
    offsets = lookup_join(within, ranges, "range").select("seed_order", (F.col("start") + F.col("inside")).alias("offset"))
    place = F.row_number().over(W.partitionBy("seed_order").orderBy("seq"))
    numbered = lookup_join(kept, offsets, "seed_order").withColumn(
        "sample_id", F.concat(F.lit(prefix), F.format_string("%04d", F.col("offset") + place))
    )
    return align(numbered, ADDON_ROW).orderBy("category", "source_name", "input_value")


def seed_rollup(seeds: DataFrame, urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per seed: how many URLs and hosts were picked; a seed without any keeps its row."""
    counts = (
        urls.select("seed_id", F.lit(1).alias("u"), F.lit(0).alias("d"))
        .unionByName(hosts.select("seed_id", F.lit(0).alias("u"), F.lit(1).alias("d")))
        .groupBy("seed_id")
        .agg(F.sum("u").alias("selected_url_count"), F.sum("d").alias("selected_domain_count"))
    )
    out = seeds.join(counts, "seed_id", "left")
    return out.select(
        "seed_id", "source_name", "category", "registered_domain",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("selected_url_count", "selected_domain_count")],
    )


def ordered_seeds(seeds: DataFrame, parsed_homepages: DataFrame) -> DataFrame:
    """Seed columns with the registered domain of the homepage and a stable order."""
    domains = parsed_homepages.select("seed_id", "registered_domain")
    table, _ = measured(seeds.join(domains, "seed_id"))
    return table.withColumn("seed_order", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("seed_id")))
