"""Views of the given tables in the shapes the operators take (Spark side)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.functions.rules import risk_level
from hostlens.operators import corpus, extract
from hostlens.operators.parse import parse_records
from hostlens.schemas import NORMALIZED, align
from hostlens.session import is_folder, materialize, spread

SPAM_HOSTS = "spam-farm|cheap-pills|casino-win|free-bets|adult-x|ads-track"
HOST_IN_URL = "://([^/?#]+)"


class Tables:
    """Lazy views over one table folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        return spread(self.raw(name))

    def stream(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        reader = self.spark.readStream.schema(self.raw(name).schema)
        if is_folder(self.spark, path):
            return reader.parquet(path)
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)  # a stream reads folders only

    @cached_property
    def pages(self) -> DataFrame:
        return labelled_pages(self.spread("pages"))

    @cached_property
    def hosts(self) -> DataFrame:
        host = F.regexp_extract("url", HOST_IN_URL, 1).alias("host")
        return self.raw("pages").groupBy(host).agg(F.min("page_id").alias("first_page"))

    @cached_property
    def links(self) -> DataFrame:
        return extract.extract_links(self.pages)

    @cached_property
    def records(self) -> DataFrame:
        """Normalized rows: page URLs, ranked hosts, resolved links, raw hrefs (mostly invalid)."""
        links = self.links.select(
            "label", F.col("day").alias("collected_at"), F.col("page_id").cast("string").alias("source_record_id"),
            F.col("position").alias("source_rank"), F.lit("").alias("source_target"),
            F.explode(
                F.array(
                    F.struct(F.col("link").alias("original_value"), F.lit("links").alias("source"), F.lit("url").alias("record_type")),
                    F.struct(
                        F.col("href").alias("original_value"), F.lit("raw").alias("source"),
                        F.when(F.col("position") % 2 == 0, "url").otherwise("domain").alias("record_type"),
                    ),
                )
            ).alias("r"),
        ).select("*", "r.*")
        links = links.withColumn("label", F.when(F.col("source") == "raw", 0).otherwise(F.col("label")))
        parts = [page_records(self.pages), host_records(self.hosts), links]
        out = [align(p, NORMALIZED) for p in parts]
        return out[0].unionByName(out[1]).unionByName(out[2])

    @cached_property
    def parsed(self) -> DataFrame:
        return corpus.parse_normalized(self.records)

    @cached_property
    def parsed_stage(self) -> DataFrame:
        """The parsed stage as written, as the batch flow uses it: parsed once, read by every branch."""
        return materialize(self.parsed, "parsed")

    @cached_property
    def clean(self) -> DataFrame:
        return corpus.clean(self.parsed_stage)

    @cached_property
    def addon(self) -> DataFrame:
        early = F.when(F.col("first_page") % 2 == 0, "2023-12-31")
        return self.hosts.select(
            F.col("host").alias("input_value"), F.lit(None).cast("string").alias("source"), early.alias("collected_at")
        )

    @cached_property
    def requests(self) -> DataFrame:
        return event_requests(self.spread("events"))

    @cached_property
    def parsed_requests(self) -> DataFrame:
        from hostlens.functions.rules import detect_kind

        typed = self.requests.withColumn("record_type", detect_kind("value"))
        return parse_records(typed, "value")

    @cached_property
    def labelled(self) -> DataFrame:
        """Dated labels from events; `rare` leaves some days without a positive."""
        return self.raw("events").select(
            "event_id",
            (F.col("event_type") == "error").cast("int").alias("label"),
            ((F.col("event_type") == "error") & (F.col("value") > 224)).cast("int").alias("rare"),
            F.col("event_type").alias("source"),
            F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("collected_at"),
        )

    @cached_property
    def log(self) -> DataFrame:
        return event_log(self.raw("events"))

    @cached_property
    def scored(self) -> DataFrame:
        """Validation-like rows from documents with quality labels."""
        rows = self.raw("documents").join(self.raw("labels"), "doc_id")
        score = F.round(F.col("n_chars") / 20000.0, 6)
        guess = F.when(F.col("n_chars") % 23 == 0, -1).when(score >= 0.02, 1).otherwise(0)
        return rows.select(
            F.col("doc_id").cast("string").alias("sample_id"),
            F.col("lang").alias("dataset_kind"), F.col("source").alias("category"),
            F.when(F.col("toxic") == 1, "critical").when(F.col("n_chars") > 400, "high").alias("priority"),
            F.when(F.col("quality") == 1, "phishing").otherwise("benign").alias("expected_label"),
            guess.alias("predicted_label"), score.alias("score"),
            F.when(guess == -1, "unreadable").otherwise("").alias("error"),
            F.col("quality").alias("label"),
            F.greatest(guess, F.lit(0)).alias("prediction"),
        )


def labelled_pages(pages: DataFrame) -> DataFrame:
    spam = F.col("url").rlike(f"://[^/]*({SPAM_HOSTS})")
    return pages.select(
        "page_id", "url", "html",
        F.when(spam | (F.col("page_id") % 97 == 5), 1).otherwise(0).alias("label"),
        F.concat(F.lit("feed"), F.col("page_id") % 4).alias("source"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int")), "yyyy-MM-dd").alias("day"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("url").alias("original_value"), "label", "source", F.col("day").alias("collected_at"),
        F.lit("url").alias("record_type"), F.col("page_id").cast("string").alias("source_record_id"),
        F.lit(None).cast("long").alias("source_rank"), F.lit("").alias("source_target"),
    )


def host_records(hosts: DataFrame) -> DataFrame:
    return hosts.select(
        F.col("host").alias("original_value"), F.lit(0).alias("label"), F.lit("ranked").alias("source"),
        F.lit("2024-01-15").alias("collected_at"), F.lit("domain").alias("record_type"),
        F.lit("").alias("source_record_id"), F.col("first_page").alias("source_rank"), F.lit("").alias("source_target"),
    )


def event_requests(events: DataFrame) -> DataFrame:
    """Values to score, one per event: shops, look-alikes, hosts, addresses, unusable hosts."""
    u, e = F.col("user_id").cast("string"), F.col("event_id").cast("string")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    value = (
        F.when(
            F.col("event_type") == "purchase",
            text("http://user", u, "-paypal-login.xyz/pay/confirm;s=1?session=", e, "&b=", u, "&a=x y&ref=mail#top"),
        )
        .when(F.col("event_type") == "signup", text("Secure-User", u, ".Example.co.uk."))
        .when(F.col("event_type") == "click", text("https://shop", u, ".example.com:443/a/b//c?x=", e, "&utm_source=z"))
        .when(F.col("event_type") == "view", text("10.", (F.col("user_id") % 256).cast("string"), ".0.", (F.col("event_id") % 256).cast("string")))
        .otherwise(text("http://node", u, "/x?q=1"))
    )
    return events.select("event_id", value.alias("value"))


def event_log(events: DataFrame) -> DataFrame:
    score = F.round(F.least(F.col("value") / 100.0, F.lit(1.0)), 6)
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("received_at"),
        F.when(F.col("event_type").isin("signup", "view"), "domain").otherwise("url").alias("dataset_kind"),
        (score >= 0.6).cast("int").alias("predicted_label"),
        score.alias("score"),
        risk_level(score).alias("risk_level"),
    )
