"""Structured Streaming flows: snapshots, first sightings, scoring, running summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostlens.functions.dates import date_from_file_name
from hostlens.operators.counters import observed
from hostlens.operators.dedup import keep_first
from hostlens.operators.parse import parse_records, split_valid
from hostlens.operators.reports import event_summary
from hostlens.operators.scoring import as_events, as_rejects, judge_requests
from hostlens.session import Stages, materialize
from hostlens.sources.feeds import shape_url_lines
from hostlens.streaming.master import Master


def stream_snapshots(spark: SparkSession, folder: str, files_per_batch: int = 100, pattern: str = "*.txt") -> DataFrame:
    """Feed snapshots as they land, in the normalized schema; the day comes from the file name."""
    lines = (
        spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern).format("text").load(folder)
    )
    named = lines.select("*", date_from_file_name(F.col("_metadata.file_name")).alias("__day"))
    return shape_url_lines(named.where(F.col("__day").isNotNull()), "value", F.col("__day"))


def new_within(parsed_stream: DataFrame, event_time: str, delay: str = "2 days") -> DataFrame:
    """First sighting of each canonical URL, state bounded by the watermark."""
    return (
        split_valid(parsed_stream).where("canonical_url <> ''")
        .withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["canonical_url"])
    )


def _finish(writer, checkpoint: str, once: bool, name: str) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def write_new_urls(normalized: DataFrame, master: str, checkpoint: str, once: bool = True, buckets: int = 64, merge_at: int = 8) -> StreamingQuery:
    """Append URLs never seen before to the master table (`master_urls` reads it): exact over all time.

    A batch is parsed once, and reads the keys of the buckets it touches; a repeated batch adds nothing twice.
    """
    table = Master(normalized.sparkSession, master, "canonical_url", buckets, merge_at)

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = split_valid(parse_records(batch)).where("canonical_url <> ''")
        order = [F.col(c) for c in ("collected_at", "source", "original_value", "source_record_id")]
        table.add(keep_first(rows, [F.col("canonical_url")], order), batch_id)

    return _finish(normalized.writeStream.foreachBatch(add), checkpoint, once, "new_urls")


def master_urls(spark: SparkSession, master: str) -> DataFrame:
    """The master table of `write_new_urls` as of its last batch."""
    return Master(spark, master, "canonical_url").scan()


def score_counters() -> dict[str, Column]:
    is_event = F.col("reject_reason") == ""
    return {
        "requests": F.count("*"), "events": F.count_if(is_event), "rejects": F.count_if(~is_event),
        "phishing": F.count_if(is_event & (F.col("predicted_label") == 1)), "high_risk": F.count_if(is_event & (F.col("risk_level") == "high")),
    }


def write_scores(
    requests: DataFrame, scorers: dict, events: str, checkpoint: str, rejects: str, once: bool = True, counts: str | None = None
) -> StreamingQuery:
    """Score requests as they come: events as JSON lines, and requests that give none with their reason.

    A batch is scored once and written, and both outputs read that; a repeated batch replaces its own folders.  With `counts` each
    batch leaves a row of counters there, observed while it was written.
    """
    spark = requests.sparkSession

    def both(batch: DataFrame, batch_id: int) -> None:
        with Stages():
            watched, watch = observed(judge_requests(batch, scorers), score_counters())
            judged = materialize(watched, "scored")
            as_events(judged).write.mode("overwrite").json(f"{events}/batch_id={batch_id}")
            as_rejects(judged).write.mode("overwrite").json(f"{rejects}/batch_id={batch_id}")
            if counts:
                row = spark.createDataFrame([tuple(watch.get.values())], ", ".join(f"{c} long" for c in watch.get))
                row.coalesce(1).write.mode("overwrite").json(f"{counts}/batch_id={batch_id}")

    return _finish(requests.writeStream.foreachBatch(both), checkpoint, once, "scores")


def write_summary(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Running counters of the event log: one state row, the latest result replaces the file."""

    def replace(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)  # one row

    return _finish(event_summary(events).writeStream.outputMode("complete").foreachBatch(replace), checkpoint, once, "summary")
