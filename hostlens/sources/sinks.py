"""Stage, split, metric and event writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.operators.counters import observed


def write_stage(
    df: DataFrame, path: str, partition_by: str | None = "collected_at", order: tuple[str, ...] = (), counters: dict[str, Column] | None = None
) -> dict[str, int]:
    """Parquet overwrite, with rows in `order` within each file; returns the counters observed on the way.

    With a partition column the rows are rebalanced on it first: AQE then merges small partitions
    and splits a day that holds much of the data, giving few, even files instead of one per task
    and day.
    """
    even = df if partition_by is None else df.hint("rebalance", partition_by)
    keys = [*([partition_by] if partition_by else []), *order]
    even = even.sortWithinPartitions(*keys) if order else even
    # Counted behind the shuffle, in the tasks that write: one that is run again counts once.
    even, watch = observed(even, counters) if counters else (even, None)
    # Static overwrite: the whole stage is replaced, also days that are gone.
    writer = even.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return watch.get if watch else {}


def write_splits(df: DataFrame, path: str) -> None:
    """train / val / test in one pass, one folder each."""
    write_stage(df, path, "split")


def write_stats(df: DataFrame, path: str) -> None:
    """A small aggregate table as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    """Seed, addon, metric and summary tables as CSV with a header."""
    flat = df.select(
        *[
            F.array_join(f.name, " | ").alias(f.name) if f.dataType.typeName() == "array"
            else F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    flat.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def append_events(df: DataFrame, path: str) -> None:
    """Events as JSON lines, appended; each task commits its own file."""
    df.write.mode("append").json(path)
