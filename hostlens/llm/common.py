"""Helpers that several operators share: row keys, prefix sums over blocks, components, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlens.session import Stages, discard, materialize

__all__ = ["Stages", "batches", "blocks_for", "discard", "keyed", "materialize", "offsets", "table", "utf8"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def keyed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The named columns under a key of each row, ``row``.

    Rows are told apart by it, not by their id, so that repeated rows and null ids stay whole.
    The key is settled only once the result is written: materialize before it is used twice.
    """
    return df.select(F.monotonically_increasing_id().alias("row"), *columns)


def offsets(totals: DataFrame, keys: list[str], order: str, amount: str) -> DataFrame:
    """``before``: for each block the sum of ``amount`` of the blocks before it.

    ``totals`` has one row per (keys, order), so its size follows the number of blocks, not of rows.
    """
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(amount).over(window), F.lit(0)).cast("long")
    return totals.select(*keys, order, before.alias("before"))


def blocks_for(rows: int, size: int) -> int:
    """A power of two, so that about ``size`` rows fall in each block."""
    return 1 << max(0, (rows // size).bit_length())


def batches(source: Iterator[pa.RecordBatch], limit: int, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most ``limit`` bytes in ``column`` (one row at least)."""
    for batch in source:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            size = int(size) if size == size else 0  # a null length is nan
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if len(sizes) > start:
            yield batch.slice(start)


def utf8(column: str) -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.encode(F.col(column), "UTF-8"), F.lit(b""))
