"""Keep-first and keep-last per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """First row per key in a full order.

    `row_number() = 1` becomes a group limit that also runs before the shuffle, so repeats of a
    hot key never leave their map task: at most one row per key and map task is exchanged.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def last_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Last record per key, listed at the position where the key first came up.

    One partial-then-final aggregate gives both the winning row and the first position.
    """
    rest = [c for c in df.columns if c not in (key, seq)]
    agg = df.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.col(seq)).alias("__row"), F.min(seq).alias(seq)
    )
    return agg.select(key, *[F.col(f"__row.{c}").alias(c) for c in rest], seq)
