"""Join helpers whose physical strategy is safe at any size and under skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LOOKUP_ROWS = 100_000
HOT_KEY_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
SPREAD = 4096


def measured(small: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> tuple[DataFrame, bool]:
    """Run a summary table once and say whether it is small enough to broadcast.

    Reads at most `max_rows + 1` rows.  When it fits, the measured rows come back as a local
    relation (the job behind them is not run again); otherwise the table is returned as it was.
    """
    rows = small.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return small, False
    return small.sparkSession.createDataFrame(rows, schema=small.schema), True


def settled(df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    """Fix computed columns as the output of a one-row generator.

    A filter or join on such a column would otherwise be rewritten in terms of the raw input:
    the whole computation is repeated in the filter, and planning time grows with every step.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*names))))


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a summary table: adaptive execution broadcasts it by its bytes, or shuffles and splits skew."""
    return big.join(small, on, how)


def drop_marked(
    left: DataFrame,
    key: str,
    stats: DataFrame,
    spread_by: Column,
    hot_rows: int = HOT_KEY_ROWS,
    only: Column | None = None,
) -> DataFrame:
    """Anti join of `left` with the keys marked in `stats(key, n, marked)`, whatever the skew.

    The few keys with most rows are settled by a broadcast of at most MAX_HOT_KEYS rows; their
    rows then get a probe that matches nothing and spreads over all tasks.  Every other key goes
    through an ordinary shuffled anti join, so the result is exact for any number of keys.
    Rows outside `only` are kept unseen, and spread the same way.
    """
    hot = (
        stats.where(F.col("n") >= hot_rows)
        .orderBy(F.col("n").desc(), F.col(key))
        .limit(MAX_HOT_KEYS)
        .select(F.col(key), F.col("marked").alias("__hot_marked"), F.lit(True).alias("__hot"))
    )
    # `n` is named here as well so that both uses of the aggregate share one shuffle.
    cold = stats.where(F.col("marked") & (F.col("n") > 0)).select(F.col(key).alias("__probe"))
    asked = F.lit(True) if only is None else only
    bypass = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("string"))
    probe = F.when(~asked | F.coalesce(F.col("__hot"), F.lit(False)), bypass).otherwise(F.col(key))
    return (
        left.join(F.broadcast(hot), key, "left")
        .where(~(asked & F.coalesce(F.col("__hot_marked"), F.lit(False))))
        .withColumn("__probe", probe)
        .join(cold, "__probe", "left_anti")
        .select(*left.columns)
    )
