"""Stage counters that come with the write of a stage: it is never read again for them.

They are observed in the task that writes, so a task that is run again counts once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hostlens.operators.parse import INVALID_REASONS


def observed(df: DataFrame, counters: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The frame with counters attached; ``get`` gives them once it was written."""
    watch = Observation()
    return df.observe(watch, *[c.alias(n) for n, c in counters.items()]), watch


def per_value(column: str, values: Iterable[str]) -> dict[str, Column]:
    """Rows of each of the known values of a column."""
    return {f"{column}={v}": F.count_if(F.col(column) == v) for v in values}


def of_parsed() -> dict[str, Column]:
    return {"input_rows": F.count("*"), "invalid_rows_removed": F.count_if(~F.col("parse_ok")), **per_value("invalid_reason", INVALID_REASONS)}


def of_hosts() -> dict[str, Column]:
    """Rows that the overlap test drops, from the table of hosts (``corpus.host_conflicts``)."""
    return {"overlap_rows_removed": F.sum(F.when(F.col("marked"), F.col("benign")).otherwise(F.lit(0)))}


def of_labels() -> dict[str, Column]:
    return {"benign": F.count_if(F.col("label") == 0), "phishing": F.count_if(F.col("label") == 1)}


def of_clean() -> dict[str, Column]:
    kinds = {f"{k}_rows": F.count_if(F.col("record_type") == k) for k in ("domain", "url")}
    return {"output_rows": F.count("*"), **{f"{n}_rows": c for n, c in of_labels().items()}, **kinds}


CLEAN_STATS = (
    "input_rows", "invalid_rows_removed", "overlap_rows_removed", "deduplicated_rows_removed", "output_rows", "benign_rows", "phishing_rows",
    "domain_rows", "url_rows",
)


def clean_stats(spark: SparkSession, parsed: dict[str, int], hosts: dict[str, int], clean: dict[str, int]) -> DataFrame:
    """The one row of ``corpus.clean_stats`` from what was observed."""
    found = {**parsed, **clean, "overlap_rows_removed": hosts["overlap_rows_removed"] or 0}
    valid = found["input_rows"] - found["invalid_rows_removed"]
    found["deduplicated_rows_removed"] = valid - found["overlap_rows_removed"] - found["output_rows"]
    return spark.createDataFrame([tuple(found[c] for c in CLEAN_STATS)], ", ".join(f"{c} long" for c in CLEAN_STATS))


def as_rows(spark: SparkSession, found: dict[str, int], column: str) -> DataFrame:
    """``column, rows`` of the values met."""
    rows = [(n.split("=", 1)[1], k) for n, k in found.items() if n.startswith(f"{column}=") and k]
    return spark.createDataFrame(rows, f"{column} string, rows long")
