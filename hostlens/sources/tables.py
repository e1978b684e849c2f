"""Readers of seeds, addons, event logs and stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hostlens.schemas import EVENT, SITE_SEED, VALIDATION_SEED, require_columns
from hostlens.session import file_names, path_exists
from hostlens.sources import archives


def scan_stage(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A written stage; with its schema, folder names such as days keep their type."""
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    # Fields in quotes may hold line breaks; every value is read as text, nothing is inferred.
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def scan_validation_seed(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    return require_columns(df, [f.name for f in VALIDATION_SEED.fields[:-1]], "real-world validation seed")


def scan_site_seeds(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    return require_columns(df, [f.name for f in SITE_SEED.fields], "seed file").select(*[f.name for f in SITE_SEED.fields])


def scan_addon_dir(spark: SparkSession, folder: str) -> DataFrame:
    """Every CSV of the folder, columns taken by name; files without `input_value` give no rows.

    The headers of all files are one job over their first lines, and files of one header are one read: the plan
    grows with the number of different headers, not of files.
    """
    wanted = ["input_value", "source", "collected_at"]
    out = spark.createDataFrame([], ", ".join(f"{c} string" for c in wanted))
    files = sorted(r["path"] for r in file_names(spark, folder, "*.csv").collect()) if path_exists(spark, folder) else []
    for names, members in archives.headers(spark, files).items() if files else ():
        own = archives.unique_names(names)
        if "input_value" not in own:
            continue
        schema = StructType([StructField(n, StringType()) for n in own])
        df = spark.read.schema(schema).csv([p for p, _ in members], header=True, multiLine=True, escape='"', enforceSchema=True)
        out = out.unionByName(df.select(*[(F.col(c) if c in own else F.lit(None)).cast("string").alias(c) for c in wanted]))
    return out


def scan_event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in the event schema; blank and undecodable lines are skipped."""
    rows = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.coalesce("event_id", "received_at", "raw_value").isNotNull())
