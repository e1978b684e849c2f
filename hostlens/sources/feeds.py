"""Raw feed readers and their shape in the normalized schema.

Readers only open landed files; the `shape_*` functions are plain projections that work on any
table of the same columns, batch or streaming.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens import fixed_values as V
from hostlens.functions.dates import date_from_file_name
from hostlens.functions.text import clean_text
from hostlens.operators.corpus import iso_day
from hostlens.schemas import NEWS_ROW, NORMALIZED, PHISH_ENTRY, align
from hostlens.session import file_names, path_exists, spread
from hostlens.sources import archives


def _shape(df: DataFrame, **columns: Column) -> DataFrame:
    defaults = {"source_record_id": F.lit(""), "source_target": F.lit(""), "source_rank": F.lit(None)}
    return align(df.select(*[c.alias(n) for n, c in {**defaults, **columns}.items()]), NORMALIZED)


def shape_url_lines(df: DataFrame, value: str, day: Column, source: str = "openphish") -> DataFrame:
    """One URL per line; blank lines stay and are counted as empty by the parser."""
    return _shape(
        df, original_value=F.col(value), label=F.lit(1), source=F.lit(source), collected_at=day,
        record_type=F.lit("url"),
    )


def shape_phish_entries(df: DataFrame, day: Column, source: str = "phishtank") -> DataFrame:
    return _shape(
        df, original_value=F.coalesce("url", F.lit("")), label=F.lit(1), source=F.lit(source), collected_at=day,
        record_type=F.lit("url"), source_record_id=F.coalesce("phish_id", F.lit("")),
        source_target=F.coalesce("target", F.lit("")),
    )


def shape_news(df: DataFrame, day: Column, source: str = "news_sitemaps") -> DataFrame:
    own_day = F.nullif(clean_text("collected_at"), F.lit(""))
    return _shape(
        df, original_value=F.coalesce("url", F.lit("")), label=F.lit(0), source=F.lit(source),
        collected_at=F.coalesce(own_day, day), record_type=F.lit("url"),
        source_record_id=F.coalesce("sitemap_url", F.lit("")), source_target=F.coalesce("publisher", F.lit("")),
    )


def shape_ranked_domains(df: DataFrame, day: Column, top_n: int | None, source: str = "tranco") -> DataFrame:
    """Ranked benign hosts; the first N by rank is a predicate on the rank, not a row limit."""
    kept = df if top_n is None else df.where(F.col("source_rank") <= top_n)
    return _shape(
        kept, original_value=F.col("original_value"), label=F.lit(0), source=F.lit(source), collected_at=day,
        record_type=F.lit("domain"), source_rank=F.col("source_rank"),
    )


def shape_text_labels(df: DataFrame, url: str, label: str, day: Column, source: str = "mendeley_phishing_url") -> DataFrame:
    """Labels written as text; rows with another label or no URL are dropped."""
    text = F.lower(clean_text(label))
    number = F.when(text == "phishing", 1).when(text == "legitimate", 0)
    return _labelled(df, url, number, day, source)


def shape_number_labels(df: DataFrame, url: str, label: str, day: Column, source: str = "mendeley_legitphish") -> DataFrame:
    """Labels written as numbers with the reverse meaning (0 = phishing, 1 = legitimate)."""
    raw = F.col(label).cast("string").try_cast("double")
    number = F.when(raw == 0.0, 1).when(raw == 1.0, 0)
    return _labelled(df, url, number, day, source)


def _labelled(df: DataFrame, url: str, number: Column, day: Column, source: str) -> DataFrame:
    shaped = _shape(
        df, original_value=F.col(url), label=number, source=F.lit(source), collected_at=day,
        record_type=F.lit("url"), source_target=F.lit(V.FEEDS[source][4] if source in V.FEEDS else ""),
    )
    return shaped.dropna(subset=["original_value", "label"])


# --- readers ----------------------------------------------------------------


def landed(spark: SparkSession, raw_dir: str, source: str, start: str | None = None, end: str | None = None) -> list[str]:
    """Paths of a source's landed files whose name has a day of the window, undated ones left out.

    Files are chosen by their names alone: those of other days are never opened, however many have piled up.
    """
    day = F.regexp_extract(F.element_at(F.split("path", "/"), -1), V.DATE_IN_FILE_NAME, 1)
    wanted = (day != "") & (day >= F.lit(start or "")) & (day <= F.lit(end or "9999-99-99"))
    folders = [f"{raw_dir.rstrip('/')}/{f}" for f in (source, *V.EXTRA_FEED_DIRS.get(source, ()))]
    found = [file_names(spark, f, f"{source}_*").where(wanted) for f in folders if path_exists(spark, f)]
    return sorted(r["path"] for r in reduce(DataFrame.unionAll, found).collect()) if found else []  # names of the window's files


def scan_feed(
    spark: SparkSession,
    raw_dir: str,
    source: str,
    start: str | None = None,
    end: str | None = None,
    top_n: int | None = None,
) -> DataFrame | None:
    """All landed files of one source in the normalized schema, zip archives included; None when there are none.

    `top_n` keeps the first ranks of a ranked list (`V.DEFAULT_TOP_N` is the published corpus'); None keeps all.
    """
    paths = landed(spark, raw_dir, source, start, end)
    if not paths:
        return None
    zipped = [p for p in paths if archives.is_zip(p)]
    plain = [p for p in paths if not archives.is_zip(p)]
    fixed = V.FEEDS[source][2]
    day = F.lit(fixed) if fixed else date_from_file_name(F.col("__file"))
    archived_name = F.element_at(F.split("path", "/"), -1).alias("__file")

    def rows(read, unzip=None) -> DataFrame:
        """One compressed, archived or multi-line file is one split; it is spread before any parsing."""
        parts = [spread(read(plain).select("*", F.col("_metadata.file_name").alias("__file")))] if plain else []
        if zipped:
            if unzip is None:
                raise ValueError(f"{source} has no lines to read from archives: {', '.join(zipped)}")
            parts.append(spread(unzip(zipped).select("*", archived_name).drop("path", "member")))
        # Plain files bring more columns, which the shapes do not read.
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    if source == "openphish":
        lines = rows(spark.read.text, lambda files: archives.lines(spark, files).drop("line"))
        return shape_url_lines(lines, "value", day, source)
    if source == "phishtank":
        return shape_phish_entries(rows(lambda files: spark.read.schema(PHISH_ENTRY).json(files, multiLine=True)), day, source)
    if source == "news_sitemaps":
        return shape_news(rows(lambda files: spark.read.schema(NEWS_ROW).json(files, multiLine=True)), day, source)
    if source == "tranco":
        ranked = "source_rank long, original_value string"
        table = rows(spark.read.schema(ranked).csv, lambda files: archives.csv_rows(spark, files, ranked))
        return shape_ranked_domains(table, day, top_n, source)
    shapes = {"mendeley_phishing_url": (shape_text_labels, "url", "type"), "mendeley_legitphish": (shape_number_labels, "URL", "ClassLabel")}
    if source not in shapes:
        raise ValueError(f"unknown source: {source}")
    shape, url, label = shapes[source]
    # Only the two columns used are read; the csv scan skips the others.
    table = rows(spark.read.option("header", True).csv, lambda files: archives.csv_rows(spark, files, columns=(url, label)))
    return shape(table, url, label, day, source)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    merged = reduce(DataFrame.unionByName, frames)
    return align(merged.withColumn("collected_at", iso_day("collected_at")), NORMALIZED)


def normalize(
    spark: SparkSession,
    raw_dir: str,
    sources=V.DEFAULT_FEEDS,
    allow_opt_in: tuple[str, ...] = (),
    start: str | None = None,
    end: str | None = None,
    top_n: int | None = None,
) -> DataFrame:
    """Union of the chosen sources; opt-in sources are refused unless allowed by name."""
    wanted = list(dict.fromkeys(sources))
    unknown = [s for s in wanted if s not in V.FEEDS]
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    refused = [s for s in wanted if V.FEEDS[s][3] and s not in allow_opt_in]
    if refused:
        raise PermissionError(f"sources need an explicit opt-in: {', '.join(refused)}")
    frames = [scan_feed(spark, raw_dir, s, start, end, top_n) for s in wanted]
    frames = [f for f in frames if f is not None]
    if not frames:
        raise FileNotFoundError("no landed files for the chosen sources and dates")
    return union_sources(frames)


def with_feed_position(df: DataFrame) -> DataFrame:
    """Feed order of text lines: file, block inside the file, line inside the block."""
    return df.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("position"),
    )


def latest_snapshot(spark: SparkSession, folder: str, pattern: str = "openphish_*.txt") -> DataFrame:
    """Lines of the newest snapshot by modification time, with feed position.

    The newest file is found on the file listing, so the other snapshots are never opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    newest = files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no snapshots in {folder}")
    lines = with_feed_position(spark.read.text(newest))
    return lines.select("value", "position", F.element_at(F.split("position.file", "/"), -1).alias("snapshot"))
