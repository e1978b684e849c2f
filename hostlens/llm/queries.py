"""Registered queries of the operators; SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hostlens.llm import bpe, codebooks, crf_quality, html_text, jaccard_join, kneser_ney, license_scan, orchard, packing, quality_rules, suffix_dedup, topk, warc
from hostlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op7_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op7_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op9_risk_controlled_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


_RULES = [(rule, i, c) for rule, grid in quality_rules.GRID.items() for i, c in enumerate(grid)]
ORACLES["op9_risk_controlled_rules"] = f"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
), g AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS times FROM g),
r AS (SELECT doc_id, sum(step) AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM h WHERE times > 1) GROUP BY 1),
c AS (
  SELECT t.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share, coalesce(word_chars / nullif(n_words, 0), 0) AS word_length FROM c
), m AS (SELECT f.*, y.good FROM f JOIN (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1) y USING (doc_id) WHERE NOT base_failed),
x AS ({" UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {i} AS step, CAST({c} AS DOUBLE) AS cutoff, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND {r} > {c}) AS k, count(*) FILTER (good = 0 AND {r} > {c}) AS caught FROM m GROUP BY 1" for r, i, c in _RULES)}),
p AS (
  SELECT *, CASE WHEN k >= n * {quality_rules.RISK / len(quality_rules.GRID)} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({quality_rules.RISK / len(quality_rules.GRID)}) + (n - j) * ln(1 - {quality_rules.RISK / len(quality_rules.GRID)})))) END AS p FROM x
), s AS (SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY step) AS worst FROM p),
o AS (
  SELECT stratum, rule, cutoff FROM s WHERE worst <= {quality_rules.ERROR} / ((SELECT count(DISTINCT stratum) FROM m) * {len(quality_rules.GRID)})
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - k DESC, step) = 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(f"coalesce({r} > (SELECT cutoff FROM o WHERE o.stratum = f.stratum AND o.rule = '{r}'), false)" for r in quality_rules.GRID)}) AS kept
FROM f
"""


@query
def op10_crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = crf_quality.score(docs, crf_quality.train(docs, table(spark, folder, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    predicted = (F.col("score") >= crf_quality.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query
def op2_multi_order_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar(table(spark, folder, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id", "n_links")


@query
def op5_merged_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = suffix_dedup.strip(table(spark, folder, "documents"), words=True)
    return left.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated_words")


@query
def op3_chunked_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.round_trip(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole")


@query
def op4_line_block_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query
def op6_fuzzy_notices(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, folder, "documents")))


@query
def op11_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    found = kneser_ney.evaluate(table(spark, folder, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op12_orchard_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return orchard.cluster(table(spark, folder, "embeddings"))


def _floor_mean(total: str, n: str) -> str:
    """Exact floor(total / n) of whole numbers."""
    return f"(({total}) - ((({total}) % {n}) + {n}) % {n}) // {n}"


def _clusters_sql(k: int, rounds: int) -> str:
    """One relation per round: distances of all pairs, the nearest centroid, the means."""
    parts = [
        f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), m0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM v QUALIFY cluster < {k}
)"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""d{i} AS MATERIALIZED (
  SELECT r, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) AS distance FROM v, m{i}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1
)"""
        )
        if i < rounds:
            parts.append(
                f"""s{i} AS (SELECT cluster, j, sum(v[j]) AS t, count(*) AS n FROM d{i}, range(1, 65) AS g(j) GROUP BY 1, 2),
m{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(any_value(a.c), any_value(m{i}.c)) AS c FROM m{i} LEFT JOIN (
    SELECT cluster, list({_floor_mean('t', 'n')} ORDER BY j) AS c FROM s{i} GROUP BY 1
  ) a USING (cluster) GROUP BY 1
)"""
            )
    last = rounds
    return ",\n".join(parts) + f"""
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m{last}.c, ',')) AS centroid_sha256 FROM d{last} JOIN m{last} USING (cluster)"""


ORACLES["op12_orchard_clusters"] = _clusters_sql(8, 10)


@query
def op13_resident_codebooks(spark: SparkSession, folder: str) -> DataFrame:
    return codebooks.compress(table(spark, folder, "embeddings"))


def _codes_sql(positions: int, entries: int, rounds: int) -> str:
    """One relation per round: distances of all parts and entries, the nearest entry, the means."""
    parts = [
        f"""WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT r, vec_id, p, v[1 + p * (len(v) // {positions}):(p + 1) * (len(v) // {positions})] AS x FROM v, range(0, {positions}) AS g(p)
), b0 AS MATERIALIZED (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS e, x AS c FROM x QUALIFY e < {entries}
)"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""d{i} AS MATERIALIZED (
  SELECT r, p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS HUGEINT) AS distance FROM x JOIN b{i} USING (p)
  QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY distance, e) = 1
)"""
        )
        if i < rounds:
            parts.append(
                f"""s{i} AS (SELECT p, e, j, sum(x[j]) AS t, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS j FROM d{i}) GROUP BY 1, 2, 3),
b{i + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(any_value(a.c), any_value(b{i}.c)) AS c FROM b{i} LEFT JOIN (
    SELECT p, e, list({_floor_mean('t', 'n')} ORDER BY j) AS c FROM s{i} GROUP BY 1, 2
  ) a USING (p, e) GROUP BY 1, 2
)"""
            )
    last = rounds
    return ",\n".join(parts) + f""",
w AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(distance) AS error FROM d{last} GROUP BY 1)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{last}) AS codebooks_sha256 FROM v JOIN w USING (r)"""


ORACLES["op13_resident_codebooks"] = _codes_sql(8, 16, 6)


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces that the whole pipeline packs."""
    return corpus_pipeline.run(spark, folder)
