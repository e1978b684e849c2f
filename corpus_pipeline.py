"""A training corpus in five stages: quality rules, quality classifier, near duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes each result and reads it for the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hostlens.llm import crf_quality, jaccard_join, packing, quality_rules, suffix_dedup
from hostlens.llm.common import Stages, discard, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model scores as good; it is fitted on the whole table, bad documents included."""
    model = crf_quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return crf_quality.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs, 5, 80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes or of 50 words that other places repeat."""
    return suffix_dedup.clean(docs, words=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, each in the sources' own proportions."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("packing", packed),
]
#: Line models, components and token ids are beyond SQL; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order: a stage's own tables go once its result stands, and the result before it as well."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Stages() as own:
            kept = own.result(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return docs
