"""Near duplicates as the corpus grows: shingles that are shared by chance, and what written stages leave on disk."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import jaccard_join
from hostlens.llm.common import Stages, materialize

COUNTED = int(jaccard_join._COUNTED)


def first_of(tokens, percent, rarity):
    """Elements of the prefixes of a set, ordered by a number that each element has."""
    out = set()
    for found, room in jaccard_join.heads_of(tokens, percent):
        out |= set(sorted(found.tolist(), key=lambda t: (t >= COUNTED, 0 if t >= COUNTED else rarity(t), t))[:room])
    return out


@pytest.mark.parametrize("percent", [50, 75, 80, 85, 100])
def test_similar_sets_share_an_element(percent):
    rng = np.random.default_rng(percent)
    rarities = [lambda t: 0, lambda t: t % 7, lambda t: -t]
    by_parts = 0
    for size in [*range(1, 24), 31, 32, 50, 51, 52, 63, 64, 79, 100, 127, 128, 255, 256, 511, 700]:
        for _ in range(6):
            grown = int(rng.integers(0, max(1, 100 * size // percent - size + 1)))
            whole = rng.integers(0, 1 << 64, size + grown, dtype=np.uint64)
            lost = int(rng.integers(0, size // 4 + 1))
            one, other = np.unique(whole[:size]), np.unique(whole[lost:])
            if not len(other) or 100 * len(np.intersect1d(one, other)) < percent * len(np.union1d(one, other)):
                one, other = np.unique(whole), np.unique(whole[: max(1, -(-percent * len(whole) // 100))])
            by_parts += any(found.max() != one[len(found) - 1] for found, _ in jaccard_join.heads_of(one, percent))
            for rarity in rarities:
                assert first_of(one, percent, rarity) & first_of(other, percent, rarity), (size, grown, lost)
    assert bool(by_parts) == (percent >= 75)


def test_chance_shingles_make_no_candidates(spark):
    rng = random.Random(4)
    common = [" ".join(f"c{rng.randrange(50)}" for _ in range(6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(common, k=70))) for i in range(60)]  # a third of the shingles is found in other documents as well
    near = " ".join(f"n{k}" for k in range(200))
    rows += [(100, near), (101, near + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    heads = materialize(jaccard_join.digest(docs, 5, 80), "test-heads")
    posted = jaccard_join.postings(heads, jaccard_join.frequencies(heads, 3), 3)
    lists = posted.groupBy("token").agg(F.count_distinct("cid").alias("held"), F.max("n").alias("n")).where("held > 1")
    assert {(r["held"], r["n"]) for r in lists.collect()} == {(2, 197)}  # the near copies only
    assert {r["component_id"] for r in jaccard_join.similar(docs).collect()} == {*range(60), 100}


def test_written_stages_leave_no_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        blocks = manager.getAllBlocks()
        return {x for i in range(blocks.size()) if (x := blocks.apply(i).name()).startswith("shuffle")}

    before, setting = shuffles(), spark.conf.get(key)
    with Stages():
        kept = materialize(spark.range(2000).groupBy((F.col("id") % 9).alias("k")).count(), "test-sums")
        for _ in range(50):
            if not (left := shuffles() - before):
                break
            time.sleep(0.2)
        assert not left and kept.agg(F.sum("count")).head()[0] == 2000
    assert spark.conf.get(key) == setting
