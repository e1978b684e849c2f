"""Scores of texts against a model of plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import kneser_ney


def learn():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(True))


def learned(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 != 0


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split("[ \t-\r]+", low) if w] + ["</s>\n"]


class Plain:
    """Interpolated modified Kneser-Ney, by definition."""

    def __init__(self, texts, order):
        self.order = order
        padded = [["<s>\n"] * (order - 1) + t for t in texts]
        self.raw = Counter(w for t in texts for w in t)
        grams = Counter(tuple(t[i - order + 1 : i + 1]) for t in padded for i in range(order - 1, len(t)))
        self.counts = {order: grams}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.discounts = {n: kneser_ney.discounts(*[sum(c == i for c in self.counts[n].values()) for i in (1, 2, 3, 4)]) for n in self.counts}
        self.after = defaultdict(lambda: defaultdict(list))
        for n, found in self.counts.items():
            for g, c in found.items():
                self.after[n][g[:-1]].append(c)

    def less(self, n, c):
        return 0 if not c else self.discounts[n][min(c, 3) - 1]

    def p(self, gram):
        n = len(gram)
        lower = self.p(gram[1:]) if n > 1 else 1 / (len(self.raw) + 1)
        found = self.after[n].get(gram[:-1])
        if not found:
            return lower
        c = self.counts[n].get(gram, 0)
        return (c - self.less(n, c)) / sum(found) + sum(self.less(n, x) for x in found) / sum(found) * lower

    def score(self, text):
        t = ["<s>\n"] * (self.order - 1) + text
        return sum(math.log10(self.p(tuple(t[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(t)))


def expected(rows, order):
    model = Plain([tokens(r[1]) for r in rows if learned(r[0])], order)
    n, v = sum(model.raw.values()), len(model.raw)
    out = []
    for doc_id, text, *_ in rows:
        t = tokens(text)
        base = sum(math.log10((model.raw[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out.append((doc_id, learned(doc_id), len(t), sum(w in model.raw for w in t), n, base, model.score(t)))
    return out


def assert_same(found, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    found, wanted = sorted((tuple(r) for r in found), key=key), sorted(wanted, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    np.testing.assert_allclose([r[5:] for r in found], [r[5:] for r in wanted], rtol=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores(spark, nasty, nasty_rows, order):
    assert_same(kneser_ney.evaluate(nasty, learn(), order).collect(), expected(nasty_rows, order))


@pytest.mark.parametrize("order", [2, 3])
def test_small_batches_pieces_and_shards(spark, nasty, nasty_rows, order, monkeypatch):
    """Texts of several pieces over several batches, and n-grams over many shards."""
    monkeypatch.setattr(kneser_ney, "_ENTRIES_PER_SHARD", 400)
    found = kneser_ney.tokenized(nasty, learn(), order, 900, 300)
    assert found.count() > 10 and found.select(F.explode("whole").alias("w")).where("not w").count() > 5
    model = kneser_ney.train(found, order)
    assert model.levels[-1].shards > 5
    assert_same(kneser_ney.score(found, model).collect(), expected(nasty_rows, order))


def test_probabilities_sum_to_one(spark, nasty_rows):
    model = Plain([tokens(r[1]) for r in nasty_rows if learned(r[0])], 3)
    words = [*model.raw, "never met"]
    for context in [("<s>\n", "<s>\n"), tuple(tokens(nasty_rows[0][1])[:2]), ("never", "met")]:
        assert abs(sum(model.p((*context, w)) for w in words) - 1) < 1e-9


def test_nothing_to_learn(spark, nasty, empty):
    assert kneser_ney.evaluate(empty, learn()).count() == 0
    rows = kneser_ney.evaluate(nasty, F.lit(None).cast("boolean")).collect()
    assert len(rows) == nasty.count() and all(r["train_tokens"] == 0 and r["score"] == 0 and r["n_known"] == 0 for r in rows)


def test_a_word_in_a_third_of_all_rows(spark):
    rows = [(i, "hot " * (i % 7 + 1) + f"w{i}" if i % 3 == 0 else f"a{i % 11} b{i % 5} c{i}") for i in range(600)]
    found = kneser_ney.evaluate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), learn(), 2)
    assert_same(found.collect(), expected(rows, 2))


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    import random

    rng = random.Random(3)
    step = {i: [rng.randrange(200) for _ in range(4)] for i in range(200)}

    def walk():
        at, out = rng.randrange(200), []
        for _ in range(60):
            out.append(f"w{at}")
            at = rng.choice(step[at])
        return " ".join(out)

    docs = spark.createDataFrame([(i, walk()) for i in range(400)], "doc_id long, text string")
    rows = [r for r in kneser_ney.evaluate(docs, learn()).collect() if not r["learned"]]
    assert len(rows) > 20 and all(r["score"] > r["base_score"] + 20 for r in rows)
