"""Quality rules, quality classifier, exact search and notices against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import crf_quality, license_scan, quality_rules, topk


# --- rules ------------------------------------------------------------------


def counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts(nasty, nasty_rows, labels, empty):
    got = quality_rules.judge(nasty, labels).collect()
    want = Counter((r[0], *counts(r[1])) for r in nasty_rows)
    assert Counter(tuple(r[c] for c in ("doc_id", *quality_rules.COUNTS)) for r in got) == want
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)  # too few labels to certify a cutoff
    assert quality_rules.judge(empty, labels).collect() == []


def test_binomial_tail(spark):
    cases = [(10, 0, 0.1), (50, 3, 0.02), (2000, 20, 0.0125), (100000, 1100, 0.0125), (7, 7, 0.5)]
    for n, k, p in cases:
        row = spark.createDataFrame([(n, k)], "n long, k long").select(quality_rules.binomial_tail(F.col("n"), F.col("k"), p).alias("p")).head()
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))
        assert row["p"] == pytest.approx(min(1, exact), rel=1e-6)


def test_cutoffs_control_the_risk(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        good = rng.random() < 0.8
        words = ["word" + str(rng.randrange(999)) for _ in range(30)]
        rows.append((i, " ".join(w + "###" * (not good) for w in words), "en" if i % 4 else "de", int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good int")
    marks = docs.select("doc_id", F.col("good").alias("quality"))
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, marks, 0.1, 0.1).collect()}
    assert all(judged[i] == bool(good) for i, _, lang, good in rows if lang == "en")
    kept = quality_rules.keep(docs, marks, 0.1, 0.1)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in judged.items() if k}
    none = quality_rules.judge(docs, marks.limit(0)).where("not kept").count()
    assert none == 0


def test_keep_leaves_clashing_columns(nasty, nasty_rows, labels, empty):
    kept = quality_rules.keep(nasty, labels)
    assert kept.columns == nasty.columns
    want = Counter(r[0] for r in nasty_rows if counts(r[1])[0] >= 20 and 100 * counts(r[1])[4] <= 30 * counts(r[1])[0])
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert quality_rules.keep(empty, labels).collect() == []


# --- classifier ---------------------------------------------------------------


def chain_marginals(emission, move):
    """Marginals of "good" by enumeration."""
    n = len(emission)
    total = np.zeros(n)
    z = 0.0
    for state in np.ndindex(*[2] * n):
        weight = math.exp(sum(e for e, s in zip(emission, state) if s) + sum(move[a, b] for a, b in zip(state, state[1:])))
        z += weight
        total += weight * np.array(state)
    return total / z


def test_messages_are_exact():
    rng = np.random.default_rng(1)
    lines = np.array([1, 5, 3, 5, 2])
    emission, move = rng.normal(size=lines.sum()), rng.normal(size=(2, 2))
    ahead, back = crf_quality.messages(emission, lines, move)
    got = crf_quality._sigmoid(ahead + back)
    at = 0
    for n in lines:
        assert got[at : at + n] == pytest.approx(chain_marginals(emission[at : at + n], move))
        at += n


def test_classifier_on_held_out(spark, nasty, labels, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = crf_quality.train(docs, marks, 300)
    held = crf_quality.score(docs, model).join(marks, "doc_id").select("doc_id", "score", "quality").collect()
    held = [r for r in held if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 100
    assert np.mean([(r["score"] >= crf_quality.THRESHOLD) == (r["quality"] == 1) for r in held]) > 0.97
    scores = crf_quality.score(nasty, model).collect()
    assert len(scores) == nasty.count() and all(0 <= r["score"] <= 1 for r in scores)
    kept = crf_quality.keep(nasty, model)
    assert kept.columns == nasty.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in scores if r["score"] >= crf_quality.THRESHOLD)
    assert crf_quality.keep(empty, model).collect() == [] and crf_quality.score(empty, model).collect() == []


def test_one_class_or_none(nasty, labels):
    constant = crf_quality.train(nasty, labels.where("quality = 1"))
    assert constant.prior == 1.0
    assert crf_quality.train(nasty, labels.limit(0)).prior == 0.5
    assert {r["score"] for r in crf_quality.score(nasty, constant).collect()} == {1.0}


def test_batches_do_not_matter():
    texts = ["a b\nc d\n\ne", "", "x | y\nx | y", " \n", "A!! B!!\nok then.\r\n"]
    feats, length, lines = crf_quality.line_features(texts)
    assert lines.tolist() == [3, 1, 2, 1, 2]
    single = [crf_quality.line_features([t]) for t in texts]
    assert np.allclose(feats, np.concatenate([f for f, _, _ in single]))


# --- search -------------------------------------------------------------------


def best(rows, k):
    vectors = []
    for i, (vec_id, x) in enumerate(rows):
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            vectors.append((i, vec_id, [math.floor(1024 * float(np.float32(c))) for c in x]))
    out = []
    for i, query, q in vectors:
        if query is not None and query % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), vec_id) for j, vec_id, v in vectors if j != i and len(v) == len(q))
            out += [(query, n + 1, vec_id, -s) for n, (s, vec_id) in enumerate(scored[:k])]
    return out


def test_search(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(9)]) for i in range(700)]
    rows += [(700 + i, [0.5] * 9) for i in range(40)]  # one vector many times
    rows += [(800, None), (900, [1.0] * 8 + [None]), (1000, [float("nan")] * 9), (1100, [float("inf")] * 9), (1200, []), (1300, [1.0, 2.0]), (1301, [3.0, -1.0])]
    rows += [(100, [-0.1] * 9)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("x")).repartition(5)
    got = [tuple(r) for r in topk.search(docs, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == sorted(best(rows, 10))


def test_few_pairs_are_resolved():
    rng = np.random.default_rng(4)
    x = np.floor(1024 * rng.normal(size=(6000, 64)) / 8)
    q, own = x[::100], np.arange(6000)[:, None] == np.arange(0, 6000, 100)[None, :]
    total = np.where(own, -np.inf, x @ q.T)
    cutoff = np.sort(total[:1024], axis=0)[-10]  # of the first tile
    rows, queries, score, scored = topk.collected(x, q, cutoff, own)
    assert scored[: topk.SHARE] == [own.size] * topk.SHARE and scored[topk.SHARE] < 0.4 * own.size and scored[-1] < 0.12 * own.size
    want = np.nonzero(total >= cutoff[None, :])
    assert set(zip(rows.tolist(), queries.tolist())) == set(zip(*(w.tolist() for w in want)))
    assert (score == total[rows, queries]).all()
    # Whole numbers at the bounds of their kinds, and cutoffs that a score meets exactly.
    for scale in (1, 1 << 18, 1 << 25):
        v = rng.integers(-8, 9, (200, 10)) * float(scale)
        exact = v.astype(np.int64).astype(object) @ v.astype(np.int64).astype(object).T
        low = np.array([float(sorted(exact[:, j].tolist())[-5]) for j in range(20)])
        rows, queries, score, _ = topk.collected(v, v[:20], low, np.zeros((200, 20), bool))
        got = {(i, j): int(s) for i, j, s in zip(rows.tolist(), queries.tolist(), score.tolist())}
        assert got == {(i, j): exact[i, j] for i in range(200) for j in range(20) if exact[i, j] >= low[j]}


def test_search_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i * 50, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    got = [tuple(r) for r in topk.search(docs, F.col("vec_id") % 100 == 0, 3).collect()]
    assert sorted(got) == sorted(best(rows, 3))
    assert topk.search(docs.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_large_components(spark):
    rng = random.Random(8)
    rows = [(i * 50, [rng.uniform(-1, 1) * rng.choice([1, 20_000, 1e6, 3e5]) for _ in range(6)]) for i in range(40)]
    rows += [(5000, [0.0] * 5 + [5e6]), (5001, [1.0, -2.0, 0.5, 0.0, 7.0, 0.25]), (5100, [5e6] + [0.0] * 5)]
    got = [tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 60).collect()]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    assert sorted(got) == sorted(want)
    with pytest.raises(Exception, match="does not fit a long"):
        topk.search(spark.createDataFrame([(0, [3e9]), (1, [4e9])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


# --- notices ------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_notices_against_edit_distance():
    rng = random.Random(4)
    notices = (("n", "redistribution and use in source forms"),)
    phrase = notices[0][1]
    for _ in range(150):
        text = list(phrase)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "xz"])
        words = ["aa", "bb", *"".join(text).split(), "cc", "dd"]
        joined = " ".join(words).encode()
        spans = [" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)]
        least = min(distance(phrase, s) for s in spans)
        found = license_scan.fuzzy_places(joined, notices, 10)
        assert bool(found) == (least <= len(phrase) // 10)
        for label, word, n, edits, similarity, text_found in found:
            assert " ".join(words[word : word + n]) == text_found.decode() and edits <= 3
            assert similarity == 1 - edits / len(phrase)


def labelled(text):
    return [(label, found.decode()) for label, *_, found in license_scan.fuzzy_places(b" ".join(license_scan.words_of(text)), license_scan.NOTICES, 10)]


@pytest.mark.parametrize("text", ["licensed under CC BY-SA", "licensed under CC-BY-ND", "licensed under CC BY 4.0", "under the MPL license", "under the BSD license", "under the mitre license",
    "licensed under the Apache License, Version 1.1", "dedicated to the public domain under PDDL", "Creative Commons Attribution-NC 4.0 International License", "subject to the terms of the Nokia Public License"])
def test_neighbouring_licences_have_no_label(text):
    assert labelled(text) == []


def test_errors_beside_distinguishing_words():
    for text, label in (("licenced under CC BY-NC", "cc-by-nc"), ("under tha MIT licence", "mit"), ("under the M.I.T. license", "mit"), ("Creative Commons Attribution Non-Commercial", "cc-by-nc"), ("Creative Commons Atribution 4.0 International License", "cc-by")):
        assert [x for x, _ in labelled(text)] == [label]


def test_near_matches_close_together():
    worse, better = "under tha mit license", "under the mit license"
    for texts in ((worse, "and", better), (better, "and", worse), (worse, better), (worse, worse, better, worse)):
        assert sorted(x for _, x in labelled(" ".join(texts))) == sorted(x for x in texts if x != "and")


def test_scan_rows(spark, nasty, nasty_rows, empty):
    more = [
        (1, "Released under the MIT License. Under the mit-license! CC BY-NC cc by nc", "mit,cc-by-nc"), (2, "gnu general public licence version 3", ""), (3, "nothing", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, t, _ in more], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.summary(license_scan.scan(docs)).collect()}
    assert (rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"], rows[1]["base_labels"], rows[1]["score"]) == (4, 1, 12, "cc-by-nc,mit", 1.0)
    assert rows[2]["n_base"] == 0 and rows[2]["first_word"] is None and rows[2]["labels"] == "gpl" and 0.9 < rows[2]["score"] < 1
    assert (rows[3]["labels"], rows[3]["base_labels"], rows[3]["score"], rows[3]["n_words"]) == ("", "", 0.0, 1)
    got = license_scan.summary(license_scan.scan(nasty)).collect()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    assert Counter((r["doc_id"], r["n_words"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in nasty_rows)
    assert license_scan.scan(empty).collect() == []
