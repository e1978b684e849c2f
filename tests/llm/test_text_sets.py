"""Near duplicates and repeated strings against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from hostlens.llm import jaccard_join, suffix_dedup
from hostlens.llm.components import components

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def grouped(rows, n, percent):
    sets = [shingles(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(s), least.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 50)])
def test_similar(nasty, nasty_rows, n, percent):
    got = [tuple(r) for r in jaccard_join.similar(nasty, n, percent).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, grouped(nasty_rows, n, percent)))


def test_chains_and_blocks(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(base[:20] + [f"y{i}_{j}" for j in range(40)])) for i in range(30)]  # a shared passage only
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(repr, grouped(rows, 4, 85)))
    monkeypatch.setattr(jaccard_join, "BROADCAST_CLASSES", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 700)
    got = jaccard_join.similar(docs, 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def numbers(rows, n, percent):
    sets = [shingles(r[1], n) for r in rows]
    return [(r[0], sum(j != i and bool(s and t) and 100 * len(s & t) >= percent * len(s | t) for j, t in enumerate(sets))) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("block", [jaccard_join.BLOCK_TOKENS, 700])
def test_numbers_of_links(spark, nasty, nasty_rows, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", block)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"x{rng.randrange(400)}" if rng.random() < 0.02 else w for w in base)) for i in range(60)]  # many links, some copies
    rows += [(200 + i, f"pair {i // 2} of " + " ".join(f"v{i // 2}_{j}" for j in range(40)) + f" end{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for df, want in ((docs, numbers(rows, 4, 85)), (nasty, numbers(nasty_rows, 4, 85))):
        got = jaccard_join.similar(df, 4, 85).select("doc_id", "n_links").collect()
        assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    assert max(n for _, n in numbers(rows, 4, 85)) > 2


def test_keep_one(nasty, nasty_rows, empty):
    kept = jaccard_join.keep_one(nasty)
    assert kept.columns == nasty.columns
    want = Counter()
    groups = {}
    for r, (_, n, component) in zip(nasty_rows, grouped(nasty_rows, 5, 80)):
        if n == 0:
            want[r[0]] += 1
        elif r[0] is not None:
            groups[component] = min(groups.get(component, r[0]), r[0])
        else:
            want[None] += component is None
    want.update(groups.values())
    assert Counter(r["doc_id"] for r in kept.collect()) == +want
    assert jaccard_join.similar(empty).collect() == [] and jaccard_join.keep_one(empty).collect() == []


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (200, 200)]
    random.Random(1).shuffle(edges)
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def stripped(rows, length=suffix_dedup.LENGTH):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for doc, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def test_strip(nasty, nasty_rows, empty):
    got = [(*r[:4], bytes(r[4])) for r in suffix_dedup.strip(nasty).collect()]
    want = stripped(nasty_rows)
    assert any(w[2] for w in want)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert suffix_dedup.strip(empty).collect() == []


def test_clean_keeps_columns(nasty, nasty_rows, empty):
    out = suffix_dedup.clean(nasty)
    assert out.columns == nasty.columns
    rows = out.collect()
    want = Counter(repr((d, kept.decode("utf-8", "ignore") if removed else None)) for d, _, removed, _, kept in stripped(nasty_rows) if removed)
    assert len(rows) == len(nasty_rows)
    assert not want - Counter(repr((r["doc_id"], r["text"])) for r in rows)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    assert suffix_dedup.clean(empty).collect() == []


def test_clean_drops_split_characters(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(500))
    docs = spark.createDataFrame([(1, "é" + passage + "€"), (2, "ê" + passage + "₭"), (3, "�" + passage)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.clean(docs).collect()}
    assert got == {1: "é", 2: "ê", 3: "�"}  # the first two bytes of € and ₭ go with the passage, the third is no character


def without_repeats(rows):
    """Texts without repeated strings of 400 bytes or 50 words, by plain counting; None where nothing goes."""
    data = [(r[1] or "").encode() for r in rows]
    words = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    runs = Counter(tuple(x[2] for x in w[i : i + 50]) for w in words for i in range(len(w) - 49))
    strings = Counter(b[s : s + 400] for b in data for s in range(len(b) - 399))
    out = []
    for b, w in zip(data, words):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if strings[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        for i in range(len(w) - 49):
            if runs[tuple(x[2] for x in w[i : i + 50])] > 1:
                gone[w[i][0] : w[i + 49][1]] = True
        out.append(np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else None)
    return out


def test_clean_by_words(nasty, nasty_rows, spark, empty):
    rng = random.Random(8)

    def prose(n, size=3):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(size)) for _ in range(n))

    short, long, less, wide = prose(55), prose(50, 12), prose(49, 12), prose(50, 1)
    rows = [(r[0], r[1]) for r in nasty_rows] + [(2000 + i, f"{prose(9, 5)} {p.replace(' ', gap)}{end}") for i, (p, gap, end) in enumerate(
        [(short, " ", ""), (short, "\n", " é tail"), (long, " ", "\n"), (long, "  ", " x"), (less, " ", " y"), (less, "\t", " z"), (wide, " ", ""), (wide, "\r\n", " 中"), (prose(70), " ", "")]
    )]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, codes int").repartition(3)
    got = Counter((r["doc_id"], r["text"], r["codes"]) for r in suffix_dedup.clean(docs, words=True).collect())
    plain = without_repeats(rows)
    assert all(p is not None for p in plain[-9:-5] + plain[-3:-1]) and all(p is None for p in (*plain[-5:-3], plain[-1]))
    assert got == Counter((i, text if p is None else p, 7) for (i, text), p in zip(rows, plain))
    assert suffix_dedup.clean(empty, words=True).collect() == []


def repeated_words(rows):
    """Words that stand in runs of 50 words found twice, by plain counting."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode()) for r in rows]
    runs = Counter(tuple(w[i : i + 50]) for w in words for i in range(len(w) - 49))
    return [len({j for i in range(len(w) - 49) if runs[tuple(w[i : i + 50])] > 1 for j in range(i, i + 50)}) for w in words]


def test_strip_counts_repeated_words(nasty_rows, spark, empty):
    rng = random.Random(12)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(n))

    passage, less, inner = prose(53), prose(49), prose(60)
    rows = [(r[0], r[1]) for r in nasty_rows] + list(enumerate([
        f"{prose(40)} {passage}", f"{passage.replace(' ', chr(10))} {prose(9)}", f"{less} {prose(30)}", f"{prose(30)} {less}", f"{inner} é {inner}", prose(90), "again " * 80,
    ], 3000))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = repeated_words(rows)
    assert counts[-7:] == [53, 53, 0, 0, 120, 0, 80]
    got = [(*r[:4], bytes(r[4]), r["n_repeated_words"]) for r in suffix_dedup.strip(docs, words=True).collect()]
    assert sorted(map(repr, got)) == sorted(repr((*w, n)) for w, n in zip(stripped(rows), counts))
    assert suffix_dedup.strip(empty, words=True).collect() == []


def test_op5_shows_passages_of_over_50_words(spark, tmp_path):
    from hostlens.llm.queries import QUERIES

    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(900)]
    passage = " ".join(words[:53])
    assert len(passage) < 400
    texts = [f"{' '.join(words[100:190])} {passage} end", f"{passage} {' '.join(words[200:290])}", " ".join(words[300:420])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in QUERIES["op5_merged_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert {i: r["n_repeated_words"] for i, r in rows.items()} == {0: 53, 1: 53, 2: 0}
    assert all(r["n_removed"] == 0 and r["n_bytes"] == len(texts[i]) for i, r in rows.items())  # 400 bytes bind what is removed


def test_pipeline_cuts_passages_of_over_50_words(spark):
    import corpus_pipeline

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    passage = " ".join(words[:53])
    assert len(passage) < 400
    own = [" ".join(words[100 * i : 100 * i + 90]) for i in range(1, 5)]
    texts = [f"{own[0]} {passage} end", f"{passage} {own[1]}", f"{own[2]}\n{passage}", own[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_strings(spark, docs, "").collect()}
    assert got == {0: f"{own[0]}  end", 1: f" {own[1]}", 2: f"{own[2]}\n", 3: own[3]}


@pytest.mark.parametrize("shard", [600, 4000, 1 << 30])
def test_merged_shards(shard):
    rng = random.Random(3)

    def noise(n):
        return bytes(rng.choice(b"abcd") for _ in range(n))

    bases = [noise(900) for _ in range(3)]
    parts = []
    for _ in range(30):
        base, a, b = rng.choice(bases), rng.randrange(300), rng.randrange(500, 900)
        parts.append((noise(rng.randrange(200)) + base[a:b] + noise(rng.randrange(200)) + b"ab" * rng.randrange(250)).ljust(400, b"x"))
    count = Counter(t[s : s + 400] for t in parts for s in range(len(t) - 399))
    again, one, two = suffix_dedup.repeated_windows(parts, shard)
    assert [a.tolist() for a in again] == [[count[t[s : s + 400]] > 1 for s in range(len(t) - 399)] for t in parts]
    assert len({*zip(one.tolist(), two.tolist())}) == len(count)


def test_spread_bins_meet():
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    rng = random.Random(4)
    passage = bytes(rng.choice(b"abcdefgh") for _ in range(450))
    parts = [bytes(rng.choice(b"xyz") for _ in range(40)) + passage + bytes(rng.choice(b"uvw") for _ in range(40)) for _ in range(4)] + [b"q" + passage]
    marks = []
    for salt in (0, 1, 2):
        own = [i for i in range(5) if i % 3 == salt]
        group = pa.table({
            "bin": [1] * len(own), "salt": pa.array([salt] * len(own), pa.int32()), "spread": [True] * len(own), "batch": pa.array([7] * len(own), pa.int64()),
            "doc": pa.array(own, pa.int32()), "start": pa.array([0] * len(own), pa.int64()), "windows": pa.array([len(parts[i]) - 399 for i in own], pa.int32()),
            "bytes": pa.array([parts[i] for i in own], pa.binary()),
        })
        marks.append(suffix_dedup._compare(1)(group))
    every = pa.concat_tables(marks)
    sent = every.filter(pa.compute.is_valid(every.column("bucket")))
    found = [*every.filter(pa.compute.is_valid(every.column("marks"))).column("marks").to_pylist(), *suffix_dedup._meet(sent).column("marks").to_pylist()]
    spans = {(d, s + i) for m in found for d, s, n in np.frombuffer(m, "<i8").reshape(-1, 3).tolist() for i in range(n)}
    count = Counter(t[s : s + 400] for t in parts for s in range(len(t) - 399))
    assert spans == {(d, s) for d, t in enumerate(parts) for s in range(len(t) - 399) if count[t[s : s + 400]] > 1}
