"""Clusters and codes of vectors against plain loops, with nulls, ties, repeated rows, other sizes and huge components."""

import hashlib
import math
import random

import numpy as np
import pytest

from hostlens.llm import codebooks, orchard
from hostlens.llm.lattice import squared

SCHEMA = "vec_id long, embedding array<double>, label int, row long, v string, cluster string, size string"


def vectors(n=60, size=8, seed=3, big=False):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    found = [[c + rng.gauss(0, 0.2) for c in rng.choice(centres)] for _ in range(n)]
    found[3], found[20] = list(found[2]), [0.0] * size
    rows = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(found)]
    rows += [rows[5], rows[5], (None, found[9], 1), (400, None, 1), (401, [None, *found[1][1:]], 1), (402, [math.nan, *found[1][1:]], None), (403, [math.inf, *found[1][1:]], 2), (404, found[0][:-1], 2), (405, [], 2)]
    rows += [(500, [1e7] * size, 1), (501, [-3e7] * size, 0)] if big else []
    return [(*r, 1, "v", "c", "s") for r in rows]


def whole(v, scale, size):
    if v is None or any(x is None or not math.isfinite(x) for x in v) or len(v) != size:
        return None
    return [math.floor(scale * x) for x in v]


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain_clusters(rows, k, rounds, size):
    kept = [(r[0], w) for r in rows if (w := whole(r[1], 1024, size)) is not None]
    by = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())
    at = [w for _, w in sorted(kept, key=by)[:k]]
    near = lambda w: min(range(len(at)), key=lambda c: (gap(w, at[c]), c))
    for _ in range(rounds):
        own = [near(w) for _, w in kept]
        for c in range(len(at)):
            mine = [w for (_, w), o in zip(kept, own) if o == c]
            if mine:
                at[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, near(w), gap(w, at[near(w)])) for i, w in kept]
    fits = lambda x: x if x < 1 << 63 else None
    return [
        (i, c, fits(d), fits(sum(x[2] for x in found if x[1] == c)), fits(sum(x[2] for x in found)), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest())
        for i, c, d in found
    ]


@pytest.mark.parametrize("big", [False, True])
def test_clusters(spark, big):
    rows = vectors(big=big)
    found = orchard.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, 5, 8)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_clusters(rows, 4, 5, 8), key=repr)


def test_few_or_no_vectors(spark):
    rows = vectors()[:2]
    found = orchard.cluster(spark.createDataFrame(rows, SCHEMA), 8, 2, 8).collect()
    assert sorted(map(tuple, found)) == sorted(plain_clusters(rows, 8, 2, 8)) and len({r["cluster"] for r in found}) == 2
    assert orchard.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codebooks.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codebooks.compress(spark.createDataFrame([(400, None, 1, 1, "", "", "")], SCHEMA)).count() == 0


def test_search_stops_early_and_meets_ties():
    rng = np.random.default_rng(1)
    # Sixteen tight groups far apart: a search that begins in its group measures next to nothing else.
    centres = rng.integers(-(10**6), 10**6, (64, 16))
    x = np.repeat(centres, 20, axis=0) + rng.integers(-50, 50, (64 * 20, 16))
    search = orchard.Centroids(centres)
    own = np.repeat(np.arange(64), 20)
    found, best, measured = search.nearest(x, own)
    assert (found == own).all() and measured == len(x)
    found, again, measured = search.nearest(x, np.zeros(len(x), np.int64))
    assert (found == own).all() and (again == best).all() and measured < 0.6 * len(x) * 64
    tied = orchard.Centroids(np.array([[5, 0], [1, 0], [-1, 0], [1, 0], [0, 1]]))
    for start in range(5):
        assert tied.nearest(np.array([[0, 0]]), np.array([start]))[0].tolist() == [1]


def test_exact_distances():
    a, b = np.array([[1 << 61, -(1 << 61)]]), np.array([-(1 << 61), 1 << 61])
    assert squared(a, b).tolist() == [2 * (1 << 62) ** 2]
    assert squared(np.array([[1 << 28, 3]]), np.array([0, 0])).tolist() == [(1 << 56) + 9]


def plain_codes(rows, positions, entries, rounds, size):
    ordered = sorted((r for r in rows if whole(r[1], 4096, size) is not None), key=lambda r: (r[0] is None, r[0] or 0))
    kept = [(r[0], r[2], whole(r[1], 4096, size)) for r in ordered]
    w = size // positions
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, _, v in kept[:entries]] for p in range(positions)]
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (gap(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(positions):
            own = [near(v, p) for _, _, v in kept]
            for e in range(len(books[p])):
                mine = [part(v, p) for (_, _, v), o in zip(kept, own) if o == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    fits = lambda x: x if x < 1 << 63 else None
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = [(i, label, [near(v, p) for p in range(positions)], v) for i, label, v in kept]
    errors = [sum(gap(part(v, p), books[p][e]) for p, e in enumerate(c)) for _, _, c, v in coded]
    found = [
        (i, "".join(f"{e:02x}" for e in c), fits(x), fits(sum(y for (_, other, _, _), y in zip(coded, errors) if other == label)), digest)
        for (i, label, c, _), x in zip(coded, errors)
    ]
    for r in rows:  # of another size: no code
        if r[1] is not None and len(r[1]) != size and whole(r[1], 4096, len(r[1])) is not None:
            found.append((r[0], None, None, fits(sum(y for (_, other, _, _), y in zip(coded, errors) if other == r[2])), digest))
    return found


@pytest.mark.parametrize("members", [1 << 16, 7])
def test_codes(spark, monkeypatch, members):
    monkeypatch.setattr(codebooks, "_MEMBERS", members)  # 7: every owner is salted
    rows = vectors(90)
    found = codebooks.compress(spark.createDataFrame(rows, SCHEMA).repartition(4), 4, 6, 5)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_codes(rows, 4, 6, 5, 8), key=repr)


def test_codes_of_large_components(spark):
    rows = vectors(40, big=True)
    found = codebooks.compress(spark.createDataFrame(rows, SCHEMA), 8, 16, 3)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_codes(rows, 8, 16, 3, 8), key=repr)


def test_only_changed_parts_move(spark):
    rows = spark.createDataFrame(vectors(200), SCHEMA).where("vec_id < 300")
    from pyspark.sql import functions as F

    from hostlens.llm.common import materialize
    from hostlens.llm.lattice import whole_vectors

    kept = materialize(whole_vectors(rows, 4096, "vec_id"), "t")
    books, state = codebooks.trained(kept, 8, 2, 4, 4)
    state = materialize(state, "t2")
    both = codebooks._reassigned(state, books, 1, 4).groupBy("moving").agg(F.sum("members").alias("n")).collect()
    assert sum(r["n"] for r in both) == 2 * kept.count()
    assert sum(r["n"] for r in both if r["moving"]) < sum(r["n"] for r in both if not r["moving"]) / 4
