"""Exact top-k search by inner product, with a three-phase uniform threshold.

The dimensions are cut into ``SLICES``; a score is the sum of a query's slice scores.

1. Each part of the table scores its first rows in full and sends the best k of each query: its local list.  The k-th highest of all
   lists is a safe cutoff, as k rows reach it.
2. The cutoff is broadcast; h slices have to bring h / SLICES of it, but for what the rest may bring beyond its share, which the norms
   of the rest bound.  All rows are scored over the first ``SHARE`` slices, and a pair that falls short by more is dropped.
3. The few pairs collected are resolved slice by slice over the others, dropped further as they fall short, and each part sends its best k
   that reach the cutoff.

A part sends at most k rows per query in either pass, however many rows tie.  Queries are taken in blocks of bounded size,
each against all rows; only such a block and its cutoffs are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import keyed, materialize

SLICES = 8
#: Slices that are scored for all rows.  Vectors without a direction of their own give way only late, so most of them.
SHARE = 6
#: Tiles of a part that the local lists are made of.
_HEAD_TILES = 1
#: Queries that are broadcast at once.
QUERY_BLOCK = 4096
#: Vectors with a component beyond it, in units of 1 / scale, are kept apart and scored by long or unbounded integers.
LARGEST = 1 << 24
_TILE = 1024


def scaled(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``row, vec_id, size, v``: components floor(scale * x) as packed 32-bit integers, or as doubles (which hold them exactly) where one
    reaches ``LARGEST``.

    Left out: vectors that are null or hold a null or non-finite component.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            kept: list[tuple] = []
            for row, vec_id, x in zip(batch.column("row").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if not x.is_valid or x.values.null_count:
                    continue
                given = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(given).all():
                    continue
                v = np.floor(scale * given)
                if not np.isfinite(v).all():
                    raise ValueError(f"vec_id {vec_id}: a component is too large to be scored")
                kept.append((row, vec_id, len(v), v.astype("<i4" if (np.abs(v) < LARGEST).all() else "<f8").tobytes()))
            cols = list(zip(*kept)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["row", "vec_id", "size", "v"])

    rows = keyed(vectors, F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "row long, vec_id long, size int, v binary")


def _parts(size: int) -> list[slice]:
    edges = np.linspace(0, size, SLICES + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _unpacked(packed: list[bytes], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and components of the vectors of usual components, and of the others."""
    wide = np.array([len(v) > 4 * size for v in packed], bool)
    out = []
    for at, kind in ((np.flatnonzero(~wide), "<i4"), (np.flatnonzero(wide), "<f8")):
        if len(at):
            out.append((at, np.frombuffer(b"".join([packed[i] for i in at]), kind).reshape(len(at), size).astype(np.float64)))
    return out


def _kind(left: np.ndarray, right: np.ndarray) -> type:
    """What holds all sums of products exactly."""
    size = left.shape[1]
    bound = float(np.abs(left).max()) * float(np.abs(right).max()) * size if left.size and right.size else 0.0
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


def _whole(left: np.ndarray, right: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact scores of all pairs; those of rows with themselves may be anything."""
    kind = _kind(left, right)
    if kind is not object:
        return left.astype(kind) @ right.astype(kind).T
    ints = [[[int(x) for x in v] for v in m] for m in (left, right)]
    total = np.zeros(own.shape, np.int64)
    for i, x in enumerate(ints[0]):
        for j, y in enumerate(ints[1]):
            if not own[i, j]:
                score = sum(map(int.__mul__, x, y))
                if not -(2**63) <= score < 2**63:
                    raise OverflowError(f"a score of two vectors does not fit a long: {score}")
                total[i, j] = score
    return total


def _rest_norms(x: np.ndarray) -> np.ndarray:
    """For each number of slices done, the length of what is left of each vector, rounded up."""
    squares = np.stack([(x[:, s].astype(np.float64) ** 2).sum(axis=1) for s in _parts(x.shape[1])])
    left = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.sqrt(np.concatenate([left, np.zeros((1, len(x)))])) * (1 + 1e-9) + 1e-3


def collected(left: np.ndarray, right: np.ndarray, low: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Rows and queries of the pairs that reach the cutoffs ``low``, their exact scores, and for how many pairs each slice was scored."""
    kind = _kind(left, right)
    if kind is object:
        total = _whole(left, right, own)
        rows, queries = np.nonzero((total >= low[None, :]) & ~own)
        return rows, queries, total[rows, queries], [own.size] * SLICES
    left, right = left.astype(kind), right.astype(kind)
    parts, rest = _parts(left.shape[1]), (_rest_norms(left), _rest_norms(right))
    least = low - 1e-6 * np.abs(low) - 1e-3  # room for the rounding of the bounds, never of the scores
    edge = parts[SHARE].start
    total = left[:, :edge] @ right[:, :edge].T
    alive = (total + rest[0][SHARE][:, None] * rest[1][SHARE][None, :] >= least[None, :]) & ~own
    scored = [own.size] * SHARE
    rows, queries = np.nonzero(alive)
    sums = total[rows, queries]
    for h in range(SHARE, SLICES):
        scored.append(len(rows))
        sums = sums + np.einsum("ij,ij->i", left[rows, parts[h]], right[queries, parts[h]])
        keep = sums + rest[0][h + 1][rows] * rest[1][h + 1][queries] >= least[queries]
        rows, queries, sums = rows[keep], queries[keep], sums[keep]
    keep = sums >= low[queries]
    return rows[keep], queries[keep], sums[keep], scored


def _tiles(source: Iterator[pa.RecordBatch], queries: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]):
    """For tiles of rows and queries of one size: places of the queries, ids, rows, queries, which pair is a row with itself."""
    for batch in source:
        sizes = batch.column("size").to_numpy()
        row, ids, v = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v").to_pylist()
        for size in np.unique(sizes):
            if int(size) not in queries:
                continue
            mine = np.flatnonzero(sizes == size)
            for a in range(0, len(mine), _TILE):
                for found, x in _unpacked([v[i] for i in mine[a : a + _TILE]], int(size)):
                    at = mine[a + found]
                    for place, own, q in queries[int(size)]:
                        for b in range(0, len(place), _TILE):
                            same = row[at][:, None] == own[b : b + _TILE][None, :]
                            yield place[b : b + _TILE], ids[at], x, q[b : b + _TILE], same


class _Best:
    """The best k (score, then smaller id) of each query."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids = k, np.zeros((n, 0)), np.zeros((n, 0), np.int64)
        self.n = n
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.found.append((query, ids, score))
        self.held += len(query)
        if self.held > 4 * self.n * self.k + 100_000:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, ids, score = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, ~score, query))
        query, ids, score = query[order], ids[order], score[order]
        start = np.maximum.accumulate(np.where(np.r_[True, query[1:] != query[:-1]], np.arange(len(query)), 0)) if len(query) else query
        keep = np.arange(len(query)) - start < self.k
        self.found = [(query[keep], ids[keep], score[keep])]
        self.held = int(keep.sum())
        return self.found[0]


SCORES = "place long, vec_id long, score long"


def _sent(best: _Best) -> pa.RecordBatch:
    query, ids, score = best.shrink()
    return pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(score.astype(np.int64))], ["place", "vec_id", "score"])


def search_block(rows: DataFrame, block: list, k: int) -> DataFrame:
    """``place, vec_id, score`` of the rows that may be among the best k of each query of a block, the best k included."""
    spark = rows.sparkSession
    by_size: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for size in {r["size"] for r in block}:
        own = [i for i, r in enumerate(block) if r["size"] == size]
        places, rows_of = np.array(own), np.array([block[i]["row"] for i in own])
        by_size[size] = [(places[at], rows_of[at], q) for at, q in _unpacked([bytes(block[i]["v"]) for i in own], size)]
    queries = spark.sparkContext.broadcast(by_size)
    n = len(block)

    tiles = sum(-(-len(place) // _TILE) for found in by_size.values() for place, _, _ in found)

    def first(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(n, k)
        for places, ids, x, q, own in islice(_tiles(source, queries.value), _HEAD_TILES * tiles):
            rows_, of = np.nonzero(~own)
            best.add(places[of], ids[rows_], _whole(x, q, own)[rows_, of].astype(np.int64))
        yield _sent(best)

    window = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    ranked = rows.mapInArrow(first, SCORES).withColumn("rank", F.row_number().over(window))
    cutoff = np.full(n, -np.inf)
    for r in ranked.where(F.col("rank") == k).select("place", "score").collect():  # one number per query of the block
        cutoff[r["place"]] = r["score"]
    safe = spark.sparkContext.broadcast(cutoff)

    def rest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(n, k)
        for places, ids, x, q, own in _tiles(source, queries.value):
            found, of, score, _ = collected(x, q, safe.value[places], own)
            best.add(places[of], ids[found], score.astype(np.int64))
        yield _sent(best)

    return rows.mapInArrow(rest, SCORES)


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` holds for, the k best other rows.

    The score is the integer inner product of components floor(scale * x); ties go to the smaller ``vec_id``, a null one
    first.  Only vectors of one length are compared.  Rows are told apart by position, so a repeated row is a candidate
    for its twin, and a repeated query has its ranks repeated.  Without queries or candidates the result is empty.
    """
    rows = materialize(scaled(vectors, scale), "topk-vectors")
    chosen = rows.where(is_query)
    count = chosen.count()
    blocks = -(-count // QUERY_BLOCK)
    found = []
    for i in range(blocks):
        block = chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).collect()  # about QUERY_BLOCK rows
        if not block:
            continue
        names = rows.sparkSession.createDataFrame([(j, r["vec_id"]) for j, r in enumerate(block)], "place long, query_id long")
        window = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
        best = search_block(rows, block, k).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
        named = best.join(F.broadcast(names), "place").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        found.append(materialize(named, "topk-block") if blocks > 1 else named)
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.union, found)
