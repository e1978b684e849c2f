"""Centroid clustering whose assignment is an Orchard search.

Lloyd rounds over whole numbers.  For each centroid the others are listed by their distance from it.  The search of a vector follows the
list of its current centroid; once a nearer centroid is found it goes on with that one's list, from the start, passing over those already
measured.  It ends where the list goes strictly beyond twice the current distance: whatever stands further on is further from the vector,
by the triangle inequality, so ties are met and go to the smaller number.

A round is one scan of the vectors, each beginning at the centroid that the first round gave it.  A task sends one sum per centroid and
component, however many vectors it holds, so neither a hot centroid nor repeated vectors gather anywhere; only the centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import materialize
from hostlens.llm.lattice import long_or_null, long_total, squared, summed, unpacked, whole_vectors

#: Marks of visited (vector, centroid) pairs that a tile holds.
_MARKS = 1 << 22


class Centroids:
    """Centroids with the lists of their neighbours, nearest first."""

    def __init__(self, at: np.ndarray):
        self.at = at
        n = len(at)
        rows = [squared(at, at[i]) for i in range(n)]
        exact = object if any(r.dtype == object for r in rows) else np.int64
        self.gaps = np.array(rows, exact).reshape(n, n)
        order = [sorted((g, j) for j, g in enumerate(r) if j != i) for i, r in enumerate(self.gaps.tolist())]
        self.lists = np.array([[j for _, j in o] for o in order], np.int64).reshape(n, n - 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each row, its squared distance, and how many distances were measured."""
        n, k = len(x), len(self.at)
        current = start.copy()
        best = squared(x, self.at[current])
        visited = np.zeros((n, k), bool)
        visited[np.arange(n), current] = True
        place, active, measured = np.zeros(n, np.int64), np.arange(n if k > 1 else 0), n
        while len(active):
            own = current[active]
            candidate = self.lists[own, place[active]]
            # Beyond twice the distance: gap > 4 * best, without overflow.
            far = self.gaps[own, candidate] // 4 + (self.gaps[own, candidate] % 4 != 0) > best[active]
            active, candidate = active[~far], candidate[~far]
            place[active] += 1
            fresh = ~visited[active, candidate]
            rows, to = active[fresh], candidate[fresh]
            if len(rows):
                visited[rows, to] = True
                measured += len(rows)
                apart = squared(x[rows], self.at[to])
                if apart.dtype != best.dtype:
                    best, apart = best.astype(object), apart.astype(object)
                nearer = (apart < best[rows]) | ((apart == best[rows]) & (to < current[rows]))
                jump = rows[nearer]
                current[jump], best[jump], place[jump] = to[nearer], apart[nearer], 0
            active = active[place[active] < k - 1]
        return current, best, measured


def _tiles(source: Iterator[pa.RecordBatch], size: int, centroids: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    step = max(1, _MARKS // max(1, centroids))
    for whole in source:
        for a in range(0, whole.num_rows, step):
            batch = whole.slice(a, step)
            start = batch.column("cluster").to_numpy() if "cluster" in batch.schema.names else np.zeros(batch.num_rows)
            yield batch, unpacked(batch.column("v").to_pylist(), size), start.astype(np.int64)


ASSIGNED = "vec_id long, cluster int, distance long"


def assigned(rows: DataFrame, centroids: Centroids, size: int, with_vectors: bool = False) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector; with ``v`` on demand."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, start in _tiles(source, size, len(centroids.at)):
            cluster, distance, _ = centroids.nearest(x, start)
            out = [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), long_or_null(distance)]
            yield pa.RecordBatch.from_arrays([*out, batch.column("v")] if with_vectors else out, ["vec_id", "cluster", "distance", "v"][: len(out) + with_vectors])

    return rows.mapInArrow(run, ASSIGNED + (", v binary" if with_vectors else ""))


def moved(rows: DataFrame, centroids: Centroids, size: int) -> np.ndarray:
    """The means (rounded down) of the vectors nearest to each centroid; a centroid without any stays."""
    k = len(centroids.at)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((k, size), object), np.zeros(k, np.int64)
        for _, x, start in _tiles(source, size, k):
            cluster, _, _ = centroids.nearest(x, start)
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                totals[c] += summed(own)
                counts[c] += len(own)
        some = np.flatnonzero(counts)
        cells = [(int(c), j, Decimal(int(totals[c, j])), int(counts[c])) for c in some for j in range(size)]
        columns = list(zip(*cells)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["cluster", "component", "total", "n"])

    sums = rows.mapInArrow(run, "cluster int, component int, total decimal(38,0), n long").groupBy("cluster", "component")
    at = centroids.at.copy()
    # One number per centroid and component.
    for r in sums.agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).collect():
        at[r["cluster"], r["component"]] = int(r["total"]) // r["n"]
    return at


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector of ``size`` components.

    Components are floor(scale * x).  Centroids start as the k vectors with the smallest SHA-256 of ``seed:vec_id``, in its order (of
    equal ids, in order of their bytes; null ids last); ``rounds`` times every vector goes to the nearest centroid, ties to the smaller
    number, and centroids become means, rounded down; then vectors are assigned once more.

    Left out are vectors that are null, of another size, or with a component that is null, non-finite or beyond 64 bits.  Repeated
    rows count each and null ids are kept.  With fewer than k vectors there are as many centroids, with none the result is empty.
    A distance or inertia beyond 64 bits is null.  Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = materialize(whole_vectors(vectors, scale, F.col("vec_id").cast("long").alias("vec_id")).where(F.col("size") == size).drop("row", "size"), "orchard-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    first = rows.orderBy(order, "v").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], ASSIGNED + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = Centroids(unpacked([bytes(r["v"]) for r in first], size))
    for i in range(rounds):
        if i == 1:  # where the first round put them, vectors begin from now on
            rows = materialize(assigned(rows, Centroids(centroids.at), size, True).drop("distance"), "orchard-placed")
        centroids = Centroids(moved(rows, centroids, size))
    found = materialize(assigned(rows, centroids, size), "orchard-clusters")
    per_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()  # k rows
    lost, whole = sum(r["lost"] for r in per_cluster), sum(int(r["total"] or 0) for r in per_cluster)
    named = [
        (r["cluster"], None if r["lost"] else r["total"], None if lost else Decimal(whole), hashlib.sha256(",".join(str(int(c)) for c in centroids.at[r["cluster"]]).encode()).hexdigest())
        for r in per_cluster
    ]
    sums = spark.createDataFrame(named, "cluster int, own decimal(38,0), whole decimal(38,0), centroid_sha256 string")
    sums = sums.select("cluster", long_total(F.col("own")).alias("cluster_inertia"), long_total(F.col("whole")).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast
