"""Vectors as whole numbers: packed rows, exact distances, exact means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import keyed

#: Sums below it are exact in 64-bit integers.
_EXACT = 1 << 62


def whole_vectors(vectors: DataFrame, scale: int, *carried: str | Column) -> DataFrame:
    """``row``, the carried columns, ``size`` and ``v`` of every usable vector: components floor(scale * x) as packed integers, of 32 bits
    where all fit and else of 64.

    Left out: vectors that are null or hold a null or non-finite component, or one that has no 64-bit integer.  ``row`` is settled once
    the result is written.
    """
    rows = keyed(vectors, *carried, F.col("embedding").cast("array<double>").alias("_given"))
    fields = [f for f in rows.schema.fields if f.name != "_given"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", size int, v binary"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            kept, packed, sizes = [], [], []
            for i, x in enumerate(batch.column("_given")):
                if not x.is_valid or x.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * x.values.to_numpy(zero_copy_only=False))
                if not (np.abs(v) < _EXACT).all():  # false for nan, too
                    continue
                kept.append(i)
                sizes.append(len(v))
                packed.append(v.astype("<i4" if (np.abs(v) < 1 << 31).all() else "<i8").tobytes())
            own = batch.drop_columns("_given").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], [*own.schema.names, "size", "v"])

    return rows.mapInArrow(run, schema)


def unpacked(packed: list[bytes], size: int) -> np.ndarray:
    """A matrix of 64-bit integers, one row for each vector of ``size`` components."""
    narrow = np.array([len(v) == 4 * size for v in packed], bool)
    if narrow.all():
        return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), size).astype(np.int64)
    return np.stack([np.frombuffer(v, "<i4" if n else "<i8").astype(np.int64) for v, n in zip(packed, narrow)])


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` and ``c`` (one row or as many), as 64-bit integers where all fit, else as Python's."""
    if not x.size or not c.size:
        return np.zeros(len(x), np.int64)
    most = int(np.abs(x).max()) + int(np.abs(c).max())
    if x.shape[-1] * most**2 >= _EXACT:
        return ((x.astype(object) - c.astype(object)) ** 2).sum(axis=-1)
    if x.shape[-1] * most**2 < 1 << 53:  # doubles hold every sum
        apart = x.astype(np.float64) - c
        return np.einsum("ij,ij->i", apart, apart).astype(np.int64)
    apart = x - c
    return np.einsum("ij,ij->i", apart, apart)


def long_or_null(values: np.ndarray) -> pa.Array:
    """As 64-bit integers; null where one does not fit."""
    if values.dtype != object:
        return pa.array(values.astype(np.int64))
    return pa.array([int(v) if v < 1 << 63 else None for v in values], pa.int64())


def summed(x: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as Python integers."""
    if x.size and len(x) * int(np.abs(x).max()) < _EXACT:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0) if x.size else np.zeros(x.shape[1], object)


def long_total(total: Column) -> Column:
    """A decimal sum as a long; null beyond."""
    return F.when(total <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), total).cast("long")
