"""Vector codes from one codebook per part position, learned by Lloyd rounds over resident members.

A vector is cut into equal parts.  An owner is a (position, entry, salt): the parts of that position whose entry it is, dealt by salt so
that an entry that most vectors share is many owners, each of a bounded number of members.  In a round

1. owners sum up their members, the sums of an entry's owners give its new value (rounded down), and the codebooks (positions x entries) go to
   all tasks;
2. owners look up every member's nearest entry.  Members that keep theirs stay where they are; only the others are dealt again,
   to the owners of their new entries.

So the first deal is the only shuffle of all parts; later ones carry what changed.  Blocks of members that come in stand beside those that
are there, as rows of the same owner.
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

#: Members of an owner, at most about.
_MEMBERS = 1 << 16
OWNER = ["position", "entry", "salt"]
BLOCK = "position int, entry int, salt int, members int, rows binary, parts binary, wide boolean"


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the smaller index) and its squared distance."""
    entry, best = np.zeros(len(x), np.int64), squared(x, book[0])
    for i in range(1, len(book)):
        apart = squared(x, book[i])
        if apart.dtype != best.dtype:
            best, apart = best.astype(object), apart.astype(object)
        nearer = apart < best
        entry[nearer], best[nearer] = i, apart[nearer]
    return entry, best


def _packed(x: np.ndarray) -> tuple[bytes, bool]:
    wide = bool(x.size) and not (np.abs(x) < 1 << 31).all()
    return x.astype("<i8" if wide else "<i4").tobytes(), wide


def _parts(data: bytes, wide: bool, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i8" if wide else "<i4").reshape(-1, width).astype(np.int64)


def _blocks(found: list[tuple[int, int, int, np.ndarray, np.ndarray]], extra: list | None = None) -> pa.RecordBatch:
    """Rows of blocks from (position, entry, salt, rows, parts)."""
    packed = [_packed(x) for *_, x in found]
    columns = [pa.array([f[i] for f in found], pa.int32()) for i in range(3)]
    columns += [pa.array([len(f[3]) for f in found], pa.int32()), pa.array([f[3].astype("<i8").tobytes() for f in found], pa.binary())]
    columns += [pa.array([p for p, _ in packed], pa.binary()), pa.array([w for _, w in packed], pa.bool_())]
    names = [*OWNER, "members", "rows", "parts", "wide"]
    if extra is not None:
        columns, names = [*columns, pa.array(extra, pa.bool_())], [*names, "moving"]
    return pa.RecordBatch.from_arrays(columns, names)


def _salt(rows: np.ndarray, salts: int) -> np.ndarray:
    return ((rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(salts)


def _by_owner(position: int, entry: np.ndarray, rows: np.ndarray, x: np.ndarray, salts: int) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
    owner = entry * salts + _salt(rows, salts).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    own, first = np.unique(owner[order], return_index=True)
    return [(position, int(o) // salts, int(o) % salts, rows[at], x[at]) for o, at in zip(own, np.split(order, first[1:]))]


def _gathered(dealt: DataFrame, width: int) -> DataFrame:
    """One block of each owner from the pieces dealt to it."""

    def run(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1).to_pylist()[0]
        rows = np.concatenate([np.frombuffer(r, "<i8") for r in group.column("rows").to_pylist()])
        x = np.concatenate([_parts(p, w, width) for p, w in zip(group.column("parts").to_pylist(), group.column("wide").to_pylist())])
        return pa.Table.from_batches([_blocks([(first["position"], first["entry"], first["salt"], rows, x)])])

    return dealt.groupBy(*OWNER).applyInArrow(run, BLOCK)


def _dealt(vectors: DataFrame, books: list[np.ndarray], salts: int, width: int) -> DataFrame:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = unpacked(batch.column("v").to_pylist(), width * len(books))
            rows = batch.column("row").to_numpy()
            out = []
            for position, book in enumerate(books):
                part = x[:, position * width : (position + 1) * width]
                out += _by_owner(position, nearest(part, book)[0], rows, part, salts)
            yield _blocks(out)

    return _gathered(vectors.mapInArrow(run, BLOCK), width)


def _updated(state: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The means of the members of each entry, rounded down; an entry without any stays."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            cells = []
            for r in batch.to_pylist():
                total = summed(_parts(r["parts"], r["wide"], width))
                cells += [(r["position"], r["entry"], j, Decimal(int(t)), r["members"]) for j, t in enumerate(total)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
            columns = list(zip(*cells)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["position", "entry", "component", "total", "n"])

    sums = state.select("position", "entry", "members", "parts", "wide").mapInArrow(run, "position int, entry int, component int, total decimal(38,0), n long")
    out = [b.copy() for b in books]
    totals = sums.groupBy("position", "entry", "component").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))
    for r in totals.collect():  # positions x entries x components of a part
        out[r["position"]][r["entry"], r["component"]] = int(r["total"]) // r["n"]
    return out


def _reassigned(state: DataFrame, books: list[np.ndarray], salts: int, width: int) -> DataFrame:
    """Blocks of members that stay, and (``moving``) of those that change their entry."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for r in batch.to_pylist():
                rows, x = np.frombuffer(r["rows"], "<i8"), _parts(r["parts"], r["wide"], width)
                entry, _ = nearest(x, books[r["position"]])
                away = entry != r["entry"]
                stay = [(r["position"], r["entry"], r["salt"], rows[~away], x[~away])] if not away.all() else []
                go = _by_owner(r["position"], entry[away], rows[away], x[away], salts) if away.any() else []
                yield _blocks(stay + go, [False] * len(stay) + [True] * len(go))

    return state.mapInArrow(run, BLOCK + ", moving boolean")


def _coded(state: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``row, position, entry, distance`` of every part under the final codebooks."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for r in batch.to_pylist():
                entry, distance = nearest(_parts(r["parts"], r["wide"], width), books[r["position"]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["rows"], "<i8")), pa.array(np.full(len(entry), r["position"], np.int32)), pa.array(entry.astype(np.int32)), long_or_null(distance)],
                    ["row", "position", "entry", "distance"],
                )

    return state.select("position", "rows", "parts", "wide").mapInArrow(run, "row long, position int, entry int, distance long")


def trained(vectors: DataFrame, size: int, positions: int, entries: int, rounds: int) -> tuple[list[np.ndarray], DataFrame]:
    """The final codebooks, and the members under the entries that the last round gave them.

    ``vectors`` has ``row, vec_id, v`` and is written already; it holds one row at least.
    """
    width = size // positions
    # Of equal ids the smaller bytes come first; null ids last.
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = unpacked([bytes(r["v"]) for r in first], size)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(positions)]
    salts = max(1, -(-vectors.count() // _MEMBERS))
    state = materialize(_dealt(vectors.select("row", "v"), books, salts, width), "codes-members")
    for i in range(rounds):
        books = _updated(state, books, width)
        if i + 1 == rounds:
            break
        both = materialize(_reassigned(state, books, salts, width), "codes-members")
        came = materialize(_gathered(both.where("moving").drop("moving"), width), "codes-moved")
        state = both.where("not moving").drop("moving").unionAll(came)
    return books, state


def compress(vectors: DataFrame, positions: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector.

    Components are floor(scale * x).  Each position's codebook starts as that part of the ``entries`` smallest ids' vectors; ``rounds``
    times every part goes to the nearest entry, ties to the smaller index, and entries become means, rounded down (those without parts
    stay); then parts are assigned once more.  ``code`` has two hex digits for each position, ``error`` is the sum of the squared
    distances, ``label_error`` its sum over rows of the same label, null ones together.

    Left out are vectors that are null or hold a component that is null, non-finite or beyond 64 bits.  Vectors must have one
    size, a multiple of ``positions``: the size of the smallest id; those of another one are kept with a null code and error, and
    count as no error of their label.  Repeated rows count each, null ids come last.  With fewer vectors than ``entries`` the codebooks
    have as many.  An error beyond 64 bits is null.  Without a ``label`` column all labels are null; further columns are ignored.
    """
    spark = vectors.sparkSession
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = materialize(whole_vectors(vectors, scale, F.col("vec_id").cast("long").alias("vec_id"), label.alias("label")), "codes-vectors")
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("size").head()
    if least is None:
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    size = least["size"]
    if not size or size % positions:
        raise ValueError(f"vectors of {size} components have no {positions} equal parts")
    if entries > 256:
        raise ValueError("an entry's index takes two hex digits")
    books, state = trained(rows.where(F.col("size") == size).select("row", "vec_id", "v"), size, positions, entries, rounds)
    text = ",".join(str(int(c)) for book in books for entry in book for c in entry)
    parts = _coded(state, books, size // positions).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("position", "entry"))).alias("parts"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("error"), F.count("distance").alias("known")
    )
    code = F.array_join(F.transform("parts", lambda p: F.lower(F.lpad(F.hex(p["entry"]), 2, "0"))), "")
    parts = parts.select("row", code.alias("code"), F.when(F.col("known") == positions, long_total(F.col("error"))).alias("error"))
    coded = materialize(rows.select("row", "vec_id", "label", "size").join(parts, "row", "left"), "codes-errors")
    lost = F.count_if((F.col("size") == size) & F.col("error").isNull())
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.when(lost == 0, long_total(F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")))).alias("label_error"))
    both = coded.join(sums, coded["label"].eqNullSafe(sums["_label"]), "left")
    return both.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
