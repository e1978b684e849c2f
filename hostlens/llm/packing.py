"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents, in an order drawn by hash and cut into packets of at most ``packet`` tokens.
In each round a source is granted its share of a window in tokens; it sends packets while the credit that it has left
covers them and carries the rest, its deficit, on.  A packet that ends at token e of its queue is therefore sent in round
ceil(e / grant), whatever other queues do: the schedule needs no loop, only prefix sums of lengths per queue, and the
deficits carry over windows and partitions by themselves.  What the rounds send, one after the other, is cut every
``window`` tokens; so every window is full but the last, and holds each source in its share within one packet.

Prefix sums go over blocks (hash ranges of a queue; runs of rounds), so a source with a third of all rows is spread over
tasks.  Only packet lengths are scheduled; ids are written once and meet their pieces by one join on the row key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import batches, blocks_for, keyed, materialize, offsets

WINDOW = 2048
PACKET = 256
#: Closes each document.
END_ID = 1
#: Rounds whose packets are laid out by one task.
ROUNDS = 1024
_DOCS_PER_BLOCK = 20_000
_BATCH_BYTES = 8 << 20


def _pack(ids: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(ids)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``row, doc_id, queue, n, ids`` of every document; ids are packed integers under zstd, with ``end_id`` last."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hostlens.llm.tokens import encoder

        coder = encoder(tokenizer)
        end = end_id.to_bytes(coder.width, "little")
        for batch in batches(source, _BATCH_BYTES, "text"):
            ids = [coder.encode(t or "") + end for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), batch.column("queue"),
                    pa.array([len(x) // coder.width for x in ids], pa.int64()), pa.array(map(_pack, ids), pa.binary()),
                ],
                ["row", "doc_id", "queue", "n", "ids"],
            )

    rows = keyed(docs, F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "row long, doc_id long, queue string, n long, ids binary")


def grants(queues: DataFrame, targets: dict[str, float] | None, window: int) -> DataFrame:
    """``grant``: the tokens of a window that each queue is given per round.

    Without ``targets`` every queue has its share of all tokens, so all run dry together and the mixture holds to
    the end.  Sources that ``targets`` doesn't name are given the least weight named.
    """
    everything = queues.agg(F.sum("tokens").alias("everything"))
    if targets is None:
        share = F.col("tokens") / F.col("everything")
        return queues.join(F.broadcast(everything)).select("queue", (share * window).alias("grant"))
    if not targets or min(targets.values()) <= 0:
        raise ValueError("targets must be positive")
    least = min(targets.values())
    weight = F.coalesce(*[F.when(F.col("queue") == k, F.lit(float(v))) for k, v in targets.items()], F.lit(float(least)))
    weighed = queues.select("queue", weight.alias("weight"))
    total = weighed.agg(F.sum("weight").alias("total"))
    return weighed.join(F.broadcast(total)).select("queue", (F.col("weight") / F.col("total") * window).alias("grant"))


def schedule(meta: DataFrame, targets: dict[str, float] | None = None, window: int = WINDOW, packet: int = PACKET) -> DataFrame:
    """``row, start, length, sequence_id, offset`` of every piece, from ``row, queue, n``."""
    rows = meta.count()
    blocks = blocks_for(rows, _DOCS_PER_BLOCK)
    drawn = F.xxhash64("row")
    placed = meta.select("row", "queue", "n", drawn.alias("drawn"), F.pmod(F.shiftrightunsigned(drawn, 20), F.lit(blocks)).alias("block"))
    totals = placed.groupBy("queue", "block").agg(F.sum("n").alias("tokens"))
    before = offsets(totals, ["queue"], "block", "tokens")
    granted = grants(totals.groupBy("queue").agg(F.sum("tokens").alias("tokens")), targets, window)
    inside = Window.partitionBy("queue", "block").orderBy("drawn", "row").rowsBetween(Window.unboundedPreceding, -1)
    queued = placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)).cast("long"))
    queued = queued.join(before.join(granted, "queue"), ["queue", "block"])
    first = F.col("before") + F.col("inside")
    starts = queued.select("row", "queue", "n", "grant", first.alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(packet).cast("long"))).alias("start"))
    length = F.least(F.lit(packet).cast("long"), F.col("n") - F.col("start"))
    ends = F.col("first") + F.col("start") + length
    packets = starts.select("row", "queue", "start", length.alias("length"), ends.alias("ends"), F.ceil(ends / F.col("grant")).cast("long").alias("round"))
    packets = packets.withColumn("run", F.expr(f"round div {ROUNDS}"))
    # Runs of rounds are few beside rows: one for every window x ROUNDS tokens.
    runs = offsets(packets.groupBy("run").agg(F.sum("length").alias("tokens")), [], "run", "tokens")
    order = Window.partitionBy("run").orderBy("round", "queue", "ends").rowsBetween(Window.unboundedPreceding, -1)
    laid = packets.withColumn("inside", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).join(runs, "run")
    at = laid.select("row", "start", "length", (F.col("before") + F.col("inside")).alias("at"))
    cut = at.select("*", F.explode(F.expr(f"sequence(at div {window}, (at + length - 1) div {window})")).alias("sequence_id"))
    low = F.greatest(F.col("at"), F.col("sequence_id") * window)
    high = F.least(F.col("at") + F.col("length"), (F.col("sequence_id") + 1) * window)
    return cut.select("row", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"), "sequence_id", (low - F.col("sequence_id") * window).alias("offset"))


PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, window: int = WINDOW,
    packet: int = PACKET, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document, with its place in a sequence; with ``with_ids`` also the ids themselves.

    Null or empty texts are documents of ``end_id`` alone; a null source is the queue ''.  Rows with equal ids stay
    documents of their own.  Ties of the drawn order go by row key.  No documents give no pieces; other columns of
    ``docs`` are ignored.
    """
    coded = materialize(tokenize(docs, tokenizer, end_id), "packing-ids")
    pieces = schedule(coded.select("row", "queue", "n"), targets, window, packet)
    per_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hostlens.llm.tokens import encoder

        unpack = zstandard.ZstdDecompressor()
        kind = "<u2" if encoder(tokenizer).width == 2 else "<u4"
        for batch in batches(source, _BATCH_BYTES, "ids"):
            found: list[list] = [[] for _ in range(9 if with_ids else 8)]
            for doc, queue, ids, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "ids", "pieces"))):
                ids = np.frombuffer(unpack.decompress(ids), kind).astype("<u4")
                for p in own:
                    part = ids[p["start"] : p["start"] + p["length"]]
                    for column, value in zip(found, (doc, queue, p["start"], p["length"], zlib.crc32(part.tobytes()), len(ids), p["sequence_id"], p["offset"])):
                        column.append(value)
                    if with_ids:
                        found[8].append(part.astype("i4"))
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], names)

    return coded.select("row", "doc_id", "queue", "ids").join(per_row, "row").mapInArrow(run, schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``sequence_id, n_tokens, ids``: sequences from pieces with ids, padded to ``window``.

    A sequence whose length is a power of two is left as it is.
    """
    parts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    whole = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    missing = F.when(whole, 0).otherwise(F.lit(window) - F.col("n_tokens")).cast("int")
    return parts.select("sequence_id", "n_tokens", F.concat(ids, F.array_repeat(F.lit(pad_id), missing)).alias("ids"))
