"""WARC archives written from and read into chunked record tables.

A payload is written as records of at most ``CHUNK`` bytes: the first names the record, the others continue it by segment
number, as the format provides for.  Archives are gzip text files of Spark's own writer, so any store that Spark
reaches will do: a record is a row, and what follows each record is the writer's line separator.

Reading takes the beginning of the version line for the separator and so gets one record at a time, never a whole file or payload.  The
result is a table of (record, chunk) rows, each with the digest of the payload up to and including its chunk; payloads whose
own bytes hold the separator are put together again from the announced length.  Archives of other writers are read as well: any
record type, header names in any case; an unsegmented record of theirs is cut into chunks once it is read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm.common import batches
from hostlens.session import fresh_path

CHUNK = 1 << 20
#: Payloads found more than once whose digests are broadcast (some 60 bytes each); beyond, pages are shuffled to them.
BROADCAST_DIGESTS = 500_000
_BATCH_BYTES = 8 << 20

# The format's version line, record separator and revisit profile.
MARK = "WARC/1."
VERSION = f"{MARK}1\r\n"
END = "\r\n\r\n"
_HEADER_END = re.compile(rb"\r?\n\r?\n")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _header(kind: str, record: str, length: int, fields: dict[str, object]) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record}>", "Content-Length": length} | fields
    return (VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None) + "\r\n").encode()


def _record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, first: int | None, revisit: bool) -> Iterator[bytes]:
    record = str(uuid.uuid4())
    target = None if url is None else " ".join(url.split())
    about = {"WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{_digest(sha1)}", "Page-ID": page_id, "Payload-Length": len(payload)}
    if revisit:
        yield _header("revisit", record, 0, about | {"WARC-Profile": IDENTICAL, "Refers-To-Page": first})
        return
    chunks = max(1, -(-len(payload) // CHUNK))
    for i in range(chunks):
        part = payload[i * CHUNK : (i + 1) * CHUNK]
        if i == 0:
            yield _header("response", record, len(part), about | ({"WARC-Segment-Number": 1} if chunks > 1 else {})) + part
        else:
            end = {"WARC-Segment-Total-Length": len(payload)} if i == chunks - 1 else {}
            more = {"WARC-Segment-Origin-ID": f"<urn:uuid:{record}>", "WARC-Segment-Number": i + 1}
            yield _header("continuation", str(uuid.uuid4()), len(part), more | end) + part


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives of all pages in the folder ``path``, one record per row.

    Of equal payloads of at least ``least_bytes`` bytes the page of the smallest id is the response and the others revisit it;
    rows that repeat its id are responses as well, and null ids are the largest.  A null payload is empty.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    large = rows.where(F.octet_length("payload") >= least_bytes) if least_bytes else rows
    shared = large.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("sha1", "first", F.lit(True).alias("shared"))
    if shared.count() <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)
    decided = rows.join(shared, "sha1", "left")
    ready = decided.select("page_id", "url", "payload", "sha1", "first", (F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, _BATCH_BYTES, "payload"):
            held: list[bytes] = []
            size = 0
            for values in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "first", "revisit"))):
                for record in _record(*values):
                    held.append(record)
                    size += len(record)
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    records = ready.mapInArrow(run, "record binary")
    writer = records.select(F.col("record").cast("string").alias("value")).write
    writer.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").mode("overwrite").text(path)


CHUNKS = (
    "record_id string, chunk long, type string, page_id long, url string, refers_to long, announced_digest string, "
    "announced_bytes long, bytes_so_far long, digest_so_far string, data binary"
)


def _plain(value: str | None, prefix: str) -> str | None:
    """An identifier or digest without its brackets and scheme."""
    return value if value is None else value.strip("<>").removeprefix(prefix)


class _Reader:
    """Chunk rows from the pieces between version marks, in the order of a file.

    A record may hold version marks itself: its pieces are held until they have the length that its header announced, and joined once.
    Header names are read in any case, and records of any type and either version; what they leave out is null.
    """

    def __init__(self, with_data: bool):
        self.with_data = with_data
        self.held: list[bytes] = []
        self.got = 0
        self.wanted: int | None = None
        self.fields: dict[str, str] = {}
        self.first: dict[str, str] = {}
        self.sum = hashlib.sha1()
        self.size = self.chunk = 0

    def _header(self) -> bool:
        """Reads the header once it is whole; of the pieces then only the block is held."""
        start = MARK.encode().join(self.held)
        found = _HEADER_END.search(start)
        if not found:
            self.held = [start]
            return False
        lines = re.split("\r?\n", start[: found.start()].decode("utf-8", "replace"))[1:]
        self.fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines)}
        self.wanted = int(self.fields["content-length"])
        self.held = [start[found.end() :]]
        self.got = len(self.held[0])
        return True

    def pieces(self, piece: bytes) -> Iterator[tuple]:
        if not self.held and not piece.strip():
            return  # before the first record
        known = self.wanted is not None
        self.held.append(piece)
        if known:
            self.got += len(MARK) + len(piece)
        elif not self._header():
            return
        if self.got < self.wanted:
            return  # the block holds a version mark of its own
        data = MARK.encode().join(self.held)[: self.wanted]
        fields, self.held, self.wanted = self.fields, [], None
        if fields.get("warc-type") != "continuation":
            self.first, self.sum, self.size, self.chunk = fields, hashlib.sha1(), 0, 0
        own = self.first
        number = lambda name: int(own[name]) if name in own else None
        # Segmented archives announce the whole payload; others their block.
        digest = own.get("warc-payload-digest" if "payload-length" in own else "warc-block-digest")
        announced = number("payload-length" if "payload-length" in own else "content-length")
        for at in range(0, max(1, len(data)), CHUNK):
            part = data[at : at + CHUNK]
            self.sum.update(part)
            self.size += len(part)
            self.chunk += 1
            yield (
                _plain(own.get("warc-record-id"), "urn:uuid:"), self.chunk, own.get("warc-type"), number("page-id"), _plain(own.get("warc-target-uri"), ""), number("refers-to-page"),
                _plain(digest, "sha1:"), announced, self.size, _digest(self.sum.digest()), part if self.with_data else None,
            )


def read(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunk table of all archives in ``path``; without ``with_data`` the bytes themselves are left out."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [c.strip().split(" ")[0] for c in CHUNKS.split(",")]
        reader = _Reader(with_data)
        for batch in batches(source, _BATCH_BYTES, "piece"):
            rows = [r for piece in batch.column("piece").to_pylist() for r in reader.pieces(piece)]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        if reader.held:
            raise ValueError("the archive ends within a record")

    pieces = spark.read.schema("value string").option("lineSep", MARK).text(path)
    return pieces.select(F.col("value").cast("binary").alias("piece")).mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record; ``whole`` tells whether the bytes found have the announced number and digest (true for revisits).

    Digests and sizes are those of the full payload; a revisit has those that it announces.
    """
    last = chunks.drop("data").groupBy("record_id").agg(F.max_by(F.struct("type", "page_id", "url", "refers_to", "announced_digest", "announced_bytes", "bytes_so_far", "digest_so_far"), "chunk").alias("r"))
    r = last.select("record_id", "r.*")
    revisit = F.col("type") == "revisit"
    return r.select(
        "record_id", "page_id", "url", F.when(revisit, F.col("announced_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("announced_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to",
        (revisit | ((F.col("bytes_so_far") == F.col("announced_bytes")) & F.coalesce(F.col("digest_so_far") == F.col("announced_digest"), F.lit(True)))).alias("whole"),
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads their records back.

    No pages give no records; other columns of ``pages`` are ignored.
    """
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    return records(read(pages.sparkSession, path, with_data=False))
