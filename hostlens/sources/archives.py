"""Lines of landed files, zip archives included, as a Spark data source.

Hadoop's codecs read plain, gzip and bzip2 files, but would take a zip archive for garbage lines.  Here every member of an archive is a
partition of its own and streams through the decompressor as Arrow batches: neither a member nor its text is ever held whole.
With ``head`` only first lines are read, so the headers of any number of files are one small job.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import json
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import ExitStack
from dataclasses import dataclass
from typing import IO
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "landed_lines"
SCHEMA = "path string, member string, line long, value string"
#: Text bytes, and lines, of an Arrow batch.
_BATCH_BYTES = 4 << 20
_BATCH_LINES = 50_000


def opened(path: str, stack: ExitStack) -> IO[bytes]:
    """A landed file as a seekable stream, from any store that Arrow knows; a path without a scheme is local."""
    from pyarrow import fs

    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return stack.enter_context(open(unquote(parsed.path) if parsed.scheme else path, "rb"))
    store, place = fs.FileSystem.from_uri(path)
    return stack.enter_context(store.open_input_file(place))


def is_zip(path: str) -> bool:
    return path.lower().endswith(".zip")


def _members(path: str) -> list[str]:
    """Names of an archive's files, in its own order; folders and the resource forks of some packers are none."""
    with ExitStack() as stack:
        try:
            archive = stack.enter_context(zipfile.ZipFile(opened(path, stack)))
        except zipfile.BadZipFile as problem:
            raise ValueError(f"{path} is no zip archive: {problem}") from problem
        infos = [i for i in archive.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX/")]
        locked = [i.filename for i in infos if i.flag_bits & 1]
        if locked:
            raise ValueError(f"{path} holds encrypted members: {', '.join(locked)}")
        return [i.filename for i in infos]


def _stream(path: str, member: str, stack: ExitStack) -> IO[bytes]:
    if member:
        return stack.enter_context(stack.enter_context(zipfile.ZipFile(opened(path, stack))).open(member))
    raw = opened(path, stack)
    low = path.lower()
    if low.endswith(".gz"):
        return stack.enter_context(gzip.open(raw, "rb"))
    return stack.enter_context(bz2.open(raw, "rb")) if low.endswith(".bz2") else raw


@dataclass
class Part(InputPartition):
    """One member of an archive, or one plain or compressed file (no member)."""

    path: str
    member: str


class _Reader(DataSourceReader):
    def __init__(self, files: list[str | list[str]], head: bool):
        self.files, self.head = files, head

    def partitions(self) -> Sequence[InputPartition]:
        parts = []
        for file in self.files:
            if isinstance(file, str):
                parts += [Part(file, m) for m in (_members(file) if is_zip(file) else [""])]
            else:
                parts.append(Part(*file))
        return parts or [Part("", "")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with ExitStack() as stack:
            # Universal line ends and replaced malformed bytes, as Spark's own text source has them.
            lines = io.TextIOWrapper(_stream(part.path, part.member, stack), encoding="utf-8", errors="replace", newline=None)
            held, size, at = [], 0, 0
            for line in lines:
                held.append(line[:-1] if line.endswith("\n") else line)
                size += len(line)
                if self.head or size >= _BATCH_BYTES or len(held) >= _BATCH_LINES:
                    yield self._batch(part, at, held)
                    if self.head:
                        return
                    held, size, at = [], 0, at + len(held)
            if held:
                yield self._batch(part, at, held)

    @staticmethod
    def _batch(part: Part, at: int, held: list[str]) -> pa.RecordBatch:
        n = len(held)
        columns = [pa.array([part.path] * n), pa.array([part.member] * n), pa.array(range(at, at + n), pa.int64()), pa.array(held, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["path", "member", "line", "value"])


class LandedLines(DataSource):
    """``path, member, line, value`` of the files that the option ``files`` names: a JSON list of paths, or of paths with a member."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]), self.options.get("head", "false") == "true")


def lines(spark: SparkSession, files: Sequence[str | tuple[str, str]], head: bool = False) -> DataFrame:
    """``path, member, line, value``: every line (or the first one) of the files, members of archives each by themselves.

    A file is a path, whose members are found if it is an archive, or a path and a member.
    """
    spark.dataSource.register(LandedLines)
    return spark.read.format(FORMAT).option("files", json.dumps(list(files))).option("head", str(head).lower()).load()


def headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[tuple[str, str]]]:
    """The (path, member) pairs by the column names of their first line: one job, one line of each file."""
    found: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for r in lines(spark, paths, head=True).orderBy("path", "member").collect():
        names = next(csv.reader([r["value"].removeprefix("﻿")]), [])
        found.setdefault(tuple(names), []).append((r["path"], r["member"]))
    return found


def unique_names(names: tuple[str, ...]) -> list[str]:
    """Column names to read by: the first of equal ones keeps its name, the others get their place."""
    return [n if n and n not in names[:i] else f"_{i}" for i, n in enumerate(names)]


def csv_rows(spark: SparkSession, paths: list[str], schema: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows of CSV members under Spark's own parser, so that an archive, a gzip file and a plain file give equal rows.

    With a ``schema`` files have no header.  Else the first line names the columns, of which ``columns`` are kept, as text (null where a
    file lacks one); files of one header are one branch of the plan.  ``path`` and ``member`` come along.
    """
    if schema is not None:
        return lines(spark, paths).where("value <> ''").select("path", "member", F.from_csv("value", schema).alias("r")).select("path", "member", "r.*")
    out = None
    for names, members in headers(spark, paths).items():
        own = unique_names(names)
        rows = lines(spark, members).where("line > 0 and value <> ''")
        read = F.from_csv("value", ", ".join(f"`{n}` string" for n in own))
        part = rows.select("path", "member", read.alias("r")).select("path", "member", *[(F.col(f"r.`{c}`") if c in own else F.lit(None).cast("string")).alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    empty = ", ".join(["path string", "member string", *[f"`{c}` string" for c in columns]])
    return spark.createDataFrame([], empty) if out is None else out
