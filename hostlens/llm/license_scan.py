"""Fuzzy search for short licence notices: exact seeds, then bounded-error matching.

A text is its words, lower-cased, with one space between.  A notice that may differ in up to k characters is split into k + 1
pieces; within any match at least one piece stands unchanged (pigeonhole), so exact search for pieces finds every candidate
place.  The regex library then verifies the place with the notice's error bound and gives the span and the edits.  Words that
tell a notice from another licence's stand unchanged (they are the exact piece then), errors are for the rest.  Work is
row-local: one pass over each text and a bounded window per candidate.  Of overlapping matches the one of fewest edits stays,
then the first; a window is searched again in what other matches leave of it.
"""

from __future__ import annotations

import heapq
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import batches

_BATCH_BYTES = 8 << 20
#: One error is allowed for so many characters of a notice.
CHARACTERS_PER_ERROR = 10

# Phrases whose exact places are always reported.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Notices searched with errors; what stands in brackets tells them from another licence and takes none.
NOTICES = (
    ("mit", "under the[ mit ]license"),
    ("mit", "under the[ m i t ]license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the[ apache ]license version[ 2 ]0"),
    ("cc-by-nc", "creative commons attribution[ non]commercial"),
    ("cc-by-nc", "licensed under cc by[ nc]"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("gpl", "gnu general public license version"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("mpl-2", "subject to the terms of the[ mozilla ]public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "dedicated to the public domain under[ cc0]"),
    ("cc0", "dedicated to the public domain under[ cc 0]"),
    ("proprietary", "all rights reserved[ no ]part of this publication may be reproduced"),
)
#: Terms of a licence: a match with one that its notice lacks is another licence's.
TERMS = frozenset((b"nc", b"nd", b"sa"))

_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


@dataclass(frozen=True)
class Notice:
    label: str
    #: Runs of the phrase, and whether they stand unchanged.
    runs: tuple[tuple[bytes, bool], ...]
    per_error: int

    @property
    def phrase(self) -> bytes:
        return b"".join(run for run, _ in self.runs)

    @property
    def errors(self) -> int:
        return len(self.phrase) // self.per_error

    def pieces(self) -> list[tuple[int, bytes]]:
        """Offsets and bytes of pieces of which every match holds one: the longest exact run, or errors + 1 pieces of about one length."""
        whole = [(sum(len(x) for x, _ in self.runs[:i]), run) for i, (run, exact) in enumerate(self.runs) if exact]
        if whole:
            return [max(whole, key=lambda x: len(x[1]))]
        n, size = self.errors + 1, len(self.phrase)
        cuts = [i * size // n for i in range(n + 1)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:])]

    def pattern(self) -> regex.Pattern:
        """On word edges; the match with the fewest edits."""
        runs = [regex.escape(run) if exact else rb"(?:%b){e<=%d}" % (regex.escape(run), self.errors) for run, exact in self.runs]
        return regex.compile(rb"(?<=^| )" + b"".join(runs) + rb"(?= |$)", regex.BESTMATCH)


@lru_cache(maxsize=4)
def _prepared(notices: tuple[tuple[str, str], ...], per_error: int) -> list[tuple[Notice, list[tuple[int, bytes]], regex.Pattern]]:
    out = []
    for label, marked in notices:
        runs = tuple((run.encode(), i % 2 == 1) for i, run in enumerate(regex.split(r"[\[\]]", marked)) if run)
        notice = Notice(label, runs, per_error)
        out.append((notice, notice.pieces(), notice.pattern()))
    return out


def _places(text: bytes, part: bytes) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def exact_places(text: bytes, phrases: tuple[tuple[str, str], ...]) -> list[tuple[str, int]]:
    """Label and first word of every place of a phrase in joined words."""
    padded = b" " + text + b" "
    return [(label, padded.count(b" ", 0, at)) for label, phrase in phrases for at in _places(padded, b" " + phrase.encode() + b" ")]


def fuzzy_places(text: bytes, notices: tuple[tuple[str, str], ...], per_error: int) -> list[tuple[str, int, int, int, float, bytes]]:
    """Label, first word, number of words, edits, similarity and text of every match in joined words."""
    out = []
    for notice, pieces, pattern in _prepared(notices, per_error):
        size, slack = len(notice.phrase), notice.errors
        spots = sorted({at - offset for offset, part in pieces for at in _places(text, part)})
        out += [(notice.label, text.count(b" ", 0, a), text.count(b" ", a, b) + 1, edits, 1 - edits / size, text[a:b]) for a, b, edits in _verified(text, notice, pattern, spots, size, slack)]
    return out


def _verified(text: bytes, notice: Notice, pattern: regex.Pattern, spots: list[int], size: int, slack: int) -> list[tuple[int, int, int]]:
    """Start, end and edits of the matches around spots, fewest edits first where they overlap."""
    words, found = frozenset(notice.phrase.split()), []

    def search(low: int, high: int) -> None:
        """Adds the best match of a span between word edges."""
        while high - low >= size - slack:
            match = pattern.search(text, low, high)
            if not match:
                return
            a, b = match.span()
            a, b = a + (text[a : a + 1] == b" "), b - (text[b - 1 : b] == b" ")
            edits = sum(match.fuzzy_counts)
            if edits <= slack and TERMS.isdisjoint(set(text[a:b].split()) - words):
                heapq.heappush(found, (edits, a, b, low, high))
                return
            if edits > slack:
                return
            search(low, a - 1)  # another licence's: what stands beside it
            low = b + 1

    for spot in spots:
        low, high = max(0, spot - slack - 1), max(0, spot + size + slack + 1)
        low, high = text.rfind(b" ", 0, low) + 1, text.find(b" ", high)
        search(low, high if high >= 0 else len(text))
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    while found:
        edits, a, b, low, high = heapq.heappop(found)
        i = bisect(starts, b)
        near = kept[i - 1] if i else None
        if near and near[1] > a:  # overlaps a better match
            if near[:2] != (a, b):
                search(low, min(high, near[0] - 1))
                search(max(low, near[1] + 1), high)
            continue
        i = bisect(starts, a)
        starts.insert(i, a)
        kept.insert(i, (a, b, edits))
    return kept


RESULT = (
    "doc_id long, n_words long, base array<struct<label:string,word:long>>, "
    "matches array<struct<label:string,word:long,words:long,edits:int,similarity:double,found:string>>"
)


def scan(
    docs: DataFrame, base: tuple[tuple[str, str], ...] = BASE, notices: tuple[tuple[str, str], ...] = NOTICES, per_error: int = CHARACTERS_PER_ERROR,
) -> DataFrame:
    """``doc_id, n_words, base, matches`` of every document: exact places of base phrases, and fuzzy matches with their spans in words.

    Null and empty texts have no words and no matches.  Repeated rows and null ids stay rows of their own; other columns are
    ignored.
    """
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    match = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64()), ("found", pa.string())]))
    names = ("label", "word", "words", "edits", "similarity", "found")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, _BATCH_BYTES, "text"):
            counts, exact, fuzzy = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text or "")
                joined = b" ".join(words)
                counts.append(len(words))
                exact.append([{"label": a, "word": b} for a, b in exact_places(joined, base)])
                fuzzy.append([dict(zip(names, (*m[:5], m[5].decode("utf-8", "replace")))) for m in fuzzy_places(joined, notices, per_error)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(exact, place), pa.array(fuzzy, match)], ["doc_id", "n_words", "base", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT)


def summary(found: DataFrame) -> DataFrame:
    """Counts, labels and a score per document: 1 with a base phrase, else the best similarity of its matches, else 0."""
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, fuzzy = F.transform("base", lambda x: x["label"]), F.transform("matches", lambda x: x["label"])
    starts = F.transform("base", lambda x: x["word"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda x: x["similarity"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.concat(base, fuzzy)).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"),
    )
