"""Removal of repeated byte strings by merging the Burrows-Wheeler transforms of shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.  Such a string is a *window*; its key is the
smallest hash of the ``GRAM``-byte strings in it, a function of its content.  Consecutive windows with one key form a
segment, about 140 windows long.

1. Segments are digested.  Keys and digests meet by hash, after copies in a batch of documents are combined: a segment that
   is found twice is repeated throughout; one whose key nothing else has, and itself but once, is not; for the rest bytes
   are compared.
2. The segments left go to bins by key, with one copy of each repeated segment of their key.  A bin is dealt to shards.  A text of
   a shard is read as ``LENGTH`` / ``SYMBOL`` symbols of ``SYMBOL`` bytes from each start; its suffixes are sorted into a transform.
   Transforms are merged two at a time: beginning with all of one before all of the other, each round sends the interleave
   through the stable order of the preceding symbols, so that after h rounds suffixes stand in order of their first h
   symbols, and blocks of equal h-symbol prefixes are split where their sources were.  After the last round a block of two or
   more suffixes is a repeated interval: equal windows.  No suffix is sorted again.
3. A key whose segments exceed a bin is spread over several; windows that are alone in their bin, and one of each block, then
   meet once more by 128-bit digests of their symbols.

Everything is keyed by batches of documents; their texts travel compressed, and nothing depends on how many
documents share a passage but the number of entries per batch.

Texts can be read by words as well: each word becomes a code of ``CODE`` bytes, and the same steps over the codes, one code where a
text has one byte, find the strings of ``LENGTH`` / ``CODE`` words that start twice, however few bytes they have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import Stages, batches, keyed, materialize
from hostlens.llm.words import mix, word_hashes

LENGTH = 400
GRAM = 128
SYMBOL = 80
CODE = 8
_BATCH_BYTES = 4 << 20
_RANGE = 1 << 18
_BIN_BYTES = 1 << 20
_SHARD_BYTES = 1 << 19
_ENTRIES_PER_BUCKET = 1_000_000
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = mix(np.arange(5000, 5016, dtype=np.uint64)) | np.uint64(1)
_ALONE, _REPEATED, _OPEN, _SAMPLE = range(4)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes or codes, from those of powers of two."""
    powers = {1: _BYTE[raw] if raw.itemsize == 1 else raw}
    width, i = 1, 0
    while width * 2 <= size:
        h = powers[width]
        powers[width * 2] = h[: len(h) - width] * _STEP[i] + h[width:] if len(h) > width else h[:0]
        width, i = width * 2, i + 1
    out, done = powers[width], width
    for part in sorted(powers, reverse=True)[1:]:
        while size - done >= part:
            n = max(0, len(raw) - done - part + 1)
            out = out[:n] * _STEP[15] + powers[part][done : done + n]
            done += part
    return out


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        values = pick(values[: len(values) - width], values[width:])
        width *= 2
    rest = size - width
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def window_keys(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of the window that starts at each byte or code, and the keys that stand at two places of a run of windows.

    Equal windows of one run have the key at two places no further apart than a window has grams.
    """
    size = (LENGTH - GRAM) // raw.itemsize + 1
    grams = mix(gram_hashes(raw, GRAM // raw.itemsize))
    keys = _sliding(grams, size, np.minimum)
    edge = np.zeros(size - 1, np.uint64)
    at = np.flatnonzero(grams == _sliding(np.concatenate([edge, keys, edge]), size, np.maximum))
    twice = (grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) <= size)
    return keys, np.unique(grams[at[1:]][twice])


def segments(raw: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Start, number of windows, key and digest of each segment of a text (or of codes), and 1 if it may repeat itself."""
    unit, length = raw.itemsize, LENGTH // raw.itemsize
    for a in range(0, max(0, len(raw) - length + 1), _RANGE):
        part = raw[a : a + _RANGE + length - 1]
        keys, twice = window_keys(part)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        data = part.tobytes()
        ends = np.r_[starts[1:], len(keys)]
        own = np.isin(keys[starts], twice).astype(np.int64) if len(twice) else np.zeros(len(starts), np.int64)
        for s, e, key, itself in zip(starts.tolist(), ends.tolist(), keys[starts].view(np.int64).tolist(), own.tolist()):
            yield a + s, e - s, key, int.from_bytes(hashlib.blake2b(data[s * unit : (e + length - 1) * unit], digest_size=8).digest(), "little", signed=True), itself


def word_codes(text: bytes) -> bytes:
    """The words of a text, each as ``CODE`` bytes."""
    return word_hashes(np.frombuffer(text, np.uint8))[2].astype("<u8").tobytes()


def _segmented(rows: DataFrame, words: bool) -> DataFrame:
    """One row per batch of documents: ids, compressed texts with their sizes, sizes and segments of the strings that are judged.

    These are the texts and then, with ``words``, their codes; all places in the latter are counted in codes.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        zip_ = zstandard.ZstdCompressor(level=3)
        for i, batch in enumerate(batches(source, _BATCH_BYTES, "text")):
            data = [t or b"" for t in batch.column("text").to_pylist()]
            judged = [np.frombuffer(d, np.uint8) for d in data] + [np.frombuffer(word_codes(d), "<u8") for d in data if words]
            found = [(d, *s) for d, string in enumerate(judged) for s in segments(string)]
            columns = list(zip(*found)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task + i], pa.int64()), pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([zip_.compress(b"".join(data))], pa.binary()), *[pa.array([np.array([len(d) for d in x], "<i8").tobytes()], pa.binary()) for x in (data, judged)],
                    *[pa.array([np.array(c, "<i8").tobytes()], pa.binary()) for c in columns],
                ],
                ["batch", "id", "text", "stored", "sizes", "doc", "start", "count", "key", "digest", "itself"],
            )

    schema = "batch long, id array<long>, text binary, stored binary, sizes binary, doc binary, start binary, count binary, key binary, digest binary, itself binary"
    return rows.mapInArrow(run, schema)


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _entries(row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, digest) of a batch by bucket: keys, digests, counts, edges of buckets, and the entry of each segment."""
    key, digest = _ints(row["key"]), _ints(row["digest"])
    bucket = (key.view(np.uint64) >> np.uint64(7)) % np.uint64(buckets)
    order = np.lexsort((digest, key, bucket))
    k, d = key[order], digest[order]
    fresh = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])] if len(k) else np.zeros(0, bool)
    entry = np.empty(len(k), np.int64)
    entry[order] = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    counts = np.diff(np.r_[first, len(k)])
    edges = np.searchsorted(bucket[order][first], np.arange(buckets + 1, dtype=np.uint64))
    return k[first], d[first], counts, edges, entry


def _met(batched: DataFrame, buckets: int) -> DataFrame:
    """``batch, found``: the state of every entry of a batch, and how many segments its key has to compare."""

    def send(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                key, digest, count, edges, _ = _entries(row, buckets)
                own = [i for i in range(buckets) if edges[i] < edges[i + 1]]
                cut = lambda x, i: x[edges[i] : edges[i + 1]].astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own, pa.int32()), pa.array([row["batch"]] * len(own), pa.int64()), pa.array([cut(key, i) for i in own], pa.binary()),
                        pa.array([cut(digest, i) for i in own], pa.binary()), pa.array([(np.minimum(count[edges[i] : edges[i + 1]], 2)).astype("u1").tobytes() for i in own], pa.binary()),
                    ],
                    ["bucket", "batch", "key", "digest", "count"],
                )

    def answer(group: pa.Table) -> pa.Table:
        keys = [_ints(x) for x in group.column("key").to_pylist()]
        key, digest = np.concatenate(keys), np.concatenate([_ints(x) for x in group.column("digest").to_pylist()])
        count = np.concatenate([np.frombuffer(x, "u1") for x in group.column("count").to_pylist()])
        order = np.lexsort((digest, key))
        k, d = key[order], digest[order]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new = new_key | np.r_[True, d[1:] != d[:-1]]
        kind = np.cumsum(new) - 1
        total = np.bincount(kind, weights=count[order])[kind]
        of_key = np.cumsum(new_key) - 1
        several = np.bincount(of_key, weights=new)[of_key]
        state = np.where(total > 1, np.where((several > 1) & new, _SAMPLE, _REPEATED), np.where(several > 1, _OPEN, _ALONE))
        out, many = np.empty(len(k), "u1"), np.empty(len(k), "<i4")
        out[order], many[order] = state, np.minimum(several, 2**31 - 1)
        edges = np.cumsum([len(x) for x in keys])[:-1]
        return pa.table({
            "batch": group.column("batch"), "bucket": group.column("bucket"), "state": pa.array([x.tobytes() for x in np.split(out, edges)], pa.binary()),
            "many": pa.array([x.tobytes() for x in np.split(many, edges)], pa.binary()),
        })

    sent = batched.select("batch", "key", "digest").mapInArrow(send, "bucket int, batch long, key binary, digest binary, count binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "batch long, bucket int, state binary, many binary")
    return answers.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "state", "many"))).alias("found"))


def _states(row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """State of every segment of a batch (one sample only of each entry), and the segments of its key."""
    _, _, _, edges, entry = _entries(row, buckets)
    state, many = np.zeros(edges[-1], "u1"), np.zeros(edges[-1], "i4")
    for x in row["found"] or ():
        at = slice(edges[x["bucket"]], edges[x["bucket"] + 1])
        state[at], many[at] = np.frombuffer(x["state"], "u1"), np.frombuffer(x["many"], "<i4")
    own = state[entry]
    first = np.zeros(len(entry), bool)
    first[np.unique(entry, return_index=True)[1]] = True
    own[(own == _SAMPLE) & ~first] = _REPEATED
    own[(own == _ALONE) & (_ints(row["itself"]) == 1)] = _OPEN
    return own, many[entry]


def _texts(row: dict) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(row["text"]) if len(_ints(row["stored"])) else b""
    ends = np.cumsum(_ints(row["stored"])).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


BIN = "bin long, salt int, spread boolean, coded boolean, batch long, doc int, start long, windows int, bytes binary"


def _shipped(joined: DataFrame, buckets: int, bins: int) -> DataFrame:
    """Segments whose bytes are compared, with their bin."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                state, many = _states(row, buckets)
                sent = np.flatnonzero((state == _OPEN) | (state == _SAMPLE))
                if not len(sent):
                    continue
                texts = _texts(row)
                doc, start, count, key, digest = (_ints(row[c])[sent] for c in ("doc", "start", "count", "key", "digest"))
                strings = {d: texts[d] if d < len(texts) else word_codes(texts[d - len(texts)]) for d in np.unique(doc).tolist()}
                # A key with more segments than a bin takes is spread over bins of its own.
                salts = -(-many[sent].astype(np.int64) * (LENGTH + GRAM) // (2 * _BIN_BYTES))
                spread = salts > 1
                bin_ = np.where(spread, key, (key.view(np.uint64) % np.uint64(bins)).astype(np.int64))
                salt = np.where(spread, (digest.view(np.uint64) % np.maximum(salts, 1).astype(np.uint64)).astype(np.int64), 0)
                coded = doc >= len(texts)
                units = np.where(coded, CODE, 1).tolist()
                data = [strings[d][s * u : (s + c - 1) * u + LENGTH] for d, s, c, u in zip(doc.tolist(), start.tolist(), count.tolist(), units)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bin_), pa.array(salt.astype("i4")), pa.array(spread), pa.array(coded), pa.array([row["batch"]] * len(sent), pa.int64()),
                        pa.array(doc.astype("i4")), pa.array(start.astype("i8")), pa.array(count.astype("i4")), pa.array(data, pa.binary()),
                    ],
                    ["bin", "salt", "spread", "coded", "batch", "doc", "start", "windows", "bytes"],
                )

    return joined.mapInArrow(run, BIN)


# --- transforms ---------------------------------------------------------------


class Transform:
    """Suffixes of a shard's texts in order of their first symbols: places, preceding symbols, and blocks of equal ones.

    Every text is as many strings of symbols as a symbol has bytes, each closed by an end of its own (symbol 0).
    """

    def __init__(self, at: np.ndarray, before: np.ndarray, block: np.ndarray):
        self.at, self.before, self.block = at, before, block

    @classmethod
    def of(cls, symbols: np.ndarray, before: np.ndarray, onward: np.ndarray, places: np.ndarray, rounds: int) -> Transform:
        """Sorted by ``rounds`` symbols: by the last of them first, each time in stable order."""
        chain = [places]
        for _ in range(rounds - 1):
            chain.append(onward[chain[-1]])
        order = np.arange(len(places), dtype=np.int32)
        for step in reversed(chain):
            order = order[np.argsort(symbols[step[order]], kind="stable")]
        differs = np.zeros(len(places), bool)
        for step in chain:
            s = symbols[step[order]]
            differs[1:] |= s[1:] != s[:-1]
        return cls(places[order], before[places[order]], np.cumsum(differs))

    def merged(self, other: Transform, rounds: int) -> Transform:
        """Interleaved with another transform over the same symbols by ``rounds`` refinements."""
        side = np.r_[np.zeros(len(self.at), bool), np.ones(len(other.at), bool)]
        block = np.zeros(len(side), np.int32)
        for _ in range(rounds):
            before = np.empty(len(side), self.before.dtype)
            before[~side], before[side] = self.before, other.before
            order = np.argsort(before, kind="stable")
            s, source = before[order], block[order]
            side = side[order]
            differs = np.r_[False, (s[1:] != s[:-1]) | ((source[1:] != source[:-1]) & (s[1:] != 0))]
            block = np.cumsum(differs, dtype=np.int32)
        at, before = np.empty(len(side), self.at.dtype), np.empty(len(side), self.before.dtype)
        at[~side], at[side] = self.at, other.at
        before[~side], before[side] = self.before, other.before
        return Transform(at, before, block)


def repeated_windows(texts: list[bytes], shard: int = _SHARD_BYTES, unit: int = 1) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each text, which windows are found twice or more in all texts; with two 64-bit digests of all windows.

    The digests are of the windows of all texts, one after the other.  With ``unit`` = ``CODE`` the texts are codes.
    """
    rounds, length, symbol = LENGTH // SYMBOL, LENGTH // unit, SYMBOL // unit
    sizes = np.array([len(t) // unit for t in texts], np.int64)
    hashes = [gram_hashes(np.frombuffer(t, np.uint8 if unit == 1 else "<u8"), symbol) for t in texts]
    # Places: of each text its suffixes of a symbol or more, then an end for each of its strings.
    suffixes = sizes - symbol + 1
    begin = np.cumsum(suffixes + symbol) - suffixes - symbol
    total = int((suffixes + symbol).sum())
    inside = (np.arange(total) - np.repeat(begin, suffixes + symbol)).astype(np.int32)
    real = inside < np.repeat(suffixes, suffixes + symbol)
    raw = np.zeros(total, np.uint64)
    raw[real] = np.concatenate(hashes)
    del hashes
    symbols = np.zeros(total, np.int32)
    symbols[real] = np.unique(raw[real], return_inverse=True)[1].astype(np.int32) + 1
    onward = np.arange(total, dtype=np.int32)
    onward[real] += symbol  # an end follows the last symbol of each string
    before = np.zeros(total, np.int32)
    after = inside >= symbol
    before[after] = symbols[np.flatnonzero(after) - symbol]
    cuts = [0]
    for i in range(1, len(texts)):
        if begin[i] - begin[cuts[-1]] >= shard:
            cuts.append(i)
    edges = [int(begin[i]) for i in cuts] + [total]
    shards = [Transform.of(symbols, before, onward, np.arange(a, b, dtype=np.int32), rounds) for a, b in zip(edges[:-1], edges[1:])]
    while len(shards) > 1:
        shards = [a.merged(b[0], rounds) if b else a for a, *b in (shards[i : i + 2] for i in range(0, len(shards), 2))]
    whole = shards[0]
    again = np.zeros(total, bool)
    again[whole.at] = np.bincount(whole.block)[whole.block] > 1
    windows = np.maximum(sizes - length + 1, 0)
    starts = [np.arange(b, b + n) for b, n in zip(begin.tolist(), windows.tolist())]
    every = np.concatenate(starts)
    one, two = np.zeros(len(every), np.uint64), np.ones(len(every), np.uint64)
    for i in range(rounds):
        part = raw[every + i * symbol]
        one, two = mix(one * _STEP[1] + part), mix(two * _STEP[2] ^ part)
    return [again[s] for s in starts], one, two


# --- spread keys and results --------------------------------------------------


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts


def _by_batch(batch: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    order = np.argsort(batch, kind="stable")
    own, first = np.unique(batch[order], return_index=True)
    packed = np.stack([c[order] for c in columns], 1).astype("<i8")
    return own.tolist(), [x.tobytes() for x in np.split(packed, first[1:])]


MARKS = "batch long, marks binary, bucket int, one binary, two binary, refs binary"


def _compare(buckets: int, unit: int = 1):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("batch", "ascending"), ("doc", "ascending"), ("start", "ascending")])
        batch, doc, start = (group.column(c).to_numpy() for c in ("batch", "doc", "start"))
        again, one, two = repeated_windows(group.column("bytes").to_pylist(), unit=unit)
        marks = [(i, *_runs(a)) for i, a in enumerate(again)]
        which = np.repeat(np.arange(len(again)), [len(s) for _, s, _ in marks])
        at, count = (np.concatenate([m[j] for m in marks]) for j in (1, 2))
        out: dict[str, list] = {k: [] for k in ("batch", "marks", "bucket", "one", "two", "refs")}
        if len(at):
            own, packed = _by_batch(batch[which], doc[which], start[which] + at, count)
            out = {"batch": own, "marks": packed, **{k: [None] * len(own) for k in ("bucket", "one", "two", "refs")}}
        if group.column("spread")[0].as_py():
            # One window of each block, and all that are alone, meet those of the key's other bins.
            flat = np.concatenate(again)
            of = np.repeat(np.arange(len(again)), [len(a) for a in again])
            place = np.concatenate([np.arange(len(a)) for a in again])
            order = np.lexsort((two, one))
            fresh = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
            keep = order[fresh]
            bucket = (one[keep] % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(bucket).tolist():
                k = keep[bucket == b]
                refs = np.stack([batch[of[k]], doc[of[k]], start[of[k]] + place[k], flat[k]], 1).astype("<i8")
                for name, value in (("batch", None), ("marks", None), ("bucket", b), ("one", one[k].tobytes()), ("two", two[k].tobytes()), ("refs", refs.tobytes())):
                    out[name].append(value)
        kinds = {"batch": pa.int64(), "bucket": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    return run


def _meet(group: pa.Table) -> pa.Table:
    """Windows alone in their bins that other bins have as well."""
    one, two = (np.concatenate([np.frombuffer(x, "<u8") for x in group.column(c).to_pylist()]) for c in ("one", "two"))
    refs = np.concatenate([_ints(x).reshape(-1, 4) for x in group.column("refs").to_pylist()])
    order = np.lexsort((two, one))
    fresh = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    kind = np.cumsum(fresh) - 1
    found = order[(np.bincount(kind)[kind] > 1) & (refs[order, 3] == 0)]
    if not len(found):
        return pa.table({"batch": pa.array([], pa.int64()), "marks": pa.array([], pa.binary())})
    own, packed = _by_batch(refs[found, 0], refs[found, 1], refs[found, 2], np.ones(len(found), np.int64))
    return pa.table({"batch": pa.array(own, pa.int64()), "marks": pa.array(packed, pa.binary())})


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept binary, n_repeated_words long"
SPANS = "id long, spans binary, codes binary"


def _gone(row: dict, buckets: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of each string of a batch: the id of its document, its size, and which bytes (or codes) of it go."""
    state, _ = _states(row, buckets)
    whole = (state == _REPEATED) | (state == _SAMPLE)
    spans = np.stack([_ints(row[c])[whole] for c in ("doc", "start", "count")], 1)
    spans = np.concatenate([spans, *[_ints(m).reshape(-1, 3) for m in row["marks"] or ()]])
    sizes = _ints(row["sizes"])
    first = np.cumsum(sizes) - sizes
    edges = np.zeros(int(sizes.sum()) + 1, np.int32)
    np.add.at(edges, first[spans[:, 0]] + spans[:, 1], 1)
    length = np.where(spans[:, 0] < len(row["id"]), LENGTH, LENGTH // CODE)
    np.add.at(edges, first[spans[:, 0]] + spans[:, 1] + spans[:, 2] + length - 1, -1)
    gone = np.cumsum(edges[:-1]) > 0
    for i, f, n in zip(row["id"] * 2, first.tolist(), sizes.tolist()):
        yield i, n, gone[f : f + n]


def _removed(joined: DataFrame, buckets: int) -> DataFrame:
    """What is left of every document, and the number of its repeated words (null where words were not judged)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                out = []
                gone, texts = list(_gone(row, buckets)), _texts(row)
                coded = [int(own.sum()) for _, _, own in gone[len(texts) :]] or [None] * len(texts)
                for (i, n, own), text, again in zip(gone, texts, coded):
                    kept = text if not own.any() else np.frombuffer(text, np.uint8)[~own].tobytes()
                    out.append((i, n, n - len(kept), len(_runs(own)[0]), kept, again))
                columns = list(zip(*out)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "n_bytes", "n_removed", "n_spans", "kept", "n_repeated_words"])

    return joined.mapInArrow(run, RESULT)


def _spans(joined: DataFrame, buckets: int) -> DataFrame:
    """Starts and sizes of the removed runs of texts and of codes, of the documents that have any."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                runs = [np.stack(_runs(own), 1).astype("<i8").tobytes() if own.any() else None for _, _, own in _gone(row, buckets)]
                n = len(row["id"])
                out = [x for x in zip(row["id"], runs[:n], runs[n:] or [None] * n) if any(x[1:])]
                columns = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["id", "spans", "codes"])

    return joined.mapInArrow(run, SPANS)


def _judged(docs: DataFrame, id_column: str, words: bool = False) -> tuple[DataFrame, int]:
    """Batches of documents with all that was found of them, and the number of buckets of their entries."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    batched = materialize(_segmented(rows, words), "suffix-batches")
    total = int(batched.agg(F.sum(F.length("key"))).head()[0] or 0) // 8
    buckets = max(1, -(-total // _ENTRIES_PER_BUCKET))
    met = materialize(_met(batched, buckets), "suffix-states")
    shipping = batched.join(met, "batch")
    compared = F.expr("aggregate(found, 0L, (s, x) -> s + length(replace(replace(hex(x.state), '00', ''), '01', '')))")
    # Hex digits of states 2 and 3, roughly: only the number of bins follows from it.
    bins = max(1, int(met.agg(F.sum(compared)).head()[0] or 0) // 2 * (LENGTH + GRAM) // _BIN_BYTES)
    open_ = _shipped(shipping, buckets, bins)

    def compare(group: pa.Table) -> pa.Table:
        return _compare(buckets, CODE if group.column("coded")[0].as_py() else 1)(group)

    marks = materialize(open_.groupBy("bin", "salt", "spread", "coded").applyInArrow(compare, MARKS), "suffix-marks")
    across = marks.where("bucket is not null").groupBy("bucket").applyInArrow(_meet, "batch long, marks binary")
    found = marks.where("marks is not null").select("batch", "marks").unionAll(across)
    per_batch = found.groupBy("batch").agg(F.collect_list("marks").alias("marks"))
    return batched.join(met, "batch", "left").join(per_batch, "batch", "left"), buckets


def strip(docs: DataFrame, id_column: str = "doc_id", words: bool = False) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` of every document: ``kept`` are the bytes left, as one string.

    Texts are UTF-8 bytes, null ones empty; strings never cross documents and are judged on the input, so every copy of a
    repeated string goes, the first as well.  Texts shorter than ``LENGTH`` stay whole.  Repeated rows and null ids are
    documents of their own.  Other columns are ignored.

    With ``words``, ``n_repeated_words`` follows: how many of a document's words (cut at ASCII white space) stand in runs of
    ``LENGTH`` / ``CODE`` words that also start anywhere else, however few bytes they have.  It changes nothing of what is removed.
    """
    left = _removed(*_judged(docs, id_column, words))
    return left if words else left.drop("n_repeated_words")


def _cut(texts: pd.Series, spans: pd.Series, codes: pd.Series) -> pd.Series:
    """Texts without their spans of bytes and their runs of words; white space around cut words stays."""
    out = []
    for text, cut, coded in zip(texts, spans, codes):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        left = np.ones(len(data), bool)
        for start, size in _ints(cut or b"").reshape(-1, 2).tolist():
            left[start : start + size] = False
        if coded is not None:
            starts, ends, _ = word_hashes(data)
            for start, size in _ints(coded).reshape(-1, 2).tolist():
                left[starts[start] : ends[start + size - 1]] = False
        out.append(data[left].tobytes().decode("utf-8", "ignore"))
    return pd.Series(out, dtype=object)


def clean(docs: DataFrame, words: bool = False) -> DataFrame:
    """``docs`` with repeated strings cut from ``text`` (bytes of split characters are dropped) and ``n_chars`` set anew.

    With ``words``, runs of ``LENGTH`` / ``CODE`` words (cut at ASCII white space, whatever stands between them) that also start
    anywhere else go as well; both are judged on the input.

    Every row stays, if empty; other columns stay as they are, whatever their names.  Null and empty texts stay as they are, repeated
    rows are texts of their own, and so equal texts of ``LENGTH`` bytes or more end up empty.  Only the rows and
    the cut spans stay written.
    """
    nested = materialize(keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "suffix-documents")
    with Stages() as own:
        judged, buckets = _judged(nested.select("row", F.col("doc.text").alias("text")), "row", words)
        found = own.result(_spans(judged.drop("text"), buckets), "suffix-spans")
    both = nested.join(found.withColumnRenamed("id", "row"), "row", "left")
    hit = F.col("spans").isNotNull() | F.col("codes").isNotNull()
    cut = F.pandas_udf(_cut, "string")(F.when(hit, F.col("doc.text").cast("string")).otherwise(""), "spans", "codes")
    text = F.when(hit, cut).otherwise(F.col("doc.text"))
    both = both.select("doc", text.alias("text"))
    fixed = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})
    return both.select(*[fixed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
