"""Log-probabilities of texts under an interpolated modified Kneser-Ney model of word n-grams.

1. Texts become batches of token hashes, written once.  A very long text is several pieces, each with the words before it.
2. Counting, from the highest order down.  A batch sends each of its n-grams once, with its count, to a shard of hashes.  A shard is
   written to the shared folder as sorted hash arrays: n-grams found once, and the others with their count and the first batch that
   holds them (their owner).
3. Lower orders count by how many different words stand before an n-gram.  The owner of an n-gram, and it alone, adds one to the n-gram
   without its first word, and to the statistics of the n-gram without its last: so each batch maps the shards of the order
   above, looks up what it owns, and sends sums.
4. Discounts come from the counts of counts of each order.  Scoring maps the shards again; a batch looks up its distinct n-grams by
   binary search, in order of hashes, so only touched pages are read.

A shard is a range of hashes, so no word, however frequent, is more than one entry per batch, and the numbers that
reach the driver are a few per order.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from io import BytesIO
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import keyed, materialize, utf8
from hostlens.llm.words import mix, word_hashes
from hostlens.session import fresh_path

#: Words of an n-gram.
ORDER = 2
#: Text bytes of a batch, and those hashed at once.
_BATCH_BYTES = 4 << 20
_PART_BYTES = 1 << 20
_ENTRIES_PER_SHARD = 1_000_000
_START, _END = mix(np.array([11, 13], np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


# --- token batches ------------------------------------------------------------


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """The text, cut at white space after about ``size`` bytes; one part at least."""
    at = 0
    while True:
        found = _SPACE.search(text, at + size)
        if not found:
            yield text[at:]
            return
        yield text[at : found.start()]
        at = found.start()


class _Pieces:
    """Pieces of documents whose words are hashed together."""

    def __init__(self, order: int, part_bytes: int):
        self.order, self.part_bytes, self.size, self.waiting = order, part_bytes, 0, 0
        self.rows: list[tuple[int, int | None, bool, np.ndarray]] = []
        self.words: list[list[np.ndarray]] = []
        self.closed: list[bool] = []
        self.pending: list[tuple[int, bytes]] = []

    def open(self, row: int, doc: int | None, learn: bool, before: np.ndarray) -> None:
        self.rows.append((row, doc, learn, before))
        self.words.append([])
        self.closed.append(False)

    def add(self, part: bytes) -> None:
        self.pending.append((len(self.rows) - 1, part))
        self.size += len(part)
        self.waiting += len(part)
        if self.waiting >= self.part_bytes:
            self.hash()

    def hash(self) -> None:
        if self.pending:
            starts, _, words = word_hashes(np.frombuffer(b"\n".join(p for _, p in self.pending), np.uint8), lower=True)
            edges = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for _, p in self.pending]))
            for (i, _), a, b in zip(self.pending, edges[:-1], edges[1:]):
                self.words[i].append(words[a:b])
        self.pending, self.waiting = [], 0

    def last_words(self) -> np.ndarray:
        self.hash()
        return np.concatenate([self.rows[-1][3], *self.words[-1]])[1 - self.order :]

    def batch(self, number: int) -> pa.RecordBatch:
        self.hash()
        tokens = [np.concatenate([*w, [_END]] if c else w).astype(np.uint64) for w, c in zip(self.words, self.closed)]
        words, ids = np.unique(np.concatenate(tokens), return_inverse=True)
        zip_ = zstandard.ZstdCompressor(level=1)
        values = [
            number, [r[0] for r in self.rows], [r[1] for r in self.rows], [r[2] for r in self.rows], [len(t) for t in tokens], [bool(c and o) for c, o in zip(self.closed, self._opened())],
            np.concatenate([r[3] for r in self.rows]).tobytes(), zip_.compress(_planes(words)), zip_.compress(_planes(ids.astype("<u4"))), len(words), len(ids),
        ]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in TOKENS.split(", ")])

    def _opened(self) -> list[bool]:
        """Whether each piece begins its document."""
        return [bool((r[3] == _START).all()) for r in self.rows]


TOKENS = "batch long, row array<long>, id array<long>, learn array<boolean>, size array<long>, whole array<boolean>, before binary, words binary, ids binary, n_words long, n_tokens long"


def _planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second ones: sorted values and small ones compress well so."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _values(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def tokenized(docs: DataFrame, learn: Column, order: int = ORDER, batch_bytes: int = _BATCH_BYTES, part_bytes: int = _PART_BYTES) -> DataFrame:
    """Batches of tokens, written once; ``learn`` marks the rows that count (null: not)."""
    if order < 2:
        raise ValueError("a model has two orders at least")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 16
        start = np.full(order - 1, _START)
        found = _Pieces(order, part_bytes)
        for batch in source:
            for row, doc, learned, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "learn", "text"))):
                before = start
                found.open(row, doc, learned, before)
                for i, part in enumerate(_parts(text, part_bytes)):
                    if i and found.size >= batch_bytes:  # the document goes on in the next batch
                        before = found.last_words()
                        yield found.batch(number)
                        number, found = number + 1, _Pieces(order, part_bytes)
                        found.open(row, doc, learned, before)
                    found.add(part)
                found.closed[-1] = True
                if found.size >= batch_bytes:
                    yield found.batch(number)
                    number, found = number + 1, _Pieces(order, part_bytes)
        if found.rows:
            yield found.batch(number)

    rows = keyed(docs, F.col("doc_id").cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), utf8("text").alias("text"))
    return materialize(rows.mapInArrow(run, TOKENS), "lm-tokens")


def _each(rows: pa.RecordBatch) -> Iterator[dict]:
    """One batch of tokens at a time."""
    for i in range(rows.num_rows):
        yield rows.slice(i, 1).to_pylist()[0]


class _Tokens:
    """A batch read back: n-gram hashes that end at each place, and the places that are tokens."""

    def __init__(self, row: dict, order: int):
        unzip = zstandard.ZstdDecompressor()
        words, ids = (unzip.decompress(row[c]) if row["n_tokens"] else b"" for c in ("words", "ids"))
        sizes = np.array(row["size"], np.int64)
        lead = order - 1
        begin = np.cumsum(sizes + lead) - sizes - lead
        total = int((sizes + lead).sum())
        self.piece = np.repeat(np.arange(len(sizes)), sizes + lead)
        inside = np.arange(total) - begin[self.piece]
        self.target = inside >= lead
        self.known = inside >= lead - 1  # tokens, and what stands before the first
        flat = np.empty(total, np.uint64)
        flat[~self.target] = np.frombuffer(row["before"], "<u8")
        if row["n_tokens"]:
            flat[self.target] = _values(words, "<u8")[_values(ids, "<u4")]
        self.learn = self.target & np.array(row["learn"], bool)[self.piece]
        self.grams = [flat]
        for _ in range(order - 1):
            longer = np.zeros(total, np.uint64)
            longer[1:] = mix(self.grams[-1][:-1] * _STEP + flat[1:])
            self.grams.append(longer)

    def of(self, n: int) -> np.ndarray:
        return self.grams[n - 1]


# --- shards -------------------------------------------------------------------


def _path(uri: str) -> str | None:
    """The path of a folder that is mounted here."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def save(uri: str, values: np.ndarray) -> None:
    """Written aside and renamed, so that a task that is run again leaves the same file."""
    aside, path = f"{uri}.{uuid.uuid4().hex}", _path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_path(aside), "wb") as file:
            np.save(file, values)
        os.replace(_path(aside), path)
        return
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(uri)
    held = BytesIO()
    np.save(held, values)
    with store.open_output_stream(place + aside[len(uri) :]) as file:
        file.write(held.getvalue())
    store.move(place + aside[len(uri) :], place)


def mapped(uri: str) -> np.ndarray:
    """Memory-mapped where the folder is mounted; else one shard is read."""
    path = _path(uri)
    if path:
        return np.load(path, mmap_mode="r")
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(uri)
    with store.open_input_file(place) as file:
        return np.load(BytesIO(file.read()))


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


@dataclass
class Level:
    """One order: where its shards are, and its sums."""

    n: int
    folder: str
    shards: int
    #: Columns beside the hashes.
    columns: tuple[str, ...]
    sums: dict[str, int] = field(default_factory=dict)
    #: Shards without any hash, which have no files.
    empty: frozenset[int] = frozenset()
    discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)

    def find(self, hashes: np.ndarray, *columns: str) -> list[np.ndarray]:
        """The columns for sorted distinct hashes; 0 for those unknown."""
        out = [np.zeros(len(hashes), np.float64 if c == "backoff" else np.int64) for c in columns]
        edges = np.searchsorted(_shard_of(hashes, self.shards), np.arange(self.shards + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            if s in self.empty:
                continue
            own = slice(edges[s], edges[s + 1])
            wanted = hashes[own]
            keys = mapped(f"{self.folder}/{s}-hash.npy")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == wanted)
                for o, c in zip(out, columns):
                    o[own][hit] = mapped(f"{self.folder}/{s}-{c}.npy")[at[hit]]
            if "once" in self.columns:
                once = mapped(f"{self.folder}/{s}-once.npy")
                if len(once):
                    at = np.minimum(np.searchsorted(once, wanted), len(once) - 1)
                    hit = np.flatnonzero(once[at] == wanted)
                    for o, c in zip(out, columns):
                        o[own][hit] = 1 if c == "count" else -1  # whoever has it owns it
        return out


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def _discounted(count: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *discounts])[np.minimum(count, 3)], 0.0)


#: Of an n-gram: different words before it, tokens after it, different ones found after it once, twice and more often, occurrences.
_FIELDS = {"count": "<u4", "total": "<u8", "n1": "<u4", "n2": "<u4", "n3": "<u4", "raw": "<u4"}
_SUMS = ["types", "counted", "c1", "c2", "c3", "c4", "c3_more", "raw", "raw_types"]


def _send(batch: dict, order: int, level: Level, above: Level | None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The distinct n-grams of a level that a batch knows something of, sorted."""
    tokens = _Tokens(batch, order)
    if above is None:
        hashes, counts = np.unique(tokens.of(level.n)[tokens.learn], return_counts=True)
        return hashes, {"count": counts}
    places = np.flatnonzero(tokens.learn)
    longer, first = np.unique(tokens.of(above.n)[places], return_index=True)
    count, owner = above.find(longer, "count", "owner")
    mine = np.flatnonzero((count > 0) & ((owner == batch["batch"]) | (owner == -1)))
    at, count = places[first[mine]], count[mine]
    suffix, prefix = tokens.of(level.n)[at], tokens.of(level.n)[at - 1]
    own = tokens.of(1)[places] if level.n == 1 else suffix[:0]
    hashes, which = np.unique(np.concatenate([suffix, prefix, own]), return_inverse=True)
    n = len(hashes)
    behind, before = which[: len(at)], which[len(at) : 2 * len(at)]
    found = {"count": np.bincount(behind, minlength=n), "total": np.bincount(before, weights=count, minlength=n)}
    for i, some in enumerate((count == 1, count == 2, count > 2), 1):
        found[f"n{i}"] = np.bincount(before[some], minlength=n)
    if level.n == 1:
        found["raw"] = np.bincount(which[2 * len(at) :], minlength=n)
    return hashes, found


def _counted(tokens: DataFrame, order: int, level: Level, above: Level | None) -> Level:
    """Writes the shards of a level, and sums it up."""
    names = ["count"] if above is None else [f for f in _FIELDS if f != "raw" or level.n == 1]

    def send(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            for batch in _each(rows):
                hashes, found = _send(batch, order, level, above)
                edges = np.searchsorted(_shard_of(hashes, level.shards), np.arange(level.shards + 1, dtype=np.uint64))
                own = np.flatnonzero(np.diff(edges)).tolist()
                cut = lambda x, kind: pa.array([_planes(x[edges[s] : edges[s + 1]].astype(kind)) for s in own], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array([batch["batch"]] * len(own), pa.int64()), cut(hashes, "<u8"), *[cut(found[f], _FIELDS[f]) for f in names]],
                    ["shard", "batch", "hash", *names],
                )

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("batch")
        shard = f"{level.folder}/{group.column('shard')[0].as_py()}"
        pieces = [_values(x, "<u8") for x in group.column("hash").to_pylist()]
        owner = np.repeat(group.column("batch").to_numpy(), [len(p) for p in pieces])
        hashes = np.concatenate(pieces)
        del pieces
        # An n-gram's owner is the first batch that has it behind a word.
        fields = {f: np.concatenate([_values(x, _FIELDS[f]) for x in group.column(f).to_pylist()]).astype(np.int64) for f in names}
        order_ = np.lexsort((fields["count"] == 0, hashes))
        hashes = hashes[order_]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        sums = {f: np.add.reduceat(x[order_], first) for f, x in fields.items()}
        del fields
        hashes, owner, count = hashes[first], owner[order_][first], sums["count"]
        if above is None:
            once = count == 1
            save(f"{shard}-once.npy", hashes[once])
            save(f"{shard}-hash.npy", hashes[~once])
            save(f"{shard}-count.npy", _narrow(count[~once]))
            save(f"{shard}-owner.npy", _narrow(owner[~once]))
        else:
            total = sums["total"]
            kept = sum(d * sums[f"n{i}"] for i, d in enumerate(above.discounts, 1))
            columns = {"hash": hashes, "count": _narrow(count), "total": _narrow(total), "backoff": kept / np.maximum(total, 1)}
            columns |= {"raw": _narrow(sums["raw"])} if level.n == 1 else {"owner": _narrow(owner)}
            for name, values in columns.items():
                save(f"{shard}-{name}.npy", values)
        raw = sums.get("raw", count[:0])
        found = [len(first), count.sum(), *[(count == i).sum() for i in (1, 2, 3, 4)], (count > 2).sum(), raw.sum(), (raw > 0).sum()]
        return pa.table({n: pa.array([int(x)], pa.int64()) for n, x in zip(["shard", *_SUMS], [group.column("shard")[0].as_py(), *found])})

    sent = tokens.mapInArrow(send, ", ".join(["shard int", "batch long", "hash binary", *[f"{f} binary" for f in names]]))
    done = materialize(sent.groupBy("shard").applyInArrow(merge, ", ".join(f"{s} long" for s in ["shard", *_SUMS])), "lm-sums")
    sums = done.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in _SUMS]).head().asDict()
    every = tokens.sparkSession.range(level.shards).withColumnRenamed("id", "shard")
    empty = frozenset(r["shard"] for r in every.join(done, "shard", "left_anti").collect())  # none but of very few texts
    return Level(level.n, level.folder, level.shards, level.columns, sums, empty, discounts(*[sums[f"c{i}"] for i in (1, 2, 3, 4)]))


def discounts(c1: int, c2: int, c3: int, c4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from the counts of counts; the usual stand-ins where those say nothing."""
    if min(c1, c2, c3, c4) > 0:
        y = c1 / (c1 + 2 * c2)
        found = (1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3)
        if all(0 < d <= i for i, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


@dataclass
class Model:
    """Levels of order 1, 2, ..., the highest last."""

    levels: list[Level]

    @property
    def order(self) -> int:
        return len(self.levels)

    @property
    def train_tokens(self) -> int:
        return self.levels[0].sums["raw"]

    @property
    def train_types(self) -> int:
        return self.levels[0].sums["raw_types"]


def train(tokens: DataFrame, order: int = ORDER) -> Model:
    """The model of the marked rows of ``tokenized`` texts; its shards are in the session's shared folder."""
    folder = fresh_path(tokens.sparkSession, "lm-model")
    some = tokens.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words")).head()
    levels: list[Level] = []
    above = None
    for n in range(order, 0, -1):
        entries = (some["words"] if n == 1 else some["tokens"]) or 0
        columns = ("once",) if n == order else ()
        above = _counted(tokens, order, Level(n, f"{folder}/{n}", max(1, -(-entries // _ENTRIES_PER_SHARD)), columns), above)
        levels.insert(0, above)
    return Model(levels)


SCORES = "row long, id long, learn boolean, whole boolean, n_tokens long, n_known long, base_score double, score double"


def _probabilities(tokens: _Tokens, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the probability, and how often it was met in training."""
    places = np.flatnonzero(tokens.target)
    one = model.levels[0]
    hashes, which = np.unique(tokens.of(1)[tokens.known], return_inverse=True)
    back = np.full(len(tokens.known), -1)
    back[tokens.known] = which
    count, raw, total, backoff = one.find(hashes, "count", "raw", "total", "backoff")
    everything = one.sums["counted"]
    kept = sum(d * one.sums[c] for d, c in zip(one.discounts, ("c1", "c2", "c3_more")))
    unseen = (kept / everything if everything else 1.0) / (model.train_types + 1)
    p = (_discounted(count, one.discounts) / max(everything, 1) + unseen)[back[places]]
    for level in model.levels[1:]:
        # The n-gram without its last word, found at the place before, was looked up with the order below.
        all_, left = total[back[places - 1]], backoff[back[places - 1]]
        if level.n < model.order:
            hashes, which = np.unique(tokens.of(level.n)[tokens.known], return_inverse=True)
            back = np.full(len(tokens.known), -1)
            back[tokens.known] = which
            count, total, backoff = level.find(hashes, "count", "total", "backoff")
            seen = count[back[places]]
        else:
            hashes, which = np.unique(tokens.of(level.n)[places], return_inverse=True)
            seen = level.find(hashes, "count")[0][which]
        p = np.where(all_ > 0, _discounted(seen, level.discounts) / np.maximum(all_, 1) + left * p, p)
    word, inverse = np.unique(tokens.of(1)[places], return_inverse=True)
    return p, one.find(word, "raw")[0][inverse]


def score(tokens: DataFrame, model: Model) -> DataFrame:
    """``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``tokenized`` texts.

    Scores are sums of log10 over the words and one end: ``score`` of the model, ``base_score`` of single words with 0.1 added to
    each count (and one unknown word).
    """
    n, v = model.train_tokens, model.train_types

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            for batch in _each(rows):
                tokens = _Tokens(batch, model.order)
                p, raw = _probabilities(tokens, model)
                piece, pieces = tokens.piece[tokens.target], len(batch["row"])
                base = np.log10((raw + 0.1) / (n + 0.1 * (v + 1)))
                sums = [np.bincount(piece, weights=w, minlength=pieces) for w in (raw > 0, base, np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch["row"], pa.int64()), pa.array(batch["id"], pa.int64()), pa.array(batch["learn"], pa.bool_()), pa.array(batch["whole"], pa.bool_()),
                        pa.array(batch["size"], pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                    ],
                    [c.split()[0] for c in SCORES.split(", ")],
                )

    found = materialize(tokens.mapInArrow(run, SCORES), "lm-scores")
    sums = ("n_tokens", "n_known", "base_score", "score")
    cut = found.where("not whole").groupBy("row").agg(F.first("id").alias("id"), F.first("learn").alias("learn"), *[F.sum(s).alias(s) for s in sums])
    columns = [F.col("id").alias("doc_id"), F.col("learn").alias("learned"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"]
    return found.where("whole").select(columns).unionAll(cut.select(columns))


def evaluate(docs: DataFrame, learn: Column, order: int = ORDER) -> DataFrame:
    """The scores of all ``docs`` under a model learned from those that ``learn`` holds for (see ``score``).

    Words are runs of characters other than ASCII white space, with A-Z lowered.  A null, empty or blank text is an end alone.  Repeated
    rows and null ids count and are scored as rows of their own; long texts are scored in pieces that know the words before
    them.  Without rows to learn from every token has probability 1 / (0 + 1).  Other columns are ignored, whatever their names.
    """
    tokens = tokenized(docs, learn, order)
    return score(tokens, train(tokens, order))
