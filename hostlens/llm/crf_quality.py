"""Document quality by a linear-chain conditional random field over lines.

Every line that isn't blank has features of its own and of its two neighbours; the chain labels each good or bad.  It is
fitted on labelled documents, whose label holds for all their lines.  The score of a document is the mean of its lines'
marginals of "good", from forward and backward messages, weighted by the lines' lengths.

Fitting takes a bounded sample: at most ``SAMPLE`` labelled documents of each class, the first by hash of the id, of at most
``SAMPLE_LINES`` lines each.  Scoring takes every line of every document and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm.common import batches

SAMPLE = 1500
SAMPLE_LINES = 500
THRESHOLD = 0.3
_STEPS = 250
_RIDGE = 1e-3
_BATCH_BYTES = 2 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_OWN = 13
#: Own features that a line also shows its neighbours: symbols, pipes, exclamation marks, capitals, repeats, equal lines.
_SHOWN = [2, 3, 4, 5, 7, 8]


def _bytes_in(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SPACES = _bytes_in("\t\n\v\f\r ")
_KINDS = np.stack([
    _bytes_in("#$%&*<>"), _bytes_in("|"), _bytes_in("!"), _bytes_in("".join(map(chr, range(65, 91)))),
    _bytes_in("0123456789"), ~_SPACES,
]).T.astype(np.float64)
_ENDS = _bytes_in(".!?")


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0, dtype=values.dtype)])
    return total[ends] - total[starts]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text.

    Blank lines are left out; a text without any other has one line of length 1.
    """
    data = [t.encode() for t in texts]
    sizes = np.array([len(d) + 1 for d in data])
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    breaks = np.flatnonzero(raw == 10)
    starts, ends = np.r_[0, breaks[:-1] + 1], breaks
    solid = ~_SPACES[raw]
    doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, np.searchsorted(breaks, np.cumsum(sizes) - 1, side="right")]))
    filled = _sums(solid.astype(np.int32), starts, ends) > 0
    none = np.bincount(doc, weights=filled, minlength=len(texts)) == 0
    first = np.r_[True, doc[1:] != doc[:-1]]
    keep = filled | (none[doc] & first)
    starts, ends, doc = starts[keep], ends[keep], doc[keep]
    length = ends - starts
    size = np.maximum(length, 1).astype(np.float64)

    shares = np.stack([_sums(_KINDS[raw, k].astype(np.int32), starts, ends) for k in range(_KINDS.shape[1])], 1) / size[:, None]
    # Words: a hash of the bytes of each, by wrapping sums over powers.
    edge = np.diff(np.r_[False, solid, False].astype(np.int8))
    at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spread = (raw.astype(np.uint64) + np.uint64(11)) * _MULTIPLIER
    spread ^= spread >> np.uint64(29)
    place = np.arange(len(raw), dtype=np.uint64)
    begin = np.zeros(len(raw), np.uint64)
    begin[at] = at.astype(np.uint64)
    begin = np.maximum.accumulate(begin)
    spread *= (place - begin) * np.uint64(2654435761) + np.uint64(0x100000001B3)
    word = _sums(spread, at, to) if len(at) else np.zeros(0, np.uint64)
    line = np.searchsorted(starts, at, side="right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(np.float64)
    again = np.r_[False, (word[1:] == word[:-1]) & (line[1:] == line[:-1])] if len(word) else np.zeros(0, bool)
    repeats = np.bincount(line, weights=again, minlength=len(starts))
    order = np.lexsort((word, line))
    fresh = np.r_[True, (word[order][1:] != word[order][:-1]) | (line[order][1:] != line[order][:-1])] if len(word) else np.zeros(0, bool)
    distinct = np.bincount(line[order], weights=fresh, minlength=len(starts))
    # Equal lines: a line's hash folds its words with their places.
    nth = np.arange(len(at)) - np.r_[0, np.cumsum(words)[:-1]].astype(np.int64)[line] if len(at) else np.zeros(0, np.int64)
    folded = (word ^ (word >> np.uint64(31))) * (nth.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MULTIPLIER
    edges = np.r_[0, np.cumsum(words)].astype(np.int64)
    own = _sums(folded, edges[:-1], edges[1:])
    order = np.lexsort((np.arange(len(own)), own, doc))
    equal = np.zeros(len(own))
    equal[order[1:]] = (own[order][1:] == own[order][:-1]) & (doc[order][1:] == doc[order][:-1])

    many = np.maximum(words, 1)
    feats = np.zeros((len(starts), _OWN))
    feats[:, 0] = 1
    feats[:, 1] = np.log1p(length) / 5
    feats[:, 2:7] = shares[:, :5] * 4
    feats[:, 7] = repeats / many
    feats[:, 8] = equal
    feats[:, 9] = np.minimum(shares[:, 5] * size / many / 10, 4)
    feats[:, 10] = length < 20
    feats[:, 11] = _ENDS[raw[np.maximum(ends - 1, 0)]]
    feats[:, 12] = 1 - distinct / many
    same = doc[1:] == doc[:-1]
    before, after = np.zeros((len(starts), len(_SHOWN))), np.zeros((len(starts), len(_SHOWN)))
    before[1:] = feats[:-1][:, _SHOWN] * same[:, None]
    after[:-1] = feats[1:][:, _SHOWN] * same[:, None]
    return np.hstack([feats, before, after]), np.maximum(length, 1), np.bincount(doc, minlength=len(texts))


FEATURES = _OWN + 2 * len(_SHOWN)


@dataclass
class Model:
    """``emit``: weights of "good" against "bad"; ``move[a, b]``: of state b after a (0 bad, 1 good); ``prior`` without a fit."""

    emit: np.ndarray
    move: np.ndarray
    prior: float | None = None


def _steps(lines: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place in the chain, the texts that have it, and the index of their line there."""
    order = np.argsort(-lines, kind="stable")
    start = (np.cumsum(lines) - lines)[order]
    sizes = -lines[order]
    for t in range(int(lines.max(initial=0))):
        n = np.searchsorted(sizes, -t, side="left")
        yield order[:n], start[:n] + t


def _carry(odds: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Log odds of good after a step of the chain, from log odds before it."""
    return np.logaddexp(odds + move[1, 1], move[0, 1]) - np.logaddexp(odds + move[1, 0], move[0, 0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def messages(emission: np.ndarray, lines: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (the line's own emission included) and backward log odds of "good" of every line."""
    ahead, back = emission.copy(), np.zeros(len(emission))
    every = list(_steps(lines))
    for (_, before), (_, at) in zip(every, every[1:]):
        ahead[at] += _carry(ahead[before[: len(at)]], move)
    for (_, at), (_, after) in zip(every[-2::-1], every[:0:-1]):
        back[at[: len(after)]] = _carry(back[after] + emission[after], move.T)
    return ahead, back


def fit(feats: np.ndarray, lines: np.ndarray, good: np.ndarray) -> Model:
    """Maximum likelihood with a ridge; the classes weigh the same."""
    if not len(good) or good.min() == good.max():
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), float(good.mean()) if len(good) else 0.5)
    weight = np.where(good == 1, 0.5 / (good == 1).sum(), 0.5 / (good == 0).sum())
    label, of = np.repeat(good, lines), np.repeat(weight, lines)
    inner = np.ones(len(label), bool)
    inner[np.cumsum(lines) - lines] = False
    later = np.flatnonzero(inner)
    params = np.zeros(FEATURES + 4)
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, _STEPS + 1):
        emit, move = params[:FEATURES], params[FEATURES:].reshape(2, 2)
        emission = feats @ emit
        ahead, back = messages(emission, lines, move)
        gradient = np.zeros_like(params)
        gradient[:FEATURES] = feats.T @ ((label - _sigmoid(ahead + back)) * of)
        left, right = ahead[later - 1], emission[later] + back[later]
        joint = np.stack([move[a, b] + a * left + b * right for a in (0, 1) for b in (0, 1)], 1)
        joint = np.exp(joint - joint.max(1, keepdims=True))
        joint /= joint.sum(1, keepdims=True)
        seen = np.stack([(label[later - 1] == a) & (label[later] == b) for a in (0, 1) for b in (0, 1)], 1)
        gradient[FEATURES:] = ((seen - joint) * of[later][:, None]).sum(0)
        gradient -= _RIDGE * params
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        params = params + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(params[:FEATURES], params[FEATURES:].reshape(2, 2))


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    if model.prior is not None:
        return np.full(len(texts), model.prior)
    feats, length, lines = line_features(texts)
    ahead, back = messages(feats @ model.emit, lines, model.move)
    doc = np.repeat(np.arange(len(texts)), lines)
    return np.bincount(doc, weights=length * _sigmoid(ahead + back), minlength=len(texts)) / np.bincount(doc, weights=length, minlength=len(texts))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from documents whose id is in the training folds: crc32 of the id as text, modulo 5, isn't 0.

    Null labels and ids are ignored; a document that any row calls good is good.  With one class or none the score is constant: the rate
    of good ones, or 0.5.
    """
    ids = labels.where("quality is not null and doc_id is not null and crc32(cast(cast(doc_id as long) as string)) % 5 <> 0")
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good"))
    drawn = [ids.where(F.col("good") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for g in (0, 1)]
    chosen = F.broadcast(drawn[0].unionAll(drawn[1]))  # at most 2 x sample ids

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, _BATCH_BYTES, "text"):
            feats, _, lines = line_features([t or "" for t in batch.column("text").to_pylist()])
            parts = [x.astype("<f4").tobytes() if n <= SAMPLE_LINES else None for x, n in zip(np.split(feats, np.cumsum(lines)[:-1]), lines)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(parts, pa.binary())], ["doc_id", "good", "feats"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    rows = rows.select("doc_id", "text", F.col("good").cast("int").alias("good")).mapInArrow(run, "doc_id long, good int, feats binary").where("feats is not null")
    found = sorted(rows.orderBy(F.xxhash64("doc_id", "feats")).limit(2 * sample).collect(), key=lambda r: (r["doc_id"], r["feats"]))
    arrays = [np.frombuffer(r["feats"], "<f4").reshape(-1, FEATURES) for r in found]
    if not arrays:
        return fit(np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0))
    return fit(np.concatenate(arrays).astype(np.float64), np.array([len(a) for a in arrays]), np.array([float(r["good"] == 1) for r in found]))


def _scorer(model: Model, text: Callable[[pa.RecordBatch], pa.Array]):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            flat = whole.append_column("_text", text(whole))
            for batch in batches([flat], _BATCH_BYTES, "_text"):
                found = score_texts([t or "" for t in batch.column("_text").to_pylist()], model)
                first = batch.drop_columns(["_text"])
                yield first.append_column("score", pa.array(found, pa.float64()))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row; null and empty texts are scored as one empty line.

    Texts are scored whole, however long; repeated rows and null ids are rows of their own, an empty table gives none, and other columns
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(model, lambda b: b.column("text")), "doc_id long, text string, score double").drop("text")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns as they are (whatever their names).

    Each row is judged by its own whole text, null as an empty line: repeated rows stay or go together, null ids count like others,
    and an empty table stays empty.
    """
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").cast("string").alias("text"))
    kind = T.StructType([*nested.schema.fields, T.StructField("score", T.DoubleType())])
    scored = nested.mapInArrow(_scorer(model, lambda b: b.column("text")), kind)
    return scored.where(F.col("score") >= threshold).select("doc.*")
