"""BPE encoding and decoding in batched numpy merge rounds.

A batch of texts is one flat array of code points.  Words are found by character classes, and equal words by a 64-bit hash
of each; each distinct word that the worker doesn't know yet is merged once.  Their symbols stand in one flat array; a round
looks the adjacent pairs up by binary search over the sorted pair keys, merges the pair of lowest rank in every word at
once, and takes finished words out.  Nothing is shuffled: the work per row follows its text alone.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase
from tokenizers.pre_tokenizers import Split

from hostlens.llm.common import batches
from hostlens.llm.tokens import byte_symbols

_BATCH_BYTES = 3 << 20
#: Distinct words whose ids a worker keeps; then it begins anew.
KNOWN_WORDS = 400_000
#: Longer words are merged by themselves, not looked up by hash.
_LONGEST_HASHED = 200
_NONE = np.int64(1 << 40)
_RARE = regex.compile(r"[\u0530-\U0010ffff]")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_BASE = 0x9E3779B97F4A7C15

# The split pattern of the vocabularies that this module can encode.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point: white space, letter, number or other."""
    # The library's own classes: versions of Unicode differ in what is a letter.
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)], np.uint32)
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\s+", _SPACE), (r"[\p{L}]+", _LETTER), (r"[\p{N}]+", _NUMBER)):
        for _, (start, end) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            out[points[start:end]] = kind
    return out


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    both = []
    for base in (_BASE, inverse):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


def _slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of many slices, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Codec:
    """Encodes and decodes as the tokenizers library does with the same file, without truncation and padding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self._refuse_other(spec)
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: s for s, i in (vocab | self.specials).items()}
        self.pieces = [self.pieces.get(i, "") for i in range(max(self.pieces) + 1)]
        suffix = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[symbols[b] + suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self._forget()

    @staticmethod
    def _refuse_other(spec: dict) -> None:
        model, normal, pre = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [(x["type"], x.get("pattern"), x.get("content")) for x in normal.get("normalizers", [])]
        splits = [(x["type"], x.get("pattern"), x.get("invert"), x.get("use_regex")) for x in pre.get("pretokenizers", [])]
        known = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("ignore_merges") and spec.get("decoder") is None
            and steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and splits == [("Split", {"Regex": WORD_PATTERN}, True, None), ("ByteLevel", None, None, False)]
        )
        if not known:
            raise ValueError("a byte-level BPE file with word ends, lower case and the known split pattern is needed")

    def _forget(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int64)

    # --- merging ------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one after the other, and how many each has."""
        data = [w.encode() for w in words]
        lengths = np.array([len(d) for d in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        sym = self.inner[raw]
        sym[np.cumsum(lengths) - 1] = self.last[raw[np.cumsum(lengths) - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(sym), _NONE)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(sym[inside], sym[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            low = np.repeat(lowest, sizes)
            active = low != _NONE
            if not active.all():
                done.append((word[~active], sym[~active]))
                sym, word, rank, low = sym[active], word[active], rank[active], low[active]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            # Of overlapping equal pairs every other one, from the left.
            fresh = np.r_[True, np.diff(hit) != 1]
            begun = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begun) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            moved = np.cumsum(stay) - 1
            sym, word, rank, hit = sym[stay], word[stay], rank[stay], moved[hit]
            for near in (hit, hit[hit > 0] - 1):
                rank[near] = _NONE
                pair = near[near + 1 < len(sym)]
                pair = pair[word[pair] == word[pair + 1]]
                rank[pair] = self._rank(sym[pair], sym[pair + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, sym = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    # --- words --------------------------------------------------------------

    def _words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words."""
        kind = _classes()[points]
        begins = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)]
        quote = np.flatnonzero((points[:-1] == ord("'")) & (kind[1:] == _LETTER))
        quote = quote[(quote == 0) | (kind[quote - 1] != _OTHER)]  # else the quote ends a run of other characters
        after = np.r_[points, 0, 0]
        one, two = after[quote + 1], after[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        taken = short | long
        begins[quote[taken] + 1] = False
        end = quote[taken] + 2 + long[taken]
        end = end[end < len(points)]
        begins[end] = True
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(points)]
        real = kind[starts] != _SPACE
        return starts[real], ends[real]

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the words of normalized texts, how many ids each has, and all ids."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, ends = self._words(points)
        ahead, back = _powers(1 << max(20, int(len(points)).bit_length()))
        sums = np.r_[np.uint64(0), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * ahead[: len(points)], dtype=np.uint64)]
        key = (sums[ends] - sums[starts]) * back[starts]
        key ^= (ends - starts).astype(np.uint64) << np.uint64(56)
        far = np.flatnonzero(ends - starts > _LONGEST_HASHED)
        near = ends - starts <= _LONGEST_HASHED
        distinct, first, which = np.unique(key[near], return_index=True, return_inverse=True)
        first = np.flatnonzero(near)[first]
        if len(self.hashes) > KNOWN_WORDS:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            flat, size = self.merge([text[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            where = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, flat])
            self.at, self.size = np.insert(self.at, at[new], where), np.insert(self.size, at[new], size)
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            at = np.searchsorted(self.hashes, distinct)
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begin[near], count[near] = self.at[at][which], self.size[at][which]
        flat = self.flat
        if len(far):
            more, size = self.merge([text[s:e] for s, e in zip(starts[far].tolist(), ends[far].tolist())])
            begin[far], count[far] = len(flat) + np.cumsum(size) - size, size
            flat = np.concatenate([flat, more])
        return starts, count, flat[_slices(begin, count)]

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case of each character by itself (so no final sigma); white space never joins words."""
        if _RARE.search(text):  # versions of Unicode differ there: the library's own steps
            return Lowercase().normalize_str(NFC().normalize_str(text))
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        parts: list[str | int] = []
        of: list[int] = []
        for i, text in enumerate(texts):
            at = 0
            if self.special and "<" in text:
                for found in self.special.finditer(text):
                    parts += [text[at : found.start()], self.specials[found.group()]]
                    of += [i, i]
                    at = found.end()
            parts.append(text[at:])
            of.append(i)
        plain = [self.normal(p) for p in parts if isinstance(p, str)]
        lengths = np.array([len(p) + 1 for p in plain], np.int64)
        starts, count, ids = self._ids(" ".join(plain))
        edges = np.searchsorted(starts, np.cumsum(lengths))
        cuts = np.r_[0, np.cumsum(count)][edges]
        own = iter(np.split(ids, cuts[:-1]))
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for i, p in zip(of, parts):
            out[i].append(next(own) if isinstance(p, str) else np.array([p], np.int64))
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """Pieces with a space between; files of this kind name no decoder."""
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every document.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` is their text with special tokens kept.  A null or
    empty text has no ids and decodes to ''.  Rows with equal or null ids stay rows of their own; other columns are ignored.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        for batch in batches(source, _BATCH_BYTES, "text"):
            ids = coder.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([coder.decode(x) for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
