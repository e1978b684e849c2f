"""Words of whole texts by vectorised hashing: 64-bit hashes of words and of runs of words."""

from __future__ import annotations

import hashlib

import numpy as np

#: Longer words are hashed one by one.
_LONG = 512
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_PLACE = mix(np.arange(1000, 1000 + _LONG, dtype=np.uint64)) | np.uint64(1)


def word_hashes(raw: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in UTF-8 bytes, cut at ASCII white space; ``lower`` folds A-Z."""
    solid = ~_SPACES[raw]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    inside = np.arange(total) - np.repeat(first, sizes)
    values = (_LOWER if lower else _BYTE)[raw[solid]] * _PLACE[inside % _LONG]
    out = mix(np.add.reduceat(values, first) + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > _LONG):
        word = raw[starts[i] : ends[i]].tobytes()
        word = word.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) if lower else word
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return starts, ends, out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    size = max(0, len(words) - n + 1)
    out = np.full(size, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + size])
    return out


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted set of hashed runs of ``n`` lower-case words of each text; of fewer words, the whole as one."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts, _, words = word_hashes(np.frombuffer(b"\n".join(data), np.uint8), lower=True)
    edges = np.searchsorted(starts, np.cumsum([0] + [len(d) + 1 for d in data]))
    runs = run_hashes(words, n)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        else:
            out.append(run_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
