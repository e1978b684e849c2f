"""Byte-level token ids, as the tokenizers library gives them for the same file."""

from __future__ import annotations

import array
import json
import re
from functools import lru_cache

#: Distinct pieces whose ids a worker keeps.
CACHED_PIECES = 1_000_000
_INNER_SPACE = re.compile(r"\s ")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as packed little-endian integers.

    Where the file is byte-level BPE whose ids follow its merges, pieces between spaces are encoded by tiktoken
    and remembered; for any other file the tokenizers library encodes each text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        top = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.code = "H" if top < 65536 else "I"
        self.width = 2 if top < 65536 else 4
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cache: dict[str, bytes] = {}
        if self._ranked(spec):
            import public_tokenizers
            import tiktoken

            back = {s: b for b, s in byte_symbols().items()}
            ranks = {bytes(back[c] for c in piece): i for piece, i in vocab.items() if piece not in self.specials}
            self.fast = tiktoken.Encoding(
                "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.specials
            )
        else:
            from tokenizers import Tokenizer

            self.fast, self.slow = None, Tokenizer.from_file(path)
            self.slow.no_truncation()
            self.slow.no_padding()

    @staticmethod
    def _ranked(spec: dict) -> bool:
        """Whether tiktoken's rule (merge the pair of lowest id) is the file's own."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            return False
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
            return False
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))

    def _piece(self, piece: str) -> bytes:
        ids = array.array(self.code, self.fast.encode_ordinary(piece)).tobytes()
        if len(self.cache) < CACHED_PIECES:
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """No special tokens are added; those that stand in the text are taken as such."""
        if self.fast is None:
            return array.array(self.code, self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        if any(s in text for s in self.specials):
            return array.array(self.code, self.fast.encode(text, allowed_special="all")).tobytes()
        # A space after a character that isn't white space always begins a piece, so such texts can be cut there.
        if _INNER_SPACE.search(text):
            return array.array(self.code, self.fast.encode_ordinary(text)).tobytes()
        first, *rest = text.split(" ")
        get, piece = self.cache.get, self._piece
        return b"".join([get(p) or piece(p) for p in (first, *(" " + p for p in rest))])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
