"""Packing and BPE against the tokenizers library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hostlens.llm import bpe, packing
from hostlens.llm.bpe import Codec
from hostlens.llm.tokens import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "  ", "a  b", "a \n b", "x\n\ny", "<|endoftext|>", "a<|startoftext|>b", "'s 'string ''s we'LL", "ΑΣ ΣΑΣ İI", "aaaaaaaaaaaaaaaa" * 8, "x" * 700,
    "é é ͸ Ꟛ", "\x1c\x85\xa0", "12 ½ ²٣", "퟿",
]


@pytest.mark.parametrize("path, make", [(BYTES, Encoder), (WORDS, Codec)])
def test_ids_equal_the_library(path, make, nasty_rows):
    library, own = Tokenizer.from_file(path), make(path)
    for text in ODD + [r[1] or "" for r in nasty_rows]:
        want = library.encode(text, add_special_tokens=False).ids
        if make is Codec:
            ids = own.encode_batch([text])[0]
            assert ids.tolist() == want
            assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
        else:
            assert np.frombuffer(own.encode(text), "<u2").tolist() == want


def test_round_trip_rows(nasty, nasty_rows, empty):
    library = Tokenizer.from_file(WORDS)
    got = bpe.encode(nasty, WORDS).collect()
    want = []
    for r in nasty_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, want)) == sorted(repr((g[0], g[1], bytes(g[2]), g[3])) for g in got)
    assert bpe.encode(empty, WORDS).collect() == []


def test_unknown_files_are_refused():
    with pytest.raises(ValueError):
        Codec(BYTES)


def check_pieces(pieces, rows, window):
    library = Tokenizer.from_file(BYTES)
    want = Counter()
    for r in rows:
        want[(r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids + [1]))] += 1
    by_place = defaultdict(list)
    for p in pieces:
        by_place[p["sequence_id"]].append((p["offset"], p["length"]))
        assert p["length"] == len(p["ids"])
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    for spans in by_place.values():  # gapless from 0
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    assert sum(sum(n for _, n in s) == window for s in by_place.values()) >= len(by_place) - 1
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(p["length"] for p in pieces) == total
    found = Counter()
    parts = defaultdict(list)
    for p in pieces:
        parts[p["doc_id"]].append(p)
    for (doc, ids), n in want.items():  # every slice of every document, as often as the document
        for p in parts[doc]:
            if tuple(p["ids"]) == ids[p["start"] : p["start"] + p["length"]] and p["doc_tokens"] == len(ids):
                found[(doc, ids)] += p["length"]
        assert found[(doc, ids)] == n * len(ids)


@pytest.mark.parametrize("targets, window, packet", [(None, 2048, 256), ({"s1": 5.0, "s2": 1.0}, 300, 64), (None, 16, 7)])
def test_packing(nasty, nasty_rows, targets, window, packet):
    pieces = packing.pack(nasty, BYTES, targets, window, packet, with_ids=True).collect()
    check_pieces(pieces, nasty_rows, window)


def test_mixture_follows_targets(spark):
    rows = [(i, "some words of text " * 40, "en", "a" if i % 3 else "b") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pieces = packing.pack(docs, BYTES, {"a": 1.0, "b": 1.0}, 512, 32).where("sequence_id < 8").collect()
    share = defaultdict(Counter)
    for p in pieces:
        share[p["sequence_id"]][p["source"]] += p["length"]
    for window in share.values():
        assert abs(window["a"] - window["b"]) <= 4 * 32


def test_sequences_are_padded(spark, nasty, empty):
    pieces = packing.pack(nasty, BYTES, window=300, packet=64, with_ids=True)
    rows = packing.sequences(pieces, 300).collect()
    assert all(len(r["ids"]) == (r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else 300) for r in rows)
    assert packing.pack(empty, BYTES).collect() == []


def test_targets_must_be_positive(nasty):
    with pytest.raises(ValueError):
        packing.pack(nasty, BYTES, {"s1": 0.0})
