"""BPE and packing against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quire.llm import bpe, packing
from quire.llm.registry import vocabulary
from tokenizers import Tokenizer

WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n a", "Hello  WORLD's \x1c\x1d don't İΣΑΣ ² Ⅷ ½ ①", "a<|endoftext|>b <|startoftext|>", "é ́x  q\x85z 中文字 😀😀 ‍﻿", "a" * 5000, "你好" * 3000, "!" * 999, "᠎ x᠎y", " " * 3000 + "x", "The quick THE quick"]


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(WORDS)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    library, codec = Tokenizer.from_file(WORDS) if not hasattr(test_any_text, "t") else test_any_text.t, bpe.codec(WORDS)
    test_any_text.t = library
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert codec.round_trip(text) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))


def test_forced_boundaries_do_not_change_ids():
    """A word is encoded as its fragments are, each alone; long fragments take the heap."""
    codec = bpe.codec(WORDS)
    for word in ["antidisestablishmentarianism", "zqxjkvbzqxjkv", "ab" * 200, "é" * 60]:
        data = word.encode()
        ids = [codec.inner[b] for b in data]
        ids[-1] = codec.last[data[-1]]
        assert codec.word(word) == codec._merge_long(ids)


def test_digests(spark, own):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(0, None, "clash")]
    got = bpe.encode_digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), WORDS).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = own.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_digests(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0
    assert bpe.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), WORDS).first().decoded == "a</w> b</w>"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_byte_ids(text):
    library = Tokenizer.from_file(BYTES) if not hasattr(test_byte_ids, "t") else test_byte_ids.t
    test_byte_ids.t = library
    assert np.frombuffer(packing.encoder(BYTES).one(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        lengths = rng.integers(1, 2048, n)
        plan = packing.plan(lengths)
        seen = {}
        for sequence in plan:
            assert sum(x for _, _, x in sequence) <= 2048
            for piece, begin, length in sequence:
                seen.setdefault(piece, []).append((begin, length))
        assert len(seen) == n
        for piece, parts in seen.items():
            at = 0
            for begin, length in sorted(parts):
                assert begin == at and length > 0
                at += length
            assert at == lengths[piece]
        if n == 3000:
            assert 1 - lengths.sum() / (2048 * len(plan)) < 0.015


def test_nnls_against_the_conditions_of_optimality():
    rng = np.random.default_rng(2)
    a, b = rng.random((12, 30)), rng.random(12)
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-5 and abs(slope[x > 0]).max() < 1e-5


def test_packing(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, "null id", 1), (3, "again", 1)]
    library = Tokenizer.from_file(BYTES)
    wanted = sorted(zlib.crc32(np.asarray(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()) for _, t, _ in rows if len(library.encode(t or "", add_special_tokens=False).ids) < 2048)
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, offset int"), BYTES).collect()
    whole = sorted(r.ids_crc32 for r in got if r.length == r.doc_tokens)
    assert set(whole) <= set(wanted) and len(whole) >= len(wanted) - 3
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0
