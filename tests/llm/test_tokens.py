"""Operators 2 and 8 against the libraries, and packing's own rules."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import bpe, packing
from tidegauge.llm.pretokens import ranks, splitter, vocabulary_path


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(vocabulary_path(bpe.VOCABULARY)), special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))


def test_bpe_digests(spark, docs, texts, encoding):
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect())
    want = []
    for i, t in texts:
        ids = encoding.encode_ordinary(t or "")
        want.append((i is None, i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda x: (x[0], x[1] or 0, x[3])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_bpe_round_trip(spark, docs, texts):
    got = {r.doc_id: bytes(r.decoded).decode() for r in bpe.encode(docs).collect() if r.doc_id is not None}
    assert got == {i: t or "" for i, t in texts if i is not None}


def test_bpe_long_and_short_pieces_agree(encoding):
    vocab = ranks(vocabulary_path(bpe.VOCABULARY))
    for data in (b"a" * 200, b"ab" * 150, bytes(range(256)), "ééé".encode() * 40):
        assert bpe.heap_encode(data, vocab) == encoding._encode_single_piece(data)


def test_long_pieces_through_duckdb():
    """Both recursions, at the sizes where they meet and for runs where pairs overlap, against the heap."""
    import random

    r = random.Random(8)
    made = bpe.DuckBpe(vocabulary_path(bpe.VOCABULARY))
    letters = lambda some, n: "".join(r.choice(some) for _ in range(n))
    pieces = ["a" * n for n in (95, 96, 97, 98, 500, 3_999)] + ["ab" * 60 + "c", "aab" * 200, "=-" * 1_500, "é" * 300, letters("acgt", 400), letters("abcdefghijklmnopqrstuvwxyz", 700), "x" * 4_001]
    made.learn(pieces)
    for p in pieces:
        ids = bpe.heap_encode(p.encode(), made.vocab)
        assert made.memo[p] == (" ".join(map(str, ids)), len(ids), p.encode())


def test_bpe_memo_keeps_what_is_asked_for_again(monkeypatch, encoding):
    """Pieces of every text are contracted once, however often the memo fills."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "CACHE_PIECES", 60)
    monkeypatch.setattr(bpe, "_WORKER", {})
    learned, learn = [], bpe.DuckBpe.learn
    monkeypatch.setattr(bpe.DuckBpe, "learn", lambda self, pieces: (learned.extend(pieces), learn(self, pieces))[1])
    texts = ["often comes this" + "".join(f" w{chr(97 + n % 26)}{chr(97 + n // 26)}x{chr(97 + k)}" for k in range(16)) for n in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["doc_id", "text"])
    got = [r["ids"] for b in bpe.encode_partition(iter([batch]), vocabulary_path(bpe.VOCABULARY), True) for r in b.to_pylist()]
    assert got == [encoding.encode_ordinary(t) for t in texts]
    assert [learned.count(p) for p in ("often", " comes", " this")] == [1, 1, 1] and len(learned) == 3 + 60 * 16


def test_bpe_memo_overflow_changes_nothing(monkeypatch, encoding):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "CACHE_PIECES", 40)
    monkeypatch.setattr(bpe, "_WORKER", {})
    rows = [f"word{i} other{i} more{i} same" for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(rows)], names=["doc_id", "text"])
    got = [r for b in bpe.encode_partition(iter([batch]), vocabulary_path(bpe.VOCABULARY), True) for r in b.to_pylist()]
    assert [r["ids"] for r in got] == [encoding.encode_ordinary(t) for t in rows]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_splitting_loses_nothing(text):
    assert "".join(splitter()(text)) == text


def check_packing(rows, texts, tokenizer, capacity=packing.CAPACITY):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    for i, all_ids in want.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, all_ids))
        left = sorted((len(ids), zlib.crc32(ids.tobytes())) for ids in all_ids)
        assert sorted({r.doc_tokens for r in pieces[i]}) == sorted({n for n, _ in left})
        for r in pieces[i]:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in all_ids)
    filled = [sum(r.length for r in found) for found in sequences.values()]
    return sum(filled), len(filled)


def test_packing(spark, docs, texts, tokenizer):
    check_packing(packing.pack(docs).collect(), texts, tokenizer)


def test_packing_pads_little(spark, sf_dir, tokenizer):
    rows = packing.op2_harmonic_packing(spark, sf_dir).collect()
    used = sum(r.length for r in rows)
    sequences = len({r.sequence_id for r in rows})
    assert used / (sequences * packing.CAPACITY) > 0.97


def test_special_tokens_as_the_library_has_them(tokenizer):
    ids = packing.Ids(vocabulary_path(packing.VOCABULARY))
    text = "x<|endoftext|>y"
    assert np.frombuffer(ids.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5000))
def test_harmonic_cuts(size):
    cuts = packing.harmonic_cuts(size)
    assert sum(n for _, n in cuts) == size
    assert all(0 < n <= packing.CAPACITY // j for j, n in cuts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60))
def test_packer_places_every_piece_once(sizes):
    packer, placed = packing.HarmonicPacker(), []
    for n, size in enumerate(sizes):
        start = 0
        for kind, length in packing.harmonic_cuts(size):
            placed += packer.add(kind, (n, start, length))
            start += length
    placed += packer.finish()
    for n, size in enumerate(sizes):
        at = 0
        for _, start, length, _, _ in sorted(p for p in placed if p[0] == n):
            assert start == at
            at += length
        assert at == size


@pytest.mark.parametrize("op", [packing.pack, bpe.digests, bpe.encode])
def test_empty_table(empty, op):
    assert op(empty).collect() == []
