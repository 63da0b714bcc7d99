import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import rigspark.llm.packing as packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, capacity):
    """``rows``: (doc, start, length, crc, tokens, sequence, offset); every id in one piece, no overlap or gap."""
    tokenizer = Tokenizer.from_file(PATH)
    own, sequences = {}, {}
    for r in rows:
        own.setdefault(r[0], []).append(r)
        sequences.setdefault(r[5], []).append((r[6], r[2]))
    assert set(own) == set(texts)
    for doc, text in texts.items():
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for _, start, length, crc, tokens, _, _ in sorted(own[doc], key=lambda r: r[1]):
            assert (start, tokens) == (at, len(ids)) and length > 0 and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    sums = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        sums.append(at)
    return sums


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = [tuple(r) for r in packing.packing_report(docs, PATH).collect()]
    sums = check(got, {r.doc_id: r.text for r in docs.collect()}, 4096)
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sums)
    assert padding <= 0.02 * sum(sums)
    assert sorted(got) == sorted(tuple(r) for r in packing.packing_report(docs, PATH).collect())


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    monkeypatch.setattr(packing.WordTokens, "WORDS", 20)
    texts = {0: None, 1: "", 2: " \n ", 3: "ÀÉ ́x ΑΣ ΣΑΣ b  <|endoftext|> it's\tdon't 12345" * 30, 4: "y" * 3000, 5: "word " * 20_000, None: "no id", 301: "a~b ~ ~~ c", 302: "x" * 65 + " ~" + "é" * 70}
    texts |= {i: "same text" for i in range(6, 300)}
    docs = spark.createDataFrame([(k, v, 1, "s", 2) for k, v in texts.items()], "doc_id long, text string, row int, ids string, part int")
    got = packing.packing_report(docs, PATH, 64)
    check([tuple(r) for r in got.collect()], texts, 64)
    assert packing.packing_report(docs.limit(0), PATH).count() == 0


def test_repeated_ids_and_whole_sequences(spark):
    docs = spark.createDataFrame([(1, "one two three")] * 5 + [(2, "a b " * 40)], "doc_id long, text string")
    packed = packing.pack_documents(docs, PATH, capacity=32)
    rows = packed.collect()
    assert sum(r.start == 0 for r in rows) == 6 and sum(r.length for r in rows) == 5 * 4 + 81
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, bytes(r.ids)))
    for r in packing.sequences(packed, 32, pad_id=7).collect():
        want = b"".join(ids for _, ids in sorted(by[r.sequence_id]))
        n = len(want) // 4
        assert r.n_tokens == n and list(r.starts) == sorted(o for o, _ in by[r.sequence_id])
        assert bytes(r.ids) == want + (b"" if n & (n - 1) == 0 else (7).to_bytes(4, "little") * (32 - n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=80), st.integers(60, 200))
def test_windows_hold_all_and_never_overflow(sizes, capacity):
    sizes = np.array(sizes)
    window = packing.windows_of(sizes, capacity)
    sums = np.bincount(window, sizes)
    assert len(window) == len(sizes) and window.min() >= 0 and sums.max() <= capacity


def test_differencing_is_near_equal():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1000, 2000)
    for windows in (2, 17, 250):
        sums = np.bincount(packing.difference(sizes, windows), sizes, windows)
        assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 30
    # The textbook example: 8, 7, 6, 5, 4 in two parts differ by 2.
    assert sorted(np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


@pytest.mark.parametrize("tokens, want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 8), (8, 1)]), (13, [(0, 8), (8, 2), (10, 2), (12, 1)])])
def test_cuts(tokens, want):
    assert packing.cuts(tokens, 8, 2) == want
