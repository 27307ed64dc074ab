import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import packing, wavelet

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def ids(path, text, end):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=200))
def test_wavelet_matrix(values):
    data = np.array(values, np.uint32)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(data).to_bytes())
    assert m.decode().tolist() == values
    assert [m.access(i) for i in range(len(values))] == values
    for v in {values[0], values[-1], 301}:
        where = [i for i, x in enumerate(values) if x == v]
        assert m.count(v) == len(where) and m.occurrences(v) == where
        assert m.rank(v, len(values) // 2) == sum(i < len(values) // 2 for i in where)


def test_wavelet_bounds():
    m = wavelet.WaveletMatrix.build(np.array([3, 1, 3], np.uint32))
    for call in (lambda: m.access(3), lambda: m.select(3, 2), lambda: m.select(9, 0)):
        with pytest.raises(IndexError):
            call()
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"nothing here at all.")


def test_wavelet_index_of_odd_rows(spark, odd):
    got = wavelet.read(spark, wavelet.write(odd, BYTES, 0, shard_tokens=50)).collect()
    expected = sorted((r.doc_id if r.doc_id is not None else -1, len(x := ids(BYTES, r.text, 0)), zlib.crc32(x.tobytes())) for r in odd.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == expected
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)


def test_empty_tables(spark, odd):
    assert wavelet.read(spark, wavelet.write(odd.limit(0), BYTES)).count() == 0
    assert packing.pack(packing.pieces_of(odd.limit(0), WORDS, 1)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_bounds_are_bounds(sizes):
    sizes = np.array(sizes)
    bins, places, fill = packing.best_fit_decreasing(sizes, 100)
    assert max(fill) <= 100 and sum(fill) == sizes.sum()
    for b in range(len(fill)):
        at = 0
        for i in sorted(np.flatnonzero(bins == b), key=lambda i: places[i]):
            assert places[i] == at
            at += sizes[i]
    bound = packing.lower_bound(np.bincount(sizes, minlength=101), 100)
    assert -(-int(sizes.sum()) // 100) <= bound <= len(fill)


def test_bound_sees_large_pieces():
    assert packing.lower_bound(np.bincount([51] * 7, minlength=101), 100) == 7
    assert packing.lower_bound(np.bincount([34] * 9, minlength=101), 100) == 5


def test_packing_of_odd_rows(spark, odd):
    rows = packing.pack(packing.pieces_of(odd, WORDS, 1, capacity=64), capacity=64, rows_per_task=5).collect()
    expected = []
    for r in odd.collect():
        own = ids(WORDS, r.text, 1)
        expected += [(str(r.doc_id), k, a, len(own[a : a + 64]), zlib.crc32(own[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(own), 64))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64


def test_exchange_reaches_the_bound(spark):
    """Many tasks with a rest each end up near the bound of the whole."""
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 40, 4000).tolist()
    rows = [(i, 0, 0, s, 0) for i, s in enumerate(sizes)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), capacity=100, rows_per_task=300)
    assert got.count() == len(rows)
    bound = packing.lower_bound(np.bincount(sizes, minlength=101), 100)
    assert got.select("sequence_id").distinct().count() <= bound + 1
