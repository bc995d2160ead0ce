"""Packing: every id in one piece, gapless windows without padding, and a plan that keeps documents whole."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlens.llm.packing import combinations, pack, place, plan, repeat_counts, sequences
from tests.llm.data import ROWS, documents, rows_of

FILE = public_tokenizers.path("byte_bpe_50k.json")


def check_pieces(rows, window):
    """Every row's pieces join up, every sequence is gapless and full or a power of two."""
    by_sequence, by_row = {}, {}
    for row, start, length, sequence, offset, n in rows:
        by_sequence.setdefault(sequence, []).append((offset, length))
        by_row.setdefault(row, (n, []))[1].append((start, length))
    for n, parts in by_row.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == n
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("broadcast_rows", [0, 1_000_000])
def test_pack_equals_the_library(spark, broadcast_rows):
    own = Tokenizer.from_file(FILE)
    rows = ROWS + [(100 + i, "word " * (i * 7), "en", "a") for i in range(60)]
    got = pack(documents(spark, rows).repartition(5), broadcast_rows=broadcast_rows).collect()
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append(own.encode(t or "", add_special_tokens=False).ids + [0])
    seen = {i: sum(map(len, x)) for i, x in ids.items()}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        assert any(x[r.start:r.start + r.length] == r.ids and len(x) == r.doc_tokens for x in ids[r.doc_id])
        seen[r.doc_id] -= r.length
    assert not any(seen.values())
    lengths = {}
    for r in got:
        lengths.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in lengths.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] == 1024 or bin(ends[-1]).count("1") == 1


def test_sequences_hold_the_pieces(spark):
    pieces = pack(documents(spark)).cache()
    joined = {r.sequence_id: r for r in sequences(pieces, pad_id=-1).collect()}
    for r in pieces.collect():
        assert joined[r.sequence_id].ids[r.offset:r.offset + r.length] == r.ids
    for s in joined.values():
        assert len(s.ids) in (1024, s.n_tokens) and s.ids[s.n_tokens:] == [-1] * (len(s.ids) - s.n_tokens)
    short = sequences(pieces.filter("length = 3 AND start = 0 AND offset = 0").limit(1), window=8, pad_id=9).collect()
    assert all(len(s.ids) == 8 and s.ids[3:] == [9] * 5 for s in short)
    pieces.unpersist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=120), st.sampled_from([2, 8, 16, 50, 64]))
def test_places(sizes, window):
    n = np.array(sizes, np.int64)
    windows, rest = np.divmod(n, window)
    histogram = np.bincount(rest, minlength=window).astype(np.int64)
    histogram[0] = 0
    nth = np.array([(rest[:i] == r).sum() for i, r in enumerate(rest)], np.int64)
    chosen = plan(histogram, int(windows.sum()), window)
    row, start, length, sequence, offset = place(chosen, n, nth, np.cumsum(windows) - windows)
    check_pieces(list(zip(row.tolist(), start.tolist(), length.tolist(), sequence.tolist(), offset.tolist(), n[row].tolist())), window)


def test_combinations_fill_the_window():
    columns = combinations(64)
    assert (columns.sum(axis=1) == 64).all() and len(np.unique(columns, axis=0)) == len(columns)
    want = {(a, b, 64 - a - b) for a in range(64) for b in range(1, 64) if a <= b <= 64 - a - b}
    assert set(map(tuple, columns.tolist())) == want
    assert len(combinations(4096, 20_000)) < 25_000


def test_repeat_counts_are_non_negative_least_squares():
    """Against the optimality conditions: no slope below zero, none at all where a count is used."""
    rng = np.random.default_rng(4)
    histogram = rng.integers(0, 50, 24).astype(float)
    histogram[0] = 0
    columns = combinations(24)
    x = repeat_counts(histogram, columns, 5000)
    matrix = np.zeros((24, len(columns)))
    for i, c in enumerate(columns):
        for length in c[c > 0]:
            matrix[length, i] += 1
    slope = matrix.T @ (matrix @ x - histogram)
    assert (x >= 0).all() and slope.min() > -0.05 and np.abs(slope[x > 0.01]).max() < 0.05


def test_most_documents_stay_whole():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 1024, 50_000), minlength=1024).astype(np.int64)
    chosen = plan(histogram, 0)
    assert chosen.used.sum() > 0.95 * histogram.sum()
    assert (chosen.used <= histogram).all()


def test_pack_of_a_large_window_and_more_columns(spark):
    assert pack(documents(spark, []), window=4096).count() == 0
    plain = pack(documents(spark).coalesce(1), window=4096)
    assert rows_of(pack(documents(spark, clashing=True).coalesce(1), window=4096)) == rows_of(plain)
