"""Pattern packing: the plan on histograms, and the operator against the library's ids."""

import random
import zlib

import numpy as np
import pytest

from brooklog.llm import pattern_packing as pp
from brooklog.llm.queries import QUERIES
from tests.llm.test_tokens import BYTE, ids_of

SF = "/root/testdata/sf0.001"


def check_plan(histogram):
    """Every number of every length has one place; sequences have no gaps and hold a window at most.  Gives their number."""
    window, seen, sequences = len(histogram) - 1, {}, {}
    for p in pp.plan(histogram):
        for i in range(p.count):
            seen.setdefault(p.length, []).append(p.first + i)
            sequences.setdefault(p.sequence + i // p.each, []).append((p.offset + i % p.each * p.length, p.length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in enumerate(histogram.tolist()) if n}
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


@pytest.mark.parametrize("seed", range(12))
def test_plans_of_random_histograms(seed):
    pick = np.random.default_rng(seed)
    window = int(pick.integers(2, 200))
    low = int(pick.integers(1, window + 1))
    lengths = pick.integers(low, window + 1, int(pick.integers(0, 3000)))
    histogram = np.bincount(lengths, minlength=window + 1)
    used = check_plan(histogram)
    plain = sum(n for n, _ in pp.best_fit(histogram))
    assert used <= plain * 1.02 + 1
    if low <= window // 8 and len(lengths) > 500:
        assert lengths.sum() > 0.97 * used * window


def test_patterns_fill_the_window():
    histogram = np.zeros(101, np.int64)
    histogram[[10, 20, 30, 40, 50, 60, 70, 100]] = 5
    found = {tuple(p) for p in pp.few_document_patterns(histogram).tolist()}
    lengths = [10, 20, 30, 40, 50, 60, 70]
    want = {(0, a, b) for a in lengths for b in lengths if a <= b and a + b == 100}
    want |= {(a, b, c) for a in lengths for b in lengths for c in lengths if a <= b <= c and a + b + c == 100}
    assert found == want


def test_fit_is_a_least_squares_optimum():
    """No pattern could lower the misfit by more repeats, and those in use not by a change either way."""
    pick = np.random.default_rng(3)
    histogram = np.bincount(pick.integers(1, 60, 4000), minlength=61)
    patterns = pp.few_document_patterns(histogram)
    repeats = pp.fit_repeats(patterns, histogram.astype(float), steps=500)
    square = (np.arange(61) / 60) ** 2
    misfit = histogram - np.bincount(patterns.ravel(), np.repeat(repeats, 3), 61)
    slope = (misfit * square)[patterns].sum(axis=1)
    scale = (histogram * square)[patterns].sum(axis=1).max()
    assert (repeats >= 0).all() and np.abs(slope[repeats > 0]).max() < 1e-6 * scale
    assert (square * misfit**2).sum() < 0.02 * (square * histogram.astype(float) ** 2).sum()


def test_repeats_that_fit_exactly():
    """Lengths that only pair up one way are packed without room left."""
    histogram = np.zeros(1025, np.int64)
    histogram[[700, 324, 600, 424]] = [1000, 1000, 50, 50]
    assert check_plan(histogram) == 1050


def test_a_hot_length():
    histogram = np.zeros(1025, np.int64)
    histogram[[3, 700]] = [100_000, 10]
    assert check_plan(histogram) <= -(-(300_000 + 7000) // 1023) + 2


def check_packed(rows, pieces, window):
    whole = {}
    for k, t in rows:
        ids = ids_of(BYTE, t, 2)
        whole.setdefault((k, len(ids)), []).append(ids)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(whole)
    for (k, total), held in by_doc.items():
        texts = whole[k, total]
        assert sum(p.length for p in held) == total * len(texts)
        first = total - (-(-total // window) - 1) * window
        for p in held:
            assert p.start == (0 if p.piece == 0 else first + (p.piece - 1) * window) and p.length == (first if p.piece == 0 else window)
            assert any(np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length] for ids in texts)
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(by_sequence)


def test_odd_rows(table, odd_rows):
    check_packed(odd_rows, pp.pack(table(odd_rows).repartition(3), BYTE, window=256).collect(), 256)
    assert pp.pack(table([]), BYTE).count() == 0


def test_many_rows_of_one_length_over_many_tasks(table):
    pick = random.Random(2)
    rows = [(i, "a b c") for i in range(700)] + [(1000 + i, "word " * pick.randint(1, 90)) for i in range(700)]
    used = check_packed(rows, pp.pack(table(rows).repartition(7), BYTE, window=64).collect(), 64)
    assert used <= 1.02 * sum(len(ids_of(BYTE, t, 2)) for _, t in rows) / 64 + 2


def test_without_a_broadcast_of_the_places(table, monkeypatch):
    monkeypatch.setattr(pp, "small_side", lambda df: df)
    rows = [(i, "word " * (i % 50 + 1)) for i in range(300)]
    check_packed(rows, pp.pack(table(rows).repartition(4), BYTE, window=64).collect(), 64)


def test_query(spark):
    """The registered query against ids of the library: every piece, and its digest."""
    found = QUERIES["op11_pattern_packing"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total = 0
    for k, text in texts.items():
        ids, mine = ids_of(BYTE, text, 2), sorted((r for r in found if r.doc_id == k), key=lambda r: r.piece)
        total += len(ids)
        assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine[:-1])]).tolist() and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert len({r.sequence_id for r in found}) <= 1.02 * total / 1024 + 1
