"""Nearest neighbours and archives against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from brooklog.llm import vantage_trees, warc
from brooklog.llm.common import work_folder


def plain_nearest(rows, queries, k):
    out = {}
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float64)
    for q, x in queries:
        score = vantage_trees.cosine(np.repeat(np.array([x], np.float64), len(v), 0), v)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def vectors(n=3000, dims=8, seed=3):
    """Clustered vectors, with a large group of equal ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=dims)).astype("f4").tolist()) for i in range(n)]
    return [(i, rows[7][1] if i % 3 == 0 else x) for i, x in rows]


def ask(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vantage_trees.nearest(frame, frame.filter("vec_id % 50 = 0"), **options).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("shard", [400, 20_000])
def test_factor_one_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(vantage_trees, "SHARD_ROWS", shard)
    monkeypatch.setattr(vantage_trees, "BLOCK_QUERIES", 25)
    rows = vectors()
    assert ask(spark, rows) == plain_nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_smaller_factor_finds_most(spark):
    rows = [r for r in vectors() if r[0] % 3]
    want = plain_nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)
    found = ask(spark, rows, factor=0.5)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found.get(q, [])}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (6, [1.0, 1.0]), (50, None), (8, [])]
    found = ask(spark, rows)
    assert list(found) == [0] and [i for i, _ in found[0]] == [6]
    assert ask(spark, [(1, None)]) == {}
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, score double, shard int, block int")
    assert vantage_trees.nearest(frame, frame).count() == 0


def pages():
    pick = random.Random(6)
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nbroken"
    long = "same page " * 30
    rows = [(i, f"http://h/{i}", pick.choice([f"<p>{i}</p>" * pick.randint(0, 200), trap, trap * 3 + str(i), long, "short", "", None, "é中😀" * 40])) for i in range(120)]
    return rows + [(500, None, "x" * 300_000), (501, "http://a\r\nb", trap), (3, "http://h/3", rows[3][2]), (None, None, long), (None, "u", "no key")]


def plain_records(rows):
    first = {}
    for k, _, p in rows:
        p = p or ""
        if k is not None and len(p.encode()) >= 100:
            first[p] = min(k, first.get(p, k))
    out = []
    for k, _, p in rows:
        p = p or ""
        repeats = sum((q or "") == p for _, _, q in rows) > 1
        again = p in first and repeats and k != first[p]
        out.append((str(k), "revisit" if again else "response", first[p] if again else None, hashlib.sha256(p.encode()).hexdigest(), None if again else p))
    return sorted(map(str, out))


def test_archives(spark):
    rows = pages()
    frame = spark.createDataFrame([(*r, "?", "?", 1) for r in rows], "page_id long, url string, html string, digest string, payload string, size long")
    folder = work_folder(spark, "test-warc")
    warc.write_archives(frame.repartition(3), folder)
    candidates = warc.candidates(spark, folder).count()
    records = warc.read_archives(spark, folder).collect()
    number = lambda urn: urn[len("<urn:page:") : -1]
    found = [
        (number(r.record_id) or "None", r.type, int(number(r.refers_to)) if r.refers_to else None, r.digest, None if r.payload is None else bytes(r.payload).decode())
        for r in records
    ]
    assert sorted(map(str, found)) == plain_records(rows)
    assert candidates > len(records) == len(rows)  # magic inside payloads was met and rejected


def test_no_pages(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    folder = work_folder(spark, "test-warc")
    warc.write_archives(frame, folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_broken_records_are_no_candidates():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    assert [c[:2] for c in warc.candidates_of(good)] == [(0, len(good))]
    for bad in (good[:-2], b"WARC/1.1", b"WARC/1.1\r\nno colon\r\n\r\n", good.replace(b": 2", b": 9"), good.replace(b": 2", b": -2"), b""):
        assert list(warc.candidates_of(bad)) == []
