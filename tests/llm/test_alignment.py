"""Alignment of two tokenizers against a plain version that tokenizes every text whole."""

import collections
import functools
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brooklog.llm import alignment
from brooklog.llm.queries import QUERIES
from tests.llm.test_tokens import odd_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@functools.cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    entries = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    return a, entries, sentencepiece.SentencePieceProcessor(model_file=B)


def piece_bytes(model, i):
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def plain(text):
    """(n_a, n_b, groups, links) of one text."""
    tokenizer, entries, model = libraries()
    if not text:
        return 0, 0, "", []
    a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text, num_threads=1)
    want = (" " + text).encode()
    if b"".join(entries[i] for i in a) != want or b"".join(piece_bytes(model, i) for i in b) != want:
        return 0, 0, "", []
    groups, links, x, y, p, q, end_a, end_b = [], [], 0, 0, 0, 0, 0, 0
    while p < len(a) or q < len(b):
        if end_a <= end_b:
            end_a += len(entries[a[p]])
            p += 1
        else:
            end_b += len(piece_bytes(model, b[q]))
            q += 1
        if end_a == end_b:
            groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
            links.append((a[p - 1], b[q - 1]))
            x, y = p, q
    return len(a), len(b), ";".join(groups), links


def plain_rows(rows):
    """The results of all rows, with corpus-wide counts."""
    each = [(k, *plain(t)) for k, t in rows]
    counts = collections.Counter(pair for *_, links in each for pair in links)
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(k, n_a, n_b, len(links), len(links), g, sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)) for k, n_a, n_b, g, links in each]


def got(found):
    return sorted(map(str, ((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in found.collect())))


def test_odd_rows(table, odd_rows):
    docs = table(odd_rows)
    assert got(alignment.align(docs, A, B)) == sorted(map(str, plain_rows(odd_rows)))
    assert alignment.align(table([]), A, B).count() == 0


def test_odd_texts(table):
    pick = random.Random(8)
    parts = ["<|endoftext|>", "<s>", "</s>", " ", "  ", "\n", "a", "Bc", "\xa0", "　", "'s", "\r\n", "1", "\t", ").", "();\r", "{\r", "▁", "x", "é"]
    more = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 15))) for _ in range(1500)]
    rows = list(enumerate(odd_texts(1500) + more))
    assert got(alignment.align(table(rows), A, B)) == sorted(map(str, plain_rows(rows)))


def test_copies_are_aligned_once_and_count_all(table):
    rows = [(i, "the same text, once more") for i in range(200)] + [(500, "another text"), (501, "once more")]
    docs = table(rows)
    texts = alignment.align_texts(docs, A, B)
    assert sorted(r.copies for r in texts.collect()) == [1, 1, 200]
    assert got(alignment.align(docs, A, B)) == sorted(map(str, plain_rows(rows)))


@pytest.mark.parametrize("most", [10**9, 10])
def test_hot_texts_are_broadcast(table, monkeypatch, most):
    """With hot texts, and with hot texts whose groups are too long to be broadcast."""
    monkeypatch.setattr(alignment, "HOT_COPIES", 5)
    monkeypatch.setattr(alignment, "HOT_BYTES", most)
    rows = [(i, ["hot text", "warm text", "cold"][min(i % 10, 2)]) for i in range(60)] + [(99, None), (None, "hot text"), (100, "lone words")]
    assert got(alignment.align(table(rows), A, B)) == sorted(map(str, plain_rows(rows)))


def test_links_are_looked_at_in_slices(table, monkeypatch):
    """A batch of many links is never laid out whole; one text with more of them is a slice of its own."""
    links = pa.array([b"\0" * 4 * n for n in (3, 0, 2, 30, 0, 5, 5, 1)] + [None], pa.binary())
    monkeypatch.setattr(alignment, "SLICE_LINKS", 10)
    bounds = list(alignment.link_slices(links.slice(1), 4))
    assert bounds[-1][1] == 8 and [a for a, _ in bounds] == [0, *(b for _, b in bounds[:-1])]
    held = [sum(len(x or b"") // 4 for x in links.slice(1).slice(a, b - a).to_pylist()) for a, b in bounds]
    assert sum(held) == 43 and all(n <= 10 or n == 30 for n in held)
    assert list(alignment.link_slices(links.slice(0, 0), 4)) == []
    rows = list(enumerate(odd_texts(200)))
    assert got(alignment.align(table(rows), A, B)) == sorted(map(str, plain_rows(rows)))


def test_a_model_that_joins_words_is_refused(monkeypatch):
    class Joins:
        def __init__(self, model_file):
            self.own = libraries()[2]

        def __getattr__(self, name):
            return getattr(self.own, name)

        def id_to_piece(self, i):
            return "a▁b" if i == 1000 else self.own.id_to_piece(i)

    libraries()
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Joins)
    with pytest.raises(ValueError):
        alignment.PieceIds(B)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {r[0]: (*r[1:5], r[6], r[7], hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "") for r in plain_rows(rows)}
    found = QUERIES["op12_alignment"](spark, SF).collect()
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found} == want
