"""Flat ids against the library, on texts that split patterns and special tokens treat in special ways."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brooklog.llm import flat_ids
from tests.llm.test_tokens import BYTE, WORD, odd_texts


def spaced_texts(n=3000, seed=1):
    pick = random.Random(seed)
    parts = ["<|endoftext|>", " ", "  ", "\n", "a", "Bc", "\xa0", "　", "'s", "\r\n", "1", "\t", "(x).", "É", "-", "it's", "\x01", "!'ll"]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 15))) for _ in range(n)]


@pytest.mark.parametrize(("path", "kind"), [(WORD, "word"), (BYTE, "byte")])
@pytest.mark.parametrize("texts", [odd_texts(), spaced_texts(), [None, "", None], []], ids=["odd", "spaced", "empty", "none"])
def test_ids_of_the_library(path, kind, texts):
    want = [[*e.ids, 7] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder, got = flat_ids.flat_ids(path, kind), []
    column = pa.array(texts, pa.string())
    for a, b in flat_ids.text_slices(column, 5000):
        ids, at = encoder.encode(column.slice(a, b - a), 7)
        got += [np.frombuffer(x, "<u4").tolist() for x in flat_ids.id_bytes(ids, at).to_pylist()]
    assert got == want


def test_a_cache_that_starts_anew(monkeypatch):
    monkeypatch.setattr(flat_ids, "CACHE_CHUNKS", 20)
    texts = odd_texts(300)
    encoder, got = flat_ids.FlatWordIds(WORD), []
    for a in range(0, len(texts), 10):
        ids, at = encoder.encode(pa.array(texts[a : a + 10]))
        got += [ids[x:y].tolist() for x, y in zip(at, at[1:])]
    assert got == [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]


def test_slices_are_bounded():
    texts = pa.array(["a" * n for n in (3, 3, 50, 0, 4, 5, 1, 9)])
    assert list(flat_ids.text_slices(texts, 10)) == [(0, 2), (2, 3), (3, 7), (7, 8)]
