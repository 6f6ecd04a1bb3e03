"""Packing, counting, merge replay and token files against the libraries."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brooklog.llm import bpe, packing, token_counts, token_files
from brooklog.llm.common import work_folder
from brooklog.llm.vocabulary import chunk_ids

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
RANKS, PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n=3000, seed=5):
    """Random texts of characters that split patterns treat in special ways."""
    pick = random.Random(seed)
    letters = "abz ABZ  \n\n\t.,'s!<>é 　\x1c\x01\x85ΣσÅ9▁😀中文́"
    return ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(n)] + ["<|endoftext|> a<|endoftext|>b", "<s>a</s>", "", " ", "a" * 3000, "theintheerthe" * 500]


@pytest.mark.parametrize(("path", "kind"), [(WORD, "word"), (BYTE, "byte")])
def test_chunks_give_the_ids_of_the_library(path, kind):
    texts = odd_texts()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in chunk_ids(path, kind).encode(texts)] == want


def test_counts_are_those_of_the_library():
    texts = odd_texts()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.piece_counter(PIECES).count(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_replay_gives_the_ids_of_the_library():
    texts = odd_texts()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    own = bpe.replay(RANKS, public_tokenizers.PATTERN)
    ids = own.encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in ids] == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(b).decode() for b in ids] == texts


def test_replay_of_ranks_out_of_order():
    """A pair made by a merge may rank before that merge; words are still merged one by one in the right order."""
    ranks = {bytes([b]): b for b in range(256)} | {b"xa": 300, b"xab": 301, b"ab": 302, b"abab": 299, b"aab": 298}
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    pick = random.Random(2)
    words = ["".join(pick.choice("xab") for _ in range(pick.randint(1, 30))) for _ in range(2000)]
    assert bpe.MergeReplay(ranks).encode([w.encode() for w in words]) == [library.encode_ordinary(w) for w in words]


def test_count_and_encode_odd_rows(table, odd_rows):
    docs = table(odd_rows)
    counted = token_counts.count_tokens(docs, PIECES, limit=100).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [(k, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for k, t in odd_rows]
    assert sorted(map(str, map(tuple, counted))) == sorted(map(str, want))
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted((str(r.doc_id), r.decoded.decode()) for r in encoded) == sorted((str(k), t or "") for k, t in odd_rows)
    again = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).select("doc_id", F.decode("decoded", "utf-8")).collect()
    assert sorted((str(k), t) for k, t in again) == sorted((str(k), t or "") for k, t in odd_rows)
    for empty in (token_counts.count_tokens(table([]), PIECES), bpe.encode(table([]), RANKS, public_tokenizers.PATTERN)):
        assert empty.count() == 0


tokenizer_of = functools.cache(Tokenizer.from_file)


def ids_of(path, text, end):
    return [*tokenizer_of(path).encode(text or "", add_special_tokens=False).ids, end]


def check_packed(rows, pieces, window):
    """Every id lies in one piece, sequences have no gaps and are not over-full."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    whole = {}
    for k, t in rows:
        ids = ids_of(WORD, t, 2)
        whole.setdefault((k, len(ids)), []).append(np.array(ids, "<u4").tobytes())
    assert set(by_doc) == set(whole)
    for key, held in by_doc.items():
        texts = whole[key]
        starts = sorted(p.start for p in held for _ in range(p.length)) if key[1] < 50 else None
        assert sum(p.length for p in held) == len(texts) * key[1]
        assert starts is None or len(starts) == len(texts) * key[1]
        for p in held:
            assert len(p.ids) == 4 * p.length and any(t[4 * p.start : 4 * (p.start + p.length)] == bytes(p.ids) for t in texts)
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(by_sequence)


def test_packing_odd_rows(spark, table, odd_rows):
    pieces = packing.pack(table(odd_rows).repartition(3), WORD, window=512).collect()
    check_packed(odd_rows, pieces, 512)
    assert packing.pack(table([]), WORD).count() == 0


def test_packing_leaves_little_room(table):
    pick = random.Random(4)
    rows = [(i, "word " * pick.randint(1, 300)) for i in range(1500)]
    pieces = packing.pack(table(rows).repartition(8), WORD, window=256, open_windows=8).collect()
    used = check_packed(rows, pieces, 256)
    assert sum(p.length for p in pieces) > 0.95 * 256 * used


def test_best_fit_places():
    windows = packing.OpenWindows(10, 2)
    assert not windows.place(("a",), 6) and not windows.place(("b",), 7)
    assert windows.place(("c",), 3) == [(1, [("b", 0), ("c", 7)])]  # the window where it leaves the least room
    assert not windows.place(("d",), 9)
    assert windows.place(("e",), 5) == [(2, [("d", 0)])]  # none fits: the fullest goes


def test_token_files(spark, table, odd_rows):
    folder = work_folder(spark, "test-token-files")
    token_files.write_token_files(table(odd_rows).repartition(4), folder, BYTE)
    found = token_files.read_token_files(spark, folder).orderBy("start").collect()
    at = 0
    for r in found:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    keys = [r.doc_id for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = sorted((str(k), np.array(ids_of(BYTE, t, 0), "<u4").tobytes()) for k, t in odd_rows)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in found) == want
    some = token_files.read_token_files(spark, folder, [4, 8]).collect()
    assert {(r.doc_id, r.start) for r in some} == {(r.doc_id, r.start) for r in found if r.doc_id in (4, 8)}
    data = [bytes(r.content) for r in token_files.files(spark, folder).collect()]
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(d, read_across_frames=True).read() for d in data)
    assert sorted(plain) == sorted(b"".join(bytes(r.ids) for r in found))  # a plain zstandard stream


def test_damaged_frame_is_seen():
    writer = token_files.FileWriter()
    ids = np.arange(1000, dtype="<u4").tobytes()
    data = b"".join(f + token_files.GAP.encode() for f in (writer.add(3, ids), writer.add(None, b""), writer.table()))
    assert [(d, n, zlib.crc32(i)) for d, _, n, i in token_files.read_documents(data)] == [(3, 1000, zlib.crc32(ids)), (None, 0, 0)]
    assert list(token_files.read_documents(data, {9})) == []
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.read_documents(data[:40] + bytes([data[40] ^ 1]) + data[41:]))
    with pytest.raises(ValueError):
        token_files.read_table(b"something else entirely")


def test_empty_table_writes_no_documents(spark, table):
    folder = work_folder(spark, "test-token-files")
    token_files.write_token_files(table([]), folder, BYTE)
    assert token_files.read_token_files(spark, folder).count() == 0
