"""Byte-level BPE encoding by replaying the merges over all distinct words of a batch, and decoding.

An inverted index leads from a merge to the places in the words where its pair stands.  Merges are taken in rank
order; each is applied at all its places, and only the neighbours of these places are looked at again.  Words come
from chunks that the split pattern never crosses; the ids of chunks are kept for later batches.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklog.llm.common import add_columns, held_by_worker
from brooklog.llm.vocabulary import ByteLevelIds


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    """The merges of a rank file."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_ids = [ranks[bytes([b])] for b in range(256)]
        # Every pair of tokens whose bytes together are a token; its rank is that token's id.
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank

    def encode(self, words: Iterable[bytes]) -> list[list[int]]:
        """Ids of each word; a word that is a token itself is that token."""
        out: list[list[int]] = []
        ids: list[int] = []
        word_of: list[int] = []
        starts: list[tuple[int, int, int]] = []
        for number, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out.append([whole])
                continue
            out.append([])
            starts.append((number, len(ids), len(ids) + len(word)))
            ids.extend(map(self.bytes_ids.__getitem__, word))
            word_of.extend([number] * len(word))
        self._replay(ids, word_of)
        for number, a, b in starts:
            out[number] = [i for i in ids[a:b] if i >= 0]
        return out

    def _replay(self, ids: list[int], word_of: list[int]) -> None:
        """Apply all merges in place: a merged place holds the new id, places swallowed hold -1."""
        pairs, n = self.pairs, len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for at in range(n - 1):
            if word_of[at] == word_of[at + 1] and (rank := pairs.get((ids[at], ids[at + 1]))) is not None:
                index.setdefault(rank, []).append(at)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            places.sort()
            # A word in which this merge makes a pair of lower rank waits with its further places until that is merged.
            waits, later = -1, []
            last = -1
            for at in places:
                if at == last:
                    continue
                last = at
                right = after[at]
                if ids[at] < 0 or right >= n or word_of[right] != word_of[at] or pairs.get((ids[at], ids[right])) != rank:
                    continue
                word = word_of[at]
                if word == waits:
                    later.append(at)
                    continue
                ids[at], ids[right] = rank, -1
                beyond = after[right]
                after[at] = beyond
                if beyond < n:
                    before[beyond] = at
                    if word_of[beyond] == word and (new := pairs.get((rank, ids[beyond]))) is not None:
                        if new in index:
                            index[new].append(at)
                        elif new == rank:
                            later.append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(heap, new)
                        if new < rank:
                            waits = word
                left = before[at]
                if left >= 0 and word_of[left] == word and (new := pairs.get((ids[left], rank))) is not None:
                    if new in index:
                        index[new].append(left)
                    elif new == rank:
                        later.append(left)
                    else:
                        index[new] = [left]
                        heapq.heappush(heap, new)
                    if new < rank:
                        waits = word
            if later:
                index[rank] = later
                heapq.heappush(heap, rank)


class ReplayIds(ByteLevelIds):
    """Chunks as for byte-level BPE; each is split into words by the pattern, and the words are merged together."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.merges = MergeReplay(read_ranks(path))
        self.words = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}
        size = max(self.merges.ranks.values()) + 1
        self.token: list[bytes] = [b""] * size
        for token, rank in self.merges.ranks.items():
            self.token[rank] = token

    def new(self, chunks: list[str]) -> list[bytes]:
        cut = [[w.encode() for w in self.words(c)] for c in chunks]
        distinct = list({w for words in cut for w in words})
        found = {w: np.array(ids, "<u4").tobytes() for w, ids in zip(distinct, self.merges.encode(distinct), strict=True)}
        return [b"".join([found[w] for w in words]) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def replay(path: str, pattern: str) -> ReplayIds:
    """The encoder of this worker for a rank file; kept from task to task, with a bounded number of chunks."""
    return held_by_worker((path, pattern), lambda: ReplayIds(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """A row per document: the key, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit); with ``decoded`` also the
    bytes that the ids stand for.

    ``pattern`` must start a new word between a character that is not white space and white space after it, as the
    patterns of byte-level BPE do.  A null or empty text has no ids; repeated rows and null keys stay; an empty table
    gives no rows; other columns are left out.  No shuffle.
    """
    source = docs.select(docs[key], docs[text].cast("string").alias("text_"))

    def run(texts: list[str]) -> list[list]:
        coder = replay(path, pattern)
        ids = coder.encode(texts)
        return [[len(i) // 4 for i in ids], ids, *([[coder.decode(i) for i in ids]] if decoded else [])]

    return add_columns(source, "text_", "n_tokens bigint, ids binary" + ", decoded binary" * decoded, run, [key])


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes of the column ``ids`` (null ids: null).  A column of that name is replaced."""
    @F.pandas_udf("binary")
    def text_of(column: pd.Series) -> pd.Series:
        return column.map(lambda i: None if i is None else replay(path, pattern).decode(bytes(i)))

    return encoded.withColumn("decoded", text_of(ids))
