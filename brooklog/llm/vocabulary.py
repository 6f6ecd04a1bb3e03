"""Ids of texts by a tokenizer file, through a bounded cache of the chunks that texts repeat.

A text is cut where the tokenizer always starts anew, so the ids of the text are those of its chunks in a row.
Chunks not in the cache are encoded by the ``tokenizers`` library, many in one call.
"""

from __future__ import annotations

import os
import re

import numpy as np

from brooklog.llm.common import held_by_worker

#: The characters that count as white space in the split pattern of byte-level BPE.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Chunks that a worker keeps; at this number it starts anew.  About 250 MB.
CACHE_CHUNKS = 800_000
#: Longer chunks are not kept.
CACHE_CHARS = 64
#: Chunks joined in one call of the library.
JOIN = 256
#: Stands between joined chunks of a tokenizer that drops white space.
MARK = "\x01"


class ChunkIds:
    """Base: keeps the ids of chunks as bytes, little-endian unsigned 32-bit."""

    chunks_of = staticmethod(re.compile(r"\S+").findall)

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}

    def one_by_one(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def new(self, chunks: list[str]) -> list[bytes]:
        return self.one_by_one(chunks)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [self.chunks_of(t) for t in texts]
        if len(self.kept) > CACHE_CHUNKS:
            self.kept.clear()
        kept = self.kept
        missing = sorted({c for cs in cut for c in cs if c not in kept})
        found = dict(zip(missing, self.new(missing), strict=True))
        kept.update((c, ids) for c, ids in found.items() if len(c) <= CACHE_CHARS)
        long = {c: ids for c, ids in found.items() if len(c) > CACHE_CHARS}
        if long:
            return [b"".join([kept[c] if c in kept else long[c] for c in cs]) for cs in cut]
        return [b"".join(map(kept.__getitem__, cs)) for cs in cut]


class ByteLevelIds(ChunkIds):
    """Byte-level BPE with the usual split pattern: a chunk is a word with one space before it, or a run of white space."""

    chunks_of = staticmethod(re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall)

    def __init__(self, path: str) -> None:
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.lengths[i] = len(piece.encode()) if piece in special else len(piece)

    def new(self, chunks: list[str]) -> list[bytes]:
        """Chunks of white space go alone; words are joined, and the ids are cut where the bytes of the words end."""
        out = dict.fromkeys(chunks, b"")
        alone = [c for c in chunks if c.isspace() or not c.strip(" ")]
        out.update(zip(alone, self.one_by_one(alone), strict=True))
        lone = set(alone)
        words = [c for c in chunks if c not in lone]
        groups = [words[i : i + JOIN] for i in range(0, len(words), JOIN)]
        # A word without its space is put behind a line feed, which is always a token of its own there.
        texts = ["".join([c if c[0] == " " else "\n" + c for c in g]) for g in groups]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, "<u4")
            ends = np.cumsum(self.lengths[ids])
            bare = np.array([c[0] != " " for c in group])
            stops = np.cumsum(np.array([len(c.encode()) for c in group]) + bare)
            at = np.searchsorted(ends, stops)
            starts = np.concatenate([[0], at[:-1] + 1]) + bare
            if at[-1] < len(ends) and (ends[at] == stops).all():
                out.update((c, ids[a : b + 1].tobytes()) for c, a, b in zip(group, starts.tolist(), at.tolist(), strict=True))
            else:
                out.update(zip(group, self.one_by_one(group), strict=True))
        return [out[c] for c in chunks]


class WordIds(ChunkIds):
    """Word BPE that drops white space: a chunk is a run without spaces and line feeds."""

    chunks_of = staticmethod(re.compile("[^ \n]+").findall)

    def __init__(self, path: str) -> None:
        super().__init__(path)
        ids = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else None

    def new(self, chunks: list[str]) -> list[bytes]:
        alone = {c for c in chunks if self.mark is None or MARK in c}
        out = dict(zip(sorted(alone), self.one_by_one(sorted(alone)), strict=True))
        words = [c for c in chunks if c not in alone]
        groups = [words[i : i + JOIN] for i in range(0, len(words), JOIN)]
        texts = [f" {MARK} ".join(g) for g in groups]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, "<u4")
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(group) - 1:
                starts, stops = [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)]
                out.update((c, ids[a:b].tobytes()) for c, a, b in zip(group, starts, stops, strict=True))
            else:
                out.update(zip(group, self.one_by_one(group), strict=True))
        return [out[c] for c in chunks]


def chunk_ids(path: str, kind: str) -> ChunkIds:
    """The encoder of this worker for a file; ``kind`` is ``byte`` or ``word``.  Kept from task to task."""
    return held_by_worker((path, kind), lambda: {"byte": ByteLevelIds, "word": WordIds}[kind](path))
