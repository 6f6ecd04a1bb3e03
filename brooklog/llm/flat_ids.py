"""Ids of whole Arrow columns of texts: distinct chunks are encoded once, ids are put together as flat arrays.

A text is cut where a run of white space begins, since a tokenizer that never joins a word with the white space after
it starts anew there, and between letters or digits and punctuation (ASCII).  The chunks of a slice are numbered by Arrow's dictionary encoding; only numbers not seen yet by
the worker go to the tokenizer library.  The ids of all texts are then one gather over the ids of the chunks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from brooklog.llm.common import held_by_worker

#: Bytes of text that one slice holds at most (one longer text is a slice of its own).
SLICE_BYTES = 2_000_000
#: Chunks, and ids of chunks, that a worker keeps; at either number it starts anew.
CACHE_CHUNKS, CACHE_IDS = 400_000, 8_000_000
#: Longer chunks are not kept.
CACHE_BYTES = 64
#: Chunks joined in one call of the library.
JOIN = 256
#: Stands between joined chunks of a tokenizer that drops white space.
MARK = "\x01"

# White space of the split pattern of byte-level BPE.  One byte, two bytes, three bytes.
NARROW = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
TWO_BYTES = (0x85, 0xA0)
THREE_BYTES = (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

BETWEEN_WORDS = (0x0A, 0x20)

#: An apostrophe may open a contraction that takes the letters after it along.
NOT_PUNCTUATION = "'"


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts in one array, and the offsets of the texts in it; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return held, at - at[0] if len(at) else np.zeros(1, np.int64)


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that hold about ``size`` bytes each."""
    _, at = flat(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
        yield start, end
        start = end


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of the given lengths, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def between_classes(without: str = "") -> np.ndarray:
    """(last byte, next byte): whether split patterns of words always part the two; not next to ``without``."""
    word = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
    other = np.array([0x20 < i < 0x7F and not word[i] and chr(i) not in NOT_PUNCTUATION + without for i in range(256)])
    return (word[:, None] & other[None, :]) | (other[:, None] & word[None, :])


def wide_spaces(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of white space that UTF-8 writes in two or three bytes."""
    mark = np.zeros(len(data), bool)
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[np.isin(data[two + 1], TWO_BYTES)]
    three = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else two[:0]
    point = ((data[three].astype(np.int32) & 0xF) << 12) | ((data[three + 1].astype(np.int32) & 0x3F) << 6) | (data[three + 2] & 0x3F)
    three = three[np.isin(point, THREE_BYTES)]
    for at, width in ((two, 2), (three, 3)):
        for i in range(width):
            mark[at + i] = True
    return mark


class Chunks:
    """Numbers the chunks of texts; ``learn`` takes in those that have no number yet, in order.

    A chunk is a run of white space and what follows up to the next one.  ``first`` are the characters a run must begin
    with to be cut there; ``spaces`` all that belong to a run (None: the white space of byte-level BPE);
    ``between`` says which two bytes are parted besides.
    """

    def __init__(self, first: tuple[int, ...] | None = None, spaces: tuple[int, ...] | None = None, between: np.ndarray | None = None) -> None:
        self.between = None if between is None else between.ravel()
        self.wide = spaces is None
        self.space = np.zeros(256, bool)
        self.space[list(spaces or NARROW)] = True
        self.first = None
        if first is not None:
            self.first = np.zeros(256, bool)
            self.first[list(first)] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.known = 0

    def full(self) -> bool:
        return len(self.number) > CACHE_CHUNKS

    def learn(self, chunks: list[str]) -> None:
        raise NotImplementedError

    def starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where chunks start."""
        space = self.space[data]
        if self.wide:
            space |= wide_spaces(data)
        start = space.copy() if self.first is None else self.first[data]
        start[1:] &= ~space[:-1]
        if self.between is not None:
            start[1:] |= self.between[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        start[at[:-1][at[:-1] < at[1:]]] = True
        return np.flatnonzero(start)

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each chunk, and where the chunks of each text begin and end."""
        if self.full():
            self.clear()
        data, at = flat(texts)
        starts = self.starts(data, at)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        bounds = np.append(starts, len(data))
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        encoded = chunks.dictionary_encode()
        distinct = encoded.dictionary.to_pylist()
        number = self.number
        own = np.array([number.get(c, -1) for c in distinct], np.int64)
        missing = np.flatnonzero(own < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            own[missing] = np.arange(self.known, self.known + len(new))
            self.known += len(new)
            self.learn(new)
            number.update((c, i) for c, i in zip(new, own[missing].tolist(), strict=True) if len(c) <= CACHE_BYTES)
        return own[encoded.indices.to_numpy().astype(np.int64)], np.searchsorted(starts, at)


class Grown:
    """Arrays end to end, with room to grow."""

    def __init__(self, kind: type) -> None:
        self.held, self.size = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.size], np.zeros(max(self.size, 2 * len(more)), self.held.dtype)])
        self.held[self.size : self.size + len(more)] = more
        self.size += len(more)


class FlatIds(Chunks):
    """Ids of texts by a file of the ``tokenizers`` library."""

    def __init__(self, path: str, plain_specials: bool = False, first: tuple[int, ...] | None = None, spaces: tuple[int, ...] | None = None, between: np.ndarray | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.specials = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        own = between_classes("" if plain_specials else "".join(self.specials))
        super().__init__(first, spaces, own if between is None else own & between)

    def clear(self) -> None:
        super().clear()
        self.ids, self.first_id, self.lengths = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def full(self) -> bool:
        return super().full() or self.ids.size > CACHE_IDS

    def new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks in a row, and how many each has."""
        raise NotImplementedError

    def one_by_one(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def joined(self, chunks: list[str], join: Callable, cut: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Encode many chunks as one text; ``cut`` says how many ids each has, or None if that cannot be told."""
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        groups = [chunks[i : i + JOIN] for i in range(0, len(chunks), JOIN)]
        parts = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([join(g) for g in groups], add_special_tokens=False), strict=True):
            parts.append(cut(np.array(e.ids, np.uint32), group) or self.one_by_one(group))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def learn(self, chunks: list[str]) -> None:
        ids, lengths = self.new(chunks)
        self.first_id.add(self.ids.size + np.cumsum(lengths) - lengths)
        self.lengths.add(lengths)
        self.ids.add(ids)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where those of each text begin and end; ``end_id`` closes each text."""
        codes, bounds = self.codes(texts)
        lengths = self.lengths.held[codes]
        before = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        ids = self.ids.held[ragged(lengths, self.first_id.held[codes])]
        if end_id is None:
            return ids, before
        return np.insert(ids, before[1:], end_id), before + np.arange(len(before))


class FlatByteIds(FlatIds):
    """Byte-level BPE with the usual split pattern."""

    def __init__(self, path: str, plain_specials: bool = False, first: tuple[int, ...] | None = None, between: np.ndarray | None = None) -> None:
        super().__init__(path, plain_specials, first, None, between)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.bytes_of[i] = len(piece.encode()) if piece in self.specials else len(piece)

    def cut_by_bytes(self, ids: np.ndarray, group: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        ends = np.cumsum(self.bytes_of[ids])
        bare = np.array([c[0] not in " \n" for c in group])
        stops = np.cumsum(np.array([len(c.encode()) for c in group]) + bare)
        opened = np.append(0, stops[:-1])[bare] + 1
        at, feeds = np.searchsorted(ends, stops), np.searchsorted(ends, opened)
        if at[-1] != len(ends) - 1 or (ends[at] != stops).any() or (ends[feeds] != opened).any():
            return None
        return np.delete(ids, feeds), np.diff(at, prepend=-1) - bare

    def new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many in one text: behind a word, a chunk that opens with a space or a line feed starts anew, any other one does
        behind a line feed.  Chunks that open or end with other white space go alone."""
        fit = np.array([(c[0] in " \n" or not c[0].isspace()) and not c[-1].isspace() for c in chunks])
        some, apart = ([c for c, f in zip(chunks, fit.tolist(), strict=True) if f is want] for want in (True, False))
        return in_order(fit, (self.joined(some, lambda g: "".join([c if c[0] in " \n" else "\n" + c for c in g]), self.cut_by_bytes), self.one_by_one(apart)))


class FlatWordIds(FlatIds):
    """Word BPE that drops white space; cut only at spaces and line feeds."""

    def __init__(self, path: str, plain_specials: bool = False) -> None:
        super().__init__(path, plain_specials, spaces=BETWEEN_WORDS)
        ids = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else None
        words = json.loads(self.tokenizer.to_str())
        words["normalizer"], words["pre_tokenizer"], words["added_tokens"] = None, None, []
        self.words = type(self.tokenizer).from_str(json.dumps(words))

    def cut_by_marks(self, ids: np.ndarray, group: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(group) - 1:
            return None
        return np.delete(ids, marks), np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1

    def clear(self) -> None:
        super().clear()
        self.bare: dict[str, int] = {}

    def learn(self, chunks: list[str]) -> None:
        """White space around a chunk, and ASCII capitals, change no id: each bare chunk is encoded once."""
        bare = [(c.lower() if c.isascii() else c).strip(" \n") for c in chunks]
        new = list(dict.fromkeys([c for c in bare if c not in self.bare]))
        ids, lengths = self.new(new)
        starts = self.ids.size + np.cumsum(lengths) - lengths
        self.ids.add(ids)
        # A bare chunk is known by the number of the first chunk that held it.
        first = self.known - len(chunks)
        seen = dict.fromkeys(bare)
        for i, c in enumerate(bare):
            if seen[c] is None:
                seen[c] = self.bare.get(c, first + i)
        own = np.array([seen[c] for c in bare], np.int64)
        fresh = own == np.arange(first, first + len(bare))
        for grown, values in ((self.first_id, starts), (self.lengths, lengths)):
            column = np.zeros(len(bare), np.int64)
            column[fresh] = values
            grown.add(column)
            grown.held[first:grown.size][~fresh] = grown.held[own[~fresh]]
        self.bare.update((c, seen[c]) for c in new if len(c) <= CACHE_BYTES)

    def new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words skip the normalizer and the split pattern; others are joined with marks between them."""
        if self.mark is None:
            return self.one_by_one(chunks)
        kinds = np.array([0 if c.isascii() and c.isalpha() else 1 if MARK not in c else 2 for c in chunks], np.int8)
        plain, some, apart = ([c for c, k in zip(chunks, kinds.tolist(), strict=True) if k == want] for want in range(3))
        alone = [e.ids for e in self.words.encode_batch_fast(plain, add_special_tokens=False)]
        found = (np.array([i for ids in alone for i in ids], np.uint32), np.array([len(i) for i in alone], np.int64))
        rest = in_order(kinds[kinds > 0] == 1, (self.joined(some, f" {MARK} ".join, self.cut_by_marks), self.one_by_one(apart)))
        return in_order(kinds == 0, (found, rest))


def in_order(fit: np.ndarray, parts: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of runs (those that ``fit`` and the others) back in the order of ``fit``."""
    (a, a_lengths), (b, b_lengths) = parts
    lengths, starts = np.zeros(len(fit), np.int64), np.zeros(len(fit), np.int64)
    lengths[fit], lengths[~fit] = a_lengths, b_lengths
    starts[fit], starts[~fit] = np.cumsum(a_lengths) - a_lengths, len(a) + np.cumsum(b_lengths) - b_lengths
    return np.concatenate([a, b])[ragged(lengths, starts)], lengths


def flat_ids(path: str, kind: str) -> FlatIds:
    """The encoder of this worker for a file; ``kind`` is ``byte`` or ``word``.  Kept from task to task."""
    return held_by_worker(("flat", path, kind), lambda: {"byte": FlatByteIds, "word": FlatWordIds}[kind](path))


def id_bytes(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of ids as binary values, little-endian unsigned 32-bit."""
    data = np.ascontiguousarray(ids, "<u4")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
