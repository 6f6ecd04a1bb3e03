"""Token counts of a sentencepiece BPE model by rank-synchronous merging of ragged arrays.

Texts are cut into segments that no piece of the model can cross (a run of spaces and the word after it, or a line
feed).  New segments of a batch lie one after the other in one array; in each round every segment applies its pair of
lowest rank, all at once; what is left at the end is counted.  Counts of short segments are kept for later batches.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklog.llm.common import add_columns, held_by_worker

#: Counts that a worker keeps; at this number it starts anew.
CACHE_SEGMENTS = 1_000_000
CACHE_CHARS = 64
#: Symbols that one call of the merge loop holds at most (a longer segment is alone).
ROUND_SYMBOLS = 2_000_000
NO_RANK = np.iinfo(np.int32).max


class PieceCounter:
    """Ranks of all pairs of a model, and the counts of segments seen."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        own = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in own}
        ranked = sorted(pieces, key=lambda p: -pieces[p])
        rank = {p: r for r, p in enumerate(ranked)}
        # Symbols: 0 is the end of a segment; then the single characters, then the longer pieces.
        chars = sorted({c for p in pieces for c in p})
        symbols = {s: i for i, s in enumerate([*chars, *(p for p in ranked if len(p) > 1)], 1)}
        self.base = len(symbols) + 1
        pairs = {}
        for p in ranked:
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a and b:
                    pairs[a * self.base + b] = (rank[p], symbols[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        # A merge is steady if no pair that it makes can rank before it; all its places may then be merged in one round.
        unsteady = set()
        for p in ranked:
            for cut in range(1, len(p)):
                unsteady.update(s for s in (p[:cut], p[cut:]) if rank.get(s, -1) > rank[p])
        self.steady = np.array([p not in unsteady for p in ranked])
        self.symbol_of = np.full(0x110000, 0, np.int32)
        for c in chars:
            self.symbol_of[ord(c)] = symbols[c]
        self.symbol_of[ord(" ")] = self.symbol_of[ord("▁")]
        # Tokens of a last symbol: one, or its bytes if it is a character outside the model.
        self.cost = np.ones(self.base + 5, np.int64)
        for c in chars:
            if c not in pieces:
                self.cost[symbols[c]] = len(c.encode())
        self.cost[self.base + 1 : self.base + 5] = [1, 2, 3, 4]
        self.cut = re.compile(r"[ ▁]*[^ ▁\n]+|\n|[ ▁]+").findall
        if any("\n" in p or re.search("[^▁]▁", p) for p in pieces):
            self.cut = lambda text: [text]
        self.counts: dict[str, int] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; symbols over the base are characters outside the model."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left < self.base) & (right < self.base)
        return np.where(hit, self.ranks[at], NO_RANK), self.made[at]

    def count_segments(self, segments: list[str]) -> np.ndarray:
        """Tokens of each non-empty segment."""
        text = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")
        width = 1 + (text > 0x7F) + (text > 0x7FF) + (text > 0xFFFF)
        symbols = self.symbol_of[text]
        symbols = np.where(symbols == 0, self.base + width, symbols).astype(np.int32)
        owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        total = np.zeros(len(segments), np.int64)
        joined = np.append(owner[1:] == owner[:-1], False)
        rank, made = self.pair_ranks(symbols, np.append(symbols[1:], 0))
        rank[~joined] = NO_RANK
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(owner))))
            done = best == NO_RANK
            if done.any():
                total += np.bincount(owner[done], self.cost[symbols[done]], len(segments)).astype(np.int64)
                keep = ~done
                symbols, owner, rank, made, best = symbols[keep], owner[keep], rank[keep], made[keep], best[keep]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == best)
            # The first place of each segment; further ones only for steady merges, and never overlapping ones.
            first = np.append(True, owner[at[1:]] != owner[at[:-1]])
            run = np.append(True, at[1:] != at[:-1] + 1) | first
            place = np.arange(len(at))
            even = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0
            at = at[first | (self.steady[rank[at]] & even)]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            at = moved[at]
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            right = np.minimum(touched + 1, len(symbols) - 1)
            new_rank, new_made = self.pair_ranks(symbols[touched], symbols[right])
            new_rank[(touched + 1 >= len(symbols)) | (owner[touched] != owner[right])] = NO_RANK
            rank[touched], made[touched] = new_rank, new_made
        return total

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the library counts them."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        if len(self.counts) > CACHE_SEGMENTS:
            self.counts.clear()
        counts = self.counts
        missing = list({s for segments in cut for s in segments if s not in counts})
        long = []
        start = held = 0
        for i, s in enumerate([*missing, None]):
            if s is None or (held and held + len(s) > ROUND_SYMBOLS):
                if i > start:
                    counts.update(zip(missing[start:i], self.count_segments(missing[start:i]).tolist(), strict=True))
                start, held = i, 0
            if s is not None:
                held += len(s)
                if len(s) > CACHE_CHARS:
                    long.append(s)
        out = [sum(map(counts.__getitem__, segments)) for segments in cut]
        for s in long:
            del counts[s]
        return out


def piece_counter(path: str) -> PieceCounter:
    """The counter of this worker for a model file; kept from task to task."""
    return held_by_worker(("pieces", path), lambda: PieceCounter(path))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: the key, ``n_bytes``, ``n_tokens``, ``over_limit``.

    A null or empty text has no tokens; repeated rows and null keys stay; an empty table gives no rows; other columns
    are left out.  No shuffle: each task counts the texts that it reads.
    """
    source = docs.select(docs[key], docs[text].cast("string").alias("text_"))
    counted = add_columns(source, "text_", "n_bytes bigint, n_tokens bigint", lambda texts: [[len(t.encode()) for t in texts], piece_counter(model).count(texts)], [key])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
