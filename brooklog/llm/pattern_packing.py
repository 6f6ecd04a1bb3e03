"""Best-fit packing by patterns: how often each few-document pattern of lengths is repeated is a least-squares fit.

Pieces are first written with their length and their number among the pieces of that length in their task.  Only the
histogram of lengths, at most one row per length of the window, goes to the driver.  There all patterns of two or three
lengths that fill a window exactly are listed; non-negative least squares finds how often each is to be repeated so that
together they use up the histogram; the repeats are rounded, and what is left is packed by best fit, longest first,
over whole counts of a length.  The plan gives every number of a length its sequence and place; pieces find theirs by
task, length and number, so the ids are not moved while the plan is small, and never ranked in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brooklog.llm.common import small_side, through_table
from brooklog.llm.flat_ids import flat_ids, id_bytes, text_slices

WINDOW = 1024
#: Steps of the fit, and patterns that one step may take up.  They bound the work of the driver, not the result: what
#: the fit leaves over is packed all the same.
FIT_STEPS, FIT_PATTERNS = 60, 64

PIECES = "piece int, start bigint, length bigint, ids binary, doc_tokens bigint, task bigint, nth bigint"


class Placed(NamedTuple):
    """Numbers ``first`` to ``first + count - 1`` of a length: ``each`` of them to a sequence, from ``sequence`` on, the
    first of each at ``offset``."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def few_document_patterns(histogram: np.ndarray) -> np.ndarray:
    """All (a, b, c), a <= b <= c, of lengths that occur and fill the window; a is 0 in a pattern of two."""
    window = len(histogram) - 1
    there = histogram > 0
    there[0], there[window] = True, False  # 0 stands for no third document; a full piece needs no partner
    lengths = np.flatnonzero(there[: window // 2 + 1])
    a, b = np.repeat(lengths, len(lengths)), np.tile(lengths, len(lengths))
    c = window - a - b
    fit = (a <= b) & (b <= c) & (b > 0)
    fit[fit] = there[c[fit]]
    return np.stack([a[fit], b[fit], c[fit]], axis=1)


def products(patterns: np.ndarray, others: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Inner products of the columns of patterns: the squared weights of the lengths that two have in common."""
    out = np.zeros((len(patterns), len(others)))
    for one in patterns.T:
        for other in others.T:
            out += np.where(one[:, None] == other[None, :], square[one][:, None], 0.0)
    return out


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS, at_once: int = FIT_PATTERNS) -> np.ndarray:
    """Non-negative least squares: repeats of the patterns whose lengths come nearest to the histogram.

    An active-set method on the normal equations: each step takes up the patterns along which the misfit falls most,
    solves for those in use, and drops what becomes negative.  The best repeats of all steps are kept.  A length's
    misfit counts by the length, since long ones are hard to place.
    """
    size = len(histogram)
    square = (np.arange(size) / size) ** 2
    aim = (histogram * square)[patterns].sum(axis=1)
    use, repeats, gram = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0))
    best, least = np.zeros(len(patterns)), np.inf
    misfit = histogram.astype(float)
    for _ in range(steps):
        slope = (misfit * square)[patterns].sum(axis=1)
        slope[use] = -np.inf
        taken, held = [], np.zeros(size, bool)
        for p in np.argsort(-slope, kind="stable")[: 8 * at_once].tolist():
            a, b, c = patterns[p]
            if len(taken) < at_once and slope[p] > 1e-9 * histogram.max() and not (held[b] or held[c] or (a and held[a])):
                held[[a, b, c]] = True
                taken.append(p)
        if not taken:
            break
        across, within = products(patterns[use], patterns[taken], square), products(patterns[taken], patterns[taken], square)
        gram, use = np.block([[gram, across], [across.T, within]]), np.append(use, taken)
        while len(use):
            repeats = np.linalg.solve(gram + 1e-9 * np.eye(len(use)), aim[use])
            stay = repeats > 0
            if stay.all():
                break
            use, gram = use[stay], gram[np.ix_(stay, stay)]
        made = np.bincount(patterns[use].ravel(), np.repeat(repeats, 3) if len(use) else None, size) if len(use) else np.zeros(size)
        misfit = histogram - made
        left = float(np.sum(square * misfit**2))
        if left < least:
            best = np.zeros(len(patterns))
            best[use] = repeats
        if left > least * (1 - 1e-3):
            break
        least = left
    return best


def whole_repeats(patterns: np.ndarray, repeats: np.ndarray, histogram: np.ndarray, least: float = 0.5) -> tuple[list[tuple[int, tuple]], np.ndarray]:
    """The repeats of ``least`` and more rounded, never more than there are pieces; and the histogram that is left."""
    left, out = histogram.copy(), []
    for p in np.argsort(-repeats, kind="stable").tolist():
        if repeats[p] < least:
            break
        lengths, each = np.unique(patterns[p][patterns[p] > 0], return_counts=True)
        times = int(min(round(repeats[p]), (left[lengths] // each).min()))
        if times:
            left[lengths] -= times * each
            out.append((times, tuple(zip(lengths[::-1].tolist(), each[::-1].tolist(), strict=True))))
    return out, left


def best_fit(histogram: np.ndarray) -> list[tuple[int, tuple]]:
    """Best fit, longest first, over counts: (repeats, ((length, how many), ...)) of every kind of sequence."""
    window = len(histogram) - 1
    rooms: list[int] = []
    kinds: dict[int, list[tuple[int, tuple]]] = {}
    full: list[tuple[int, tuple]] = []

    def put(room: int, kind: tuple[int, tuple]) -> None:
        if not room:
            full.append(kind)
        elif room in kinds:
            kinds[room].append(kind)
        else:
            kinds[room] = [kind]
            insort(rooms, room)

    for length in range(window, 0, -1):
        left = int(histogram[length])
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                times, held = kinds[room].pop()
                if not kinds[room]:
                    del kinds[room], rooms[at]
            else:
                room, times, held = window, left, ()
            most = min(room // length, left)
            used = min(times, left // most)
            put(room - most * length, (used, (*held, (length, most))))
            if times > used and held:
                put(room, (times - used, held))
            left -= used * most
    return full + [kind for room in rooms for kind in kinds[room]]


def kinds_of(histogram: np.ndarray) -> list[tuple[int, tuple]]:
    """(repeats, ((length, how many), ...)) of every kind of sequence: the fitted patterns, then the rest by best fit.

    Patterns that are repeated a few times only may fit worse than the best fit of their pieces, so the bound from
    which a pattern counts is doubled as long as there are patterns, and the packing of fewest sequences is taken.
    """
    patterns = few_document_patterns(histogram)
    repeats = fit_repeats(patterns, histogram.astype(float)) if len(patterns) else np.zeros(0)
    best, least = None, 0.5
    while best is None or least <= repeats.max(initial=0):
        fitted, left = whole_repeats(patterns, repeats, histogram, least)
        kinds = fitted + best_fit(left)
        if best is None or sum(n for n, _ in kinds) < sum(n for n, _ in best):
            best = kinds
        least *= 2
    return best


def plan(histogram: np.ndarray) -> list[Placed]:
    """Where the pieces of each length go; ``histogram[i]`` is the number of pieces of length i, up to the window."""
    placed, used, sequence = [], np.zeros(len(histogram), np.int64), 0
    for times, held in kinds_of(histogram):
        offset = 0
        for length, each in held:
            placed.append(Placed(length, int(used[length]), times * each, sequence, each, offset))
            used[length] += times * each
            offset += length * each
        sequence += times
    return sorted(placed)


def cut(totals: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces: whole windows, only the first piece may be shorter."""
    pieces = -(-totals // window)
    doc = np.repeat(np.arange(len(totals)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = totals - (pieces - 1) * window
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * window)
    return doc, piece, start, np.where(piece == 0, first[doc], window)


def numbered(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The number of each piece among those of its length; ``counts`` goes on from call to call."""
    order = np.argsort(lengths, kind="stable")
    along = lengths[order]
    begin = np.flatnonzero(np.append(True, along[1:] != along[:-1]))
    nth = np.empty(len(lengths), np.int64)
    nth[order] = np.arange(len(along)) - np.repeat(begin, np.diff(np.append(begin, len(along)))) + counts[along]
    counts += np.bincount(lengths, minlength=len(counts))
    return nth


def pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, window: int, text: str, key: str) -> DataFrame:
    """One row per piece, with its number among the pieces of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, counts = flat_ids(tokenizer, kind), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in text_slices(texts):
                ids, at = encoder.encode(texts.slice(a, b - a), end_id)
                totals = np.diff(at)
                doc, piece, start, length = cut(totals, window)
                nth = numbered(length, counts)
                columns = [
                    keys.slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), id_bytes(ids, np.append(at[doc] + start, at[-1])),
                    pa.array(totals[doc]), pa.array(np.full(len(doc), task, np.int64)), pa.array(nth),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(docs[key], docs[text].cast("string").alias("__text"))
    names = [key, "piece", "start", "length", "ids", "doc_tokens", "task", "nth"]
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, {PIECES}")


def places(counts: DataFrame, placed: list[Placed]) -> DataFrame:
    """(task, length, since, upto, skip, sequence, each, place): numbers ``since`` to ``upto - 1`` of a length in a task.

    ``counts`` has a row per task and length.  Number ``nth`` is in sequence ``sequence + (nth + skip) / each``.
    """
    table = np.array(placed, np.int64).reshape(-1, len(Placed._fields))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One order of (length, number) for all ranges of the plan.
        starts = [(int(length), int(first)) for length, first in table[:, :2]]
        for frame in frames:
            out = []
            for task, length, n, base in frame[["task", "length", "n", "base"]].itertuples(index=False):
                at = bisect_left(starts, (length, base + 1)) - 1
                while at < len(starts) and starts[at] < (length, base + n):
                    _, first, count, sequence, each, offset = table[at].tolist()
                    out.append((task, length, max(first - base, 0), min(first + count - base, n), base - first, sequence, each, offset))
                    at += 1
            yield pd.DataFrame(out, columns=["task", "length", "since", "upto", "skip", "sequence", "each", "place"])

    return ranges.mapInPandas(run, "task bigint, length bigint, since bigint, upto bigint, skip bigint, sequence bigint, each bigint, place bigint")


def pack(
    docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, window: int = WINDOW, text: str = "text", key: str = "doc_id", folder: str | None = None,
) -> DataFrame:
    """Pack documents into as few sequences of ``window`` tokens as the patterns and the best fit of the rest find.

    Returns a row per piece: the key, ``piece``, ``start`` and ``length`` in the document's ids, ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence, without gaps.  Only documents of
    more than a window are cut: into whole windows, the first piece may be shorter.  A null or empty text is the end
    id alone; a null key stays null; repeated rows are packed as often as they occur; an empty table gives no rows;
    other columns are left out.
    """
    found = through_table(pieces(docs, tokenizer, kind, end_id, window, text, key), "pattern-packing", folder)
    counts = through_table(found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pattern-counts")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most a row per length of the window
        histogram[length] = n
    where = through_table(places(counts, plan(histogram)), "pattern-places")
    inside = found.join(small_side(where), ["task", "length"]).filter((F.col("nth") >= F.col("since")) & (F.col("nth") < F.col("upto")))
    number = F.col("nth") + F.col("skip")
    sequence = (F.col("sequence") + F.floor(number / F.col("each"))).alias("sequence_id")
    offset = (F.col("place") + F.pmod(number, F.col("each")) * F.col("length")).alias("offset")
    return inside.select(key, "piece", "start", "length", "ids", "doc_tokens", sequence, offset)
