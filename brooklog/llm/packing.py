"""Packing of tokenized documents into training windows by bounded-space best fit.

Each task keeps a fixed number of open windows.  A document's whole windows are cut off first; the rest goes to the
open window where it leaves the least room.  When none has room, the fullest window is given out and a new one is
opened.  What is still open at the end of a task is merged with the left-over windows of its neighbour tasks, whole
windows at a time, largest first.  Memory: the open windows of a task, and the left-overs of ``MERGE_TASKS`` tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklog.llm.common import through_table
from brooklog.llm.flat_ids import flat_ids, text_slices

WINDOW = 4096
OPEN_WINDOWS = 64
#: Tasks whose left-over windows are merged together.
MERGE_TASKS = 64

PIECES = "start bigint, length bigint, ids binary, doc_tokens bigint, task bigint, window bigint, offset bigint, open boolean"


class OpenWindows:
    """The open windows of a task: (room, number) in order, and the pieces that each holds."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list[tuple]] = {}
        self.next = 0

    def place(self, piece: tuple, length: int) -> list[tuple[int, list[tuple]]]:
        """Put a piece of at most one window where it fits best; returns the windows given out."""
        out = []
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
        else:
            if len(self.rooms) == self.most:
                _, fullest = self.rooms.pop(0)
                out.append((fullest, self.held.pop(fullest)))
            room, number = self.size, self.next
            self.next += 1
            self.held[number] = []
        self.held[number].append((*piece, self.size - room))
        if room == length:
            out.append((number, self.held.pop(number)))
        else:
            insort(self.rooms, (room - length, number))
        return out

    def rest(self) -> list[tuple[int, list[tuple]]]:
        return sorted(self.held.items())


def pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, window: int, most: int, text: str, key: str) -> DataFrame:
    """One row per piece, with the window of its task and whether that window is still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = flat_ids(tokenizer, kind), TaskContext.get().partitionId()
        windows, key_type = OpenWindows(window, most), None

        def rows(done: list[tuple[int, list[tuple]]], still_open: bool) -> pa.RecordBatch:
            flat = [(*piece[:4], piece[4], task, number, piece[5], still_open) for number, held in done for piece in held]
            kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in text_slices(texts):
                done: list[tuple[int, list[tuple]]] = []
                ids, at = encoder.encode(texts.slice(a, b - a), end_id)
                ids = ids.astype("<u4", copy=False)
                for doc, first, last in zip(keys[a:b], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for start in range(0, last - first, window):
                        length = min(window, last - first - start)
                        done += windows.place((doc, start, length, ids[first + start : first + start + length].tobytes(), last - first), length)
                if done:
                    yield rows(done, False)
        for item in windows.rest():
            yield rows([item], True)

    source = docs.select(docs[key], docs[text].cast("string").alias("__text"))
    names = [key, "start", "length", "ids", "doc_tokens", "task", "window", "offset", "open"]
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, {PIECES}")


def merge_left_over(left: pd.DataFrame, window: int) -> pd.DataFrame:
    """Best fit, largest first, over the left-over windows of a bounded number of tasks."""
    left = left.sort_values(["filled", "task", "window"], ascending=[False, True, True])
    rooms: list[tuple[int, int, int]] = []  # room, task and window of the window that takes others in
    to = []
    for task, number, filled in zip(left["task"], left["window"], left["filled"], strict=True):
        at = bisect_left(rooms, (filled, -1, -1))
        room, to_task, to_window = rooms.pop(at) if at < len(rooms) else (window, task, number)
        to.append((task, number, to_task, to_window, window - room))
        if room > filled:
            insort(rooms, (room - filled, to_task, to_window))
    return pd.DataFrame(to, columns=["task", "window", "to_task", "to_window", "base"])


def pack(
    docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 2, window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
    text: str = "text", key: str = "doc_id", folder: str | None = None,
) -> DataFrame:
    """Pack documents into windows of ``window`` tokens.

    Returns a row per piece: the key, ``start`` and ``length`` in the document's ids, ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence.  A null or empty text is the end id alone; a
    null key stays null; repeated rows are packed as often as they occur; a document over a window goes on in
    further windows; an empty table gives no rows; other columns are left out.
    """
    found = through_table(pieces(docs, tokenizer, kind, end_id, window, open_windows, text, key), "packing", folder)
    sequence = (F.shiftleft(F.col("task"), 32) + F.col("window")).alias("sequence_id")
    columns = [key, "start", "length", "ids", "doc_tokens"]
    full = found.filter(~F.col("open")).select(*columns, sequence, "offset")
    left = found.filter("open")
    sizes = left.groupBy("task", "window").agg(F.sum("length").alias("filled"))
    moved = (
        sizes.groupBy(F.floor(F.col("task") / MERGE_TASKS).alias("near"))
        .applyInPandas(lambda pdf: merge_left_over(pdf, window), "task bigint, window bigint, to_task bigint, to_window bigint, base bigint")
    )
    to = (F.shiftleft(F.col("to_task"), 32) + F.col("to_window")).alias("sequence_id")
    merged = left.join(moved, ["task", "window"]).select(*columns, to, (F.col("offset") + F.col("base")).alias("offset"))
    return full.unionByName(merged)
