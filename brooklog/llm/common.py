"""Helpers shared by the operators: Arrow batches in bounded slices, and folders that all executors see."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklog.session import BROADCAST_ROWS, checkpoint_dir

#: Characters of text that one slice of an Arrow batch holds at most (one longer text is a slice of its own).
SLICE_CHARS = 1_000_000
#: Bytes of an Arrow batch that Spark sends to a Python worker (one longer row is a batch of its own).
BATCH_BYTES = 4_000_000
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder; written once by one job, then only read."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send batches of ``BATCH_BYTES`` to Python, unless the session sets a size of its own.

    A batch is held by the executor and by the worker, and the size that Spark comes with is many times that.
    """
    own = spark.conf.get(BATCH_SETTING, None)
    if own is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(BATCH_SETTING)


def through_table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to a shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = folder or work_folder(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: list[tuple[object, object]] = []


def give_back() -> None:
    """Return freed memory to the machine; Arrow's pool and the C library would keep it for this process."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def held_by_worker(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives for ``key``, kept in this worker from task to task until another key is asked for.

    A worker serves the operators of a pipeline in turn; only the cache of the one at work is held, and the memory of
    the one before goes back to the machine.
    """
    if not _HELD or _HELD[0][0] != key:
        if _HELD:
            _HELD.clear()
            give_back()
        _HELD.append((key, make()))
    return _HELD[0][1]


def slices(texts: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that hold about ``chars`` characters each."""
    start = held = 0
    for i, n in enumerate(pc.utf8_length(texts).fill_null(0).to_pylist()):
        if i > start and held + n > chars:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def add_columns(df: DataFrame, text: str, added: str, make: Callable[[list[str]], list[list]], keep: list[str]) -> DataFrame:
    """Map the texts of each Arrow slice to new columns; no shuffle.

    ``make`` gets a list of texts (null becomes empty) and returns one list per column of the DDL ``added``.
    ``keep`` lists the columns that go on beside them.
    """
    extra = T._parse_datatype_string(added)
    kept = list(dict.fromkeys(keep))
    schema = T.StructType([*(df.schema[c] for c in kept), *extra.fields])
    types = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    arrow = [(f.name, types[f.dataType.simpleString()]) for f in extra.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            for start, end in slices(texts):
                # Python's copy of the texts is of one slice only.
                columns = make([t or "" for t in texts.slice(start, end - start).to_pylist()])
                old = [batch.column(i).slice(start, end - start) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*old, *(pa.array(c, t) for c, (_, t) in zip(columns, arrow, strict=True))], names=[*kept, *(n for n, _ in arrow)])

    return df.select(*(df[c] for c in kept), df[text].alias("__text")).mapInArrow(run, schema)


def small_side(df: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast if it was counted to hold at most ``BROADCAST_ROWS`` rows; else a shuffle join serves."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
