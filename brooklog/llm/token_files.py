"""Token files: one zstandard frame per document, then a seek table with a checksum per frame.

A file is a plain zstandard stream that any decoder reads from end to end.  After each frame comes an empty
skippable frame; it is the line separator of Spark's text writer, so files go through Spark's own commit protocol to
any store.  The last frame of a file is a skippable frame with the table and a footer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brooklog.llm.common import small_side, through_table
from brooklog.llm.flat_ids import flat_ids, text_slices

#: An empty skippable frame: number 0x184D2A50, length 0.
GAP = "P*M\x18\x00\x00\x00\x00"
#: Number of the skippable frame with the table, and the end of its footer.
TABLE_FRAME, MAGIC = 0x184D2A5E, b"TOKSEEK1"
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("position", "<u8"), ("size", "<u8"), ("tokens", "<u8"), ("crc", "<u4")])


class FileWriter:
    """The rows of one file: a frame per document, at last the table."""

    def __init__(self) -> None:
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.entries: list[tuple] = []
        self.position = 0

    def add(self, doc: int | None, ids: bytes | memoryview) -> bytes:
        frame = self.compressor.compress(ids)
        self.entries.append((doc or 0, doc is not None, self.position, len(frame), len(ids) // 4, zlib.crc32(ids)))
        self.position += len(frame) + len(GAP)
        return frame

    def table(self) -> bytes:
        body = np.array(self.entries, ENTRY).tobytes() + struct.pack("<Q", len(self.entries)) + MAGIC
        return struct.pack("<II", TABLE_FRAME, len(body)) + body


def read_table(data: bytes) -> np.ndarray:
    """The seek table at the end of a file."""
    end = len(data) - len(GAP)
    if data[end:] != GAP.encode() or data[end - 8 : end] != MAGIC:
        raise ValueError("not a token file")
    (count,) = struct.unpack("<Q", data[end - 16 : end - 8])
    return np.frombuffer(data[end - 16 - count * ENTRY.itemsize : end - 16], ENTRY)


def read_documents(data: bytes, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, int, bytes]]:
    """(doc_id, ids before it in the file, number of ids, ids) of the wanted documents; other frames stay packed."""
    before, unpack = 0, zstandard.ZstdDecompressor()
    for doc, known, position, size, tokens, crc in read_table(data).tolist():
        if wanted is None or (known and doc in wanted):
            ids = unpack.decompress(data[position : position + size], max_output_size=max(4 * tokens, 1)) if tokens else b""
            if zlib.crc32(ids) != crc or len(ids) != 4 * tokens:
                raise ValueError(f"damaged frame of document {doc}")
            yield (doc if known else None), before, tokens, ids
        before += tokens


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", end_id: int = 0, text: str = "text", key: str = "doc_id") -> None:
    """Encode documents and write their ids to files in ascending order of the key.

    The order is total over the files (range partitioning); rows with an equal key may lie in several files and keep
    the order of the input.  A null or empty text is the end id alone; a null key comes first; an empty table writes
    no file; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = flat_ids(tokenizer, kind), FileWriter()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in text_slices(texts):
                ids, at = encoder.encode(texts.slice(a, b - a), end_id)
                data, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), (4 * at).tolist()
                frames = [writer.add(k, data[x:y]) for k, x, y in zip(keys[a:b], ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
        if writer.entries:
            yield pa.RecordBatch.from_arrays([pa.array([writer.table()], pa.binary())], names=["frame"])

    rows = docs.select(docs[key].cast("bigint").alias("key"), docs[text].cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(F.col("key").asc_nulls_first(), "row").sortWithinPartitions(F.col("key").asc_nulls_first(), "row").select("key", "text")
    ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", GAP).option("maxRecordsPerFile", 0).text(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """A row per file with data; each file is read whole by one task."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).filter("length > 8")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(file, before, tokens): the number of ids in each file and in all files before it; one row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [int(read_table(data)["tokens"].sum()) for data in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64())], names=["file", "tokens"])

    totals = through_table(files(spark, folder).select("path", "content").mapInArrow(run, "file string, tokens bigint"), "token-index")
    order = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0).cast("bigint")))


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of the given ones; checksums are verified.

    ``start`` counts the ids of all documents before it in the whole set of files.
    """
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                found = list(read_documents(data.as_py(), wanted))
                for a in range(0, len(found), 500):
                    docs, before, tokens, ids = zip(*found[a : a + 500], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.as_py()] * len(docs)), pa.array(docs, pa.int64()), pa.array(before, pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())],
                        names=["file", "doc_id", "in_file", "n_tokens", "ids"],
                    )

    rows = files(spark, folder).select("path", "content").mapInArrow(run, "file string, doc_id bigint, in_file bigint, n_tokens bigint, ids binary")
    starts = index(spark, folder).select("file", "before")
    return rows.join(small_side(starts), "file").select("doc_id", (F.col("before") + F.col("in_file")).alias("start"), "n_tokens", "ids")
