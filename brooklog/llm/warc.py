"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Records end in two line breaks, which serve as the line separator of Spark's text writer; archives so go through
Spark's own commit protocol to any store.  Reading: every place with the magic and a well-formed header is a
candidate that points to the record after it; pointer jumping from the start of each file keeps the candidates that
are reached.  A record inside a payload is reached from no record and so goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklog.llm.common import small_side, through_table

END = "\r\n\r\n"
VERSION = "WARC/1.1"
#: Payloads under this size are never revisits.
LEAST_BYTES = 100
#: Records of one file at most; a file is read whole by one task.
RECORDS_PER_FILE = 4000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CANDIDATE = "file string, offset bigint, next bigint, type string, record_id string, refers_to string, uri string, digest string, payload binary"


def _page(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row; of equal payloads of ``LEAST_BYTES`` or more only that of the smallest key is kept.

    A null payload is empty, a null url is empty, line breaks in it become spaces.  A null key never stands for
    others, but may revisit a known one; repeated rows of the smallest key are all responses.  An empty table writes
    no records; other columns are left out.
    """
    rows = pages.select(pages[key].alias("key"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"), F.coalesce(pages[payload].cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    long = rows.filter(F.col("size") >= LEAST_BYTES)
    repeated = long.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    repeated = through_table(repeated, "warc-repeated")
    rows = rows.join(small_side(repeated), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))

    def header(kind: str, length: Column, *more: Column) -> Column:
        lines = [
            F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), _page(F.col("key"))),
            F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", " ")), F.lit(f"WARC-Date: {date}"),
            F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")), *more, F.concat(F.lit("Content-Length: "), length.cast("string")),
        ]
        return F.concat(F.concat_ws("\r\n", *lines), F.lit(END))

    response = F.concat(header("response", F.octet_length(http) + F.col("size"), F.lit("Content-Type: application/http;msgtype=response")), http, F.col("payload"))
    revisit = header("revisit", F.lit(0), F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), _page(F.col("first"))))
    record = F.when(again, revisit).otherwise(response).alias("value")
    rows.select(record).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def fields(data: bytes, at: int) -> tuple[dict[str, bytes], int] | None:
    """The header fields of a record and where its block begins; None if there is no well-formed header."""
    stop = data.find(b"\r\n", at)
    if stop < 0 or not re.fullmatch(rb"WARC/1\.[01]", data[at:stop]):
        return None
    out: dict[str, bytes] = {}
    while True:
        start, stop = stop + 2, data.find(b"\r\n", stop + 2)
        if stop < 0:
            return None
        if stop == start:
            return out, stop + 2
        name, colon, value = data[start:stop].partition(b":")
        if not colon or not re.fullmatch(rb"[!-9;-~]+", name):
            return None
        out[name.decode().lower()] = value.strip()


def candidates_of(data: bytes) -> Iterator[tuple]:
    """(offset, next, type, record id, refers to, uri, digest, payload) of every place that may be a record."""
    text = lambda value: None if value is None else value.decode("utf-8", "replace")
    at = data.find(b"WARC/1.")
    while at >= 0:
        found = fields(data, at)
        if found:
            head, body = found
            length = head.get("content-length", b"")
            end = body + int(length) if length.isdigit() else -1
            if 0 <= end and data[end : end + 4] == b"\r\n\r\n":
                kind, block = text(head.get("warc-type")), data[body:end]
                if kind == "response" and head.get("content-type", b"").startswith(b"application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                digest = (text(head.get("warc-payload-digest")) or "").rpartition(":")[2] or None
                yield at, end + 4, kind, text(head.get("warc-record-id")), text(head.get("warc-refers-to")), text(head.get("warc-target-uri")), digest, None if kind == "revisit" else block
        at = data.find(b"WARC/1.", at + 1)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """All candidate records of the archives in a folder, each with the offset of the record after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.binary()]
        names = ["file", "offset", "next", "type", "record_id", "refers_to", "uri", "digest", "payload"]

        def rows(path: str, held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), *(pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True))], names=names)

        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                held = []
                for row in candidates_of(data.as_py()):
                    held.append(row)
                    if len(held) == 500:
                        yield rows(path.as_py(), held)
                        held = []
                if held:
                    yield rows(path.as_py(), held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).filter("length > 0")
    return files.select("path", "content").mapInArrow(run, CANDIDATE)


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from offset 0 of each file, by pointer jumping.

    ``links`` holds (file, offset, next).  Each round doubles the length of the jumps and of the part of the chain
    that is known, so a chain of n records takes about log2(n) rounds.
    """
    jumps = links.select("file", "offset", "next")
    reached = fresh = jumps.filter("offset = 0").select("file", "offset")
    round_ = 0
    while True:
        round_ += 1
        ahead = reached.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        fresh = through_table(ahead.join(links.select("file", "offset"), ["file", "offset"], "left_semi"), f"warc-reached-{round_}")
        if fresh.isEmpty():
            return reached
        reached = reached.unionByName(fresh)
        then = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("beyond"))
        jumps = through_table(jumps.join(then, ["file", "next"]).select("file", "offset", F.col("beyond").alias("next")), f"warc-jumps-{round_}")


def verified(records: DataFrame) -> DataFrame:
    """The candidates that are records: those reached from the start of their file."""
    kept = through_table(records, "warc-candidates")
    return kept.join(reachable(kept), ["file", "offset"], "left_semi")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in a folder with their payloads (null for revisits)."""
    return verified(candidates(spark, folder))
