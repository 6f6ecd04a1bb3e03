"""Document fingerprints by a threshold-scaled sketch.

A text's shingles are its runs of ``SHINGLE`` characters (a shorter text is one shingle).  The sketch keeps every
shingle hash below a fixed fraction of the range, and every shorter shingle, so the sketch of a union is the union of
the sketches, and overlaps of very unequal texts can be estimated.  A text whose hashes are all higher has an empty
sketch: a chance of ``(1 - 1 / SCALE) ** n`` with n shingles, 7.5 % at 20 characters, 0.01 % at 43.  Its fingerprint
then holds its length and a digest instead, which tell it apart but are no part of a sketch: it is like an equal text
(1.0) and, as far as can be told, no other (0.0).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 12
#: One of so many hashes is kept.
SCALE = 4
MULTIPLIER = 0x9E3779B97F4A7C15  # odd, golden ratio
MASK = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (the finalizer of splitmix64: fixed values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(text: str) -> np.ndarray:
    """The kept hashes in order, 48 bits each; none for an empty text, or if no hash is low."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if not len(c):
        return c
    power = [np.uint64(pow(MULTIPLIER, i, 1 << 64)) for i in range(9)]
    if len(c) < SHINGLE:
        h = np.uint64(len(c))
        for x in c.tolist():
            h = np.uint64((int(h) * MULTIPLIER + x) & MASK)
        return mixed(np.array([h])) >> np.uint64(16)
    two = c[:-1] * power[1] + c[1:]
    four = two[:-2] * power[2] + two[2:]
    eight = four[:-4] * power[4] + four[4:]
    h = eight[: len(c) - SHINGLE + 1] * power[4] + four[8:]
    h = mixed(h) >> np.uint64(16)
    return np.unique(h[h < np.uint64((1 << 48) // SCALE)])


def as_text(kept: np.ndarray) -> str:
    """A sketch as text: six bytes a hash, in order, base64."""
    return base64.b64encode(kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def fingerprint_of(text: str, kept: np.ndarray) -> str:
    """The sketch of a text as text; of a text that is not empty but has no low hash its length and a digest."""
    if text and not len(kept):
        return f"-{len(text)}-{hashlib.sha256(text.encode('utf-8', 'surrogatepass')).hexdigest()[:32]}"
    return as_text(kept)


def from_text(text: str) -> np.ndarray:
    if text.startswith("-"):
        return np.zeros(0, np.uint64)
    six = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.ascontiguousarray(np.pad(six, ((0, 0), (2, 0)))).view(">u8").reshape(-1).astype(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimates of the resemblance, and of the part of ``a`` that ``b`` contains; two empty sketches are equal."""
    if not len(a) or not len(b):
        return (1.0, 1.0) if len(a) == len(b) else (0.0, 0.0)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both), both / len(a)


def estimates(one: str, other: str) -> tuple[float, float]:
    """``overlap`` of two texts by their fingerprints alone; 1.0 for equal ones."""
    if one == other:
        return 1.0, 1.0
    a, b = from_text(one), from_text(other)
    return overlap(a, b) if len(a) and len(b) else (0.0, 0.0)


def edit(text: str, following: str) -> str:
    """The last third of a text replaced by the head of the text that follows."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """Rows in runs of descending keys, one run (``bucket``) after the other inside each task.

    The first row of the run that comes next is also put behind each run (``borrowed``), behind the last run the very
    first row.  Runs are cut at key quantiles; a null key is in the lowest run.  The driver sees two numbers a run.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = rows.select("key").approxQuantile("key", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = np.array(sorted(set(quantiles)), np.float64)

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        return pd.Series(np.where(known, np.searchsorted(bounds, keys.fillna(0).astype("float64"), "left"), -1)).astype("int32")

    heads = rows.select("key").withColumn("bucket", bucket_of("key")).groupBy("bucket").agg(F.max("key").alias("head")).collect()
    heads.sort(key=lambda r: -r["bucket"])
    # The run before borrows from each run; the last run from the first.
    takes = {r["bucket"]: (heads[i - 1]["bucket"], r["head"]) for i, r in enumerate(heads)}
    table = spark.createDataFrame([(b, to, head) for b, (to, head) in takes.items()], "bucket int, to int, head bigint")
    rows = rows.withColumn("bucket", bucket_of("key")).join(F.broadcast(table), "bucket")  # one row a run
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("borrowed"))
    lent = F.struct(F.col("to").alias("bucket"), F.lit(True).alias("borrowed"))
    both = F.when(F.col("key").eqNullSafe(F.col("head")), F.array(own, lent)).otherwise(F.array(own))
    rows = rows.select("key", "text", F.explode(both).alias("at")).select("key", "text", "at.bucket", "at.borrowed")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "borrowed", F.col("key").desc_nulls_last(), F.xxhash64("text"))


def fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: the key, ``n_chars`` (code points), ``edited`` (its last third replaced by the head of the
    next document in descending order of the key; after the last comes the first), ``fingerprint`` and
    ``edited_fingerprint``, and the estimated resemblance of its fingerprint to the edited text's (``near_edited``)
    and to the next document's (``near_next``); ``contained_edited`` is the part of its shingles in the edited text.

    Keys are numbers.  A null or empty text has no characters and an empty fingerprint, and equals another one (1.0).
    A text without a low hash is told apart by length and digest (see above).  Null keys come last, repeated keys in an order fixed by their texts; an empty table gives no rows; other columns are left out.
    Texts are shuffled once, by key ranges.
    """
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double"
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        # The row that waits for the one after it: its run, key, text and fingerprint; and the run whose end is done.
        waiting: tuple | None = None

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, *kinds[1:]], strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=[key, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t, bucket, borrowed in zip(*(batch.column(i) for i in range(4)), strict=True):
                k, t, bucket, borrowed = k.as_py(), t.as_py(), bucket.as_py(), borrowed.as_py()
                if borrowed and (waiting is None or waiting[0] != bucket):
                    continue
                own = fingerprint_of(t, sketch(t))
                if waiting is not None and waiting[0] == bucket:
                    _, key_, text_, kept = waiting
                    edited = edit(text_, t)
                    other = fingerprint_of(edited, sketch(edited))
                    near, inside = estimates(kept, other)
                    out.append((key_, len(text_), edited, kept, other, near, estimates(kept, own)[0], inside))
                    held += len(text_)
                waiting = None if borrowed else (bucket, k, t, own)
                if held > 2_000_000 or len(out) >= 5000:
                    yield flush(kind)
                    out, held = [], 0
        if out:
            yield flush(kind)

    return in_order(docs, key, text).mapInArrow(run, schema)
