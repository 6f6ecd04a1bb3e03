import pytest
from pyspark.sql import types as T

#: Names that the operators use themselves; as extra columns they must not disturb.
CLASHING = (
    "text_", "__text", "ids", "start", "length", "task", "window", "offset", "open", "frame", "value", "row", "id", "same", "signature",
    "n_shingles", "component_id", "kept", "blob", "spans", "path", "chosen", "spans_", "bucket", "borrowed", "edited", "n_tokens", "n_bytes",
    "host", "declared", "letters", "t0", "lang_", "file", "next", "payload", "digest", "k_", "gone_", "blob_", "gap", "size", "n_chars_",
)

LONG = "lorem ipsum dolor " * 3000 + "x" * 70_000


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text) rows, with the columns of the real table and clashing ones."""

    def make(rows, more=()):
        schema = T.StructType(
            [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
            + [T.StructField(c, T.StringType()) for c in CLASHING]
        )
        full = [(k, t, "en", None if k is None else f"s{k % 2}", None if t is None else len(t), *["?"] * len(CLASHING)) for k, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, odd characters."""
    return [
        (1, "hello world of words"), (2, None), (3, ""), (4, LONG), (1, "hello world of words"), (None, "a text without a key"), (None, None),
        (5, "hello world of words"), (6, "   \n\t "), (7, "é́ 中文 😀 \x00\x01 <|endoftext|> <s> ▁ 　\x85"), (8, "one"), (-9, "ONE"),
    ]
