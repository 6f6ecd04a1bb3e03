"""Text and number views of a field."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of letters, digits and underscores, lower-cased.
TOKEN_CHAR = r"[\p{L}\p{N}_]"
TOKEN_GAP = r"[^\p{L}\p{N}_]+"

# Text that counts as a number: optional sign, decimal digits, optional exponent.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def tokens(text: Column) -> Column:
    """All tokens of a text, in order."""
    return F.filter(F.split(F.lower(text), TOKEN_GAP), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    """The same cut applied to a literal on the driver."""
    kept = [c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in text.lower()]
    return "".join(kept).split()


def num(text: Column) -> Column:
    """Numeric view of a text field; text that is not a plain number gives null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))
