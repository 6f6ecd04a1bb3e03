"""Regular expressions as the engine that runs them sees them."""

from __future__ import annotations

from functools import lru_cache

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession


def rewrite(pattern: str) -> str:
    """Named groups in the other common spelling, for the JVM."""
    return pattern.replace("(?P<", "(?<")


@lru_cache(maxsize=1024)
def _fault(pattern: str) -> str | None:
    spark = SparkSession.active()
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:  # what the JVM's syntax errors are here
        return str(e).splitlines()[0]
    return None


def usable(pattern: str) -> str | None:
    """The pattern as it can be run, or None if the engine does not take it."""
    own = rewrite(pattern)
    return own if _fault(own) is None else None


def checked(pattern: str, what: str) -> str:
    """The pattern as it can be run; a ValueError that names ``what`` if the engine does not take it."""
    own = rewrite(pattern)
    fault = _fault(own)
    if fault is not None:
        raise ValueError(f"bad {what}: {fault}")
    return own
