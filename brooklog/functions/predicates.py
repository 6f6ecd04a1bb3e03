"""Search predicates as boolean Columns.

Combine them with ``all_of``, ``any_of`` and ``none_of`` or with ``&``, ``|``, ``~``.
``field`` is a field name, a Column, or None for "any searchable field".  Whole-word
tests use one regular expression on the lower-cased text behind a cheap substring
test, so they stay inside generated code and build no token arrays; only fuzzy and
term-regex tests walk the tokens.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brooklog import model
from brooklog.functions.text import TOKEN_CHAR, num, query_tokens, tokens

# Joins the fields of a row for any-field tests; a noncharacter, so no text holds it.
FIELD_BREAK = "\uffff"
WORD_GAP = r"[^\p{L}\p{N}_" + FIELD_BREAK + r"]+"

Field = str | Column | Sequence[Column] | None


def searchable_text() -> Column:
    """Every searchable field of a log row in one string."""
    return F.concat_ws(FIELD_BREAK, F.col("_raw"), F.col("_src"), F.col("error"), F.map_values("attrs"))


def _text(where: Field) -> Column:
    if where is None:
        return searchable_text()
    if isinstance(where, (str, Column)):
        return model.field(where)
    return F.concat_ws(FIELD_BREAK, *where)


def _sure(test: Column) -> Column:
    """A missing field is a plain non-match, so that negation works."""
    return F.coalesce(test, F.lit(False))


def _whole(body: str) -> str:
    return f"(?<!{TOKEN_CHAR})(?:{body})(?!{TOKEN_CHAR})"


def match_all() -> Column:
    return F.lit(True)


def term(word: str, field: Field = None) -> Column:
    """The field holds the word.  A word that cuts into several tokens matches on any of them."""
    text = F.lower(_text(field))
    tests = [text.contains(t) & text.rlike(_whole(t)) for t in query_tokens(word)]
    return _sure(reduce(Column.__or__, tests)) if tests else F.lit(False)


def phrase(words: str, field: Field = None, fuzziness: int = 0) -> Column:
    """The tokens stand next to each other, in order, inside one field."""
    wanted = query_tokens(words)
    if not wanted:
        return F.lit(False)
    if fuzziness <= 0:
        text = F.lower(_text(field))
        tests = [text.contains(t) for t in dict.fromkeys(wanted)]
        return _sure(reduce(Column.__and__, tests) & text.rlike(_whole(WORD_GAP.join(wanted))))

    def near(have: Column) -> Column:
        def starts_at(i: Column) -> Column:
            steps = [
                F.levenshtein(F.element_at(have, i + F.lit(j)), F.lit(t), fuzziness) >= 0
                for j, t in enumerate(wanted)
            ]
            return reduce(Column.__and__, steps)

        starts = F.sequence(F.lit(1), F.size(have) - F.lit(len(wanted) - 1))
        return F.when(F.size(have) >= len(wanted), F.exists(starts, starts_at)).otherwise(F.lit(False))

    # The tokens are bound to a lambda variable, so each field is cut into tokens once.
    return _sure(F.exists(F.transform(F.split(_text(field), FIELD_BREAK), tokens), near))


def wildcard(pattern: str, field: Field = None) -> Column:
    """``*`` stands for any run of token characters, ``?`` for one; the whole token must fit."""
    body, literals, run = "", [], ""
    for c in pattern.lower():
        if c in "*?":
            body += TOKEN_CHAR + ("*" if c == "*" else "")
            literals.append(run)
            run = ""
        elif c == "_" or query_tokens(c):
            body += c
            run += c
        else:
            return F.lit(False)
    literals.append(run)
    text = F.lower(_text(field))
    test = text.rlike(_whole(body))
    longest = max(literals, key=len)
    return _sure(text.contains(longest) & test if longest else test)


def regex(pattern: str, field: Field = None, on: str = "term") -> Column:
    """Regular expression over single tokens (``on='term'``) or over the raw text (``on='text'``)."""
    if on == "text":
        return _sure(_text(field).rlike(pattern))
    if on != "term":
        raise ValueError(f"on must be 'term' or 'text', not {on!r}")
    return _sure(F.exists(tokens(_text(field)), lambda t: t.rlike(f"^(?:{pattern})$")))


def fuzzy(word: str, distance: int = 1, field: Field = None) -> Column:
    """Some token is within ``distance`` edits of the word."""
    w = word.lower()
    return _sure(
        F.exists(
            tokens(_text(field)),
            lambda t: (F.abs(F.length(t) - F.lit(len(w))) <= distance) & (F.levenshtein(t, F.lit(w), distance) >= 0),
        )
    )


def num_range(
    field: str | Column,
    gt: float | None = None,
    ge: float | None = None,
    lt: float | None = None,
    le: float | None = None,
) -> Column:
    """Numeric range; an open side is unbounded and text values never match."""
    value = num(model.field(field))
    tests = [value.isNotNull()]
    tests += [value > gt] if gt is not None else []
    tests += [value >= ge] if ge is not None else []
    tests += [value < lt] if lt is not None else []
    tests += [value <= le] if le is not None else []
    return _sure(reduce(Column.__and__, tests))


def num_eq(value: float, field: str | Column | None = None) -> Column:
    """Numeric equality on a field, or on any field (a bare number also matches as a word)."""
    if field is not None:
        return _sure(num(model.field(field)) == F.lit(float(value)))
    word = str(int(value)) if float(value).is_integer() else str(value)
    in_attrs = F.exists(F.map_values("attrs"), lambda v: F.coalesce(num(v) == F.lit(float(value)), F.lit(False)))
    return term(word) | _sure(in_attrs)


def ts_range(
    gt: dt.datetime | None = None,
    ge: dt.datetime | None = None,
    lt: dt.datetime | None = None,
    le: dt.datetime | None = None,
) -> Column:
    """Comparison on ``timestamp``; plain, so Parquet can skip row groups."""
    ts = F.col("timestamp")
    bounds = ((gt, Column.__gt__), (ge, Column.__ge__), (lt, Column.__lt__), (le, Column.__le__))
    tests = [op(ts, model.moment(bound)) for bound, op in bounds if bound is not None]
    return reduce(Column.__and__, tests) if tests else F.lit(True)


def in_window(start: dt.datetime, end: dt.datetime, prune: bool = True) -> Column:
    """Time window, both ends included.  With ``prune`` the day partition is bounded too."""
    if model.in_utc(end) < model.in_utc(start):
        return F.lit(False)
    exact = F.col("timestamp").between(model.moment(start), model.moment(end))
    if not prune:
        return exact
    return F.col("log_date").between(F.lit(model.day_of(start)), F.lit(model.day_of(end))) & exact


def default_window(now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """Window used when none is asked: the last calendar year up to now."""
    from brooklog.functions.relative import shift_months

    return shift_months(now, -12), now


def from_sources(names: Sequence[str] | None, exact: bool = True) -> Column:
    """Rows of the named sources.  None means all; an empty list means none."""
    if names is None:
        return F.lit(True)
    wanted = list(dict.fromkeys(n.strip() for n in names if n.strip()))
    if not wanted:
        return F.lit(False)
    if exact:
        return F.col("_src").isin(wanted)
    return reduce(Column.__or__, [phrase(n, "_src") for n in wanted])


def all_of(*tests: Column) -> Column:
    return reduce(Column.__and__, tests, F.lit(True))


def any_of(*tests: Column) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def none_of(*tests: Column) -> Column:
    return ~_sure(any_of(*tests))
