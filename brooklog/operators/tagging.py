"""Row tags from ordered rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklog import model
from brooklog.functions.javaregex import usable

OPERATORS = ("eq", "neq", "contains", "regex", "exists")
# How a rule is named.
_SIGN = {"eq": "==", "neq": "!=", "contains": "contains", "regex": "matches regex"}


@dataclass(frozen=True)
class Rule:
    field: str
    operator: str
    value: str
    tag: str
    enabled: bool = True

    @property
    def title(self) -> str:
        if self.operator == "exists":
            return f"Rule: {self.field} exists"
        return f'Rule: {self.field} {_SIGN.get(self.operator, self.operator)} "{self.value}"'


# The rules offered at first start.
DEFAULT_RULES = (
    Rule("level", "eq", "ERROR", "red"),
    Rule("level", "eq", "WARN", "yellow"),
    Rule("message", "contains", "error", "red"),
    Rule("message", "contains", "warning", "yellow"),
)


def _test(rule: Rule) -> Column:
    value = model.field(rule.field).cast("string")
    if rule.operator == "exists":
        test = value.isNotNull() & (value != "")
    elif rule.operator == "eq":
        test = F.lower(value) == rule.value.lower()
    elif rule.operator == "neq":
        test = F.lower(value) != rule.value.lower()
    elif rule.operator == "contains":
        test = F.lower(value).contains(rule.value.lower())
    elif rule.operator == "regex":
        pattern = usable(rule.value)
        if pattern is None:
            return F.lit(False)
        test = value.rlike(pattern)
    else:
        return F.lit(False)
    return F.coalesce(test, F.lit(False))


def tag(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Add ``tag`` and ``tag_rule`` of the first enabled rule that matches, else null."""
    name = title = None
    for rule in rules:
        if not rule.enabled:
            continue
        test = _test(rule)
        name = F.when(test, rule.tag) if name is None else name.when(test, rule.tag)
        title = F.when(test, rule.title) if title is None else title.when(test, rule.title)
    nothing = F.lit(None).cast("string")
    return df.withColumns(
        {"tag": nothing if name is None else name, "tag_rule": nothing if title is None else title}
    )


def tag_counts(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    return tag(df, rules).groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
