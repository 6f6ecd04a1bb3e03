"""Field extraction over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brooklog import model
from brooklog.operators.ordering import NO_SOURCE
from brooklog.session import BROADCAST_ROWS, settle
from brooklog.functions.grok import CUT, DEFAULT, Pattern, compile_grok, fields_of, rewrite

# What smart decoding looks for in a line, and a text every hit contains.  The look-behind and
# the possessive run keep the e-mail scan linear on long words.
SMART = {
    "_ipv4_addr": (r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b", "."),
    "_email_addr": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "@"),
    "_urls": (r"\bhttps?://[^\s\"'<>]+", "://"),
    "_mac_addr": (r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", ""),
    "_uuids": (r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b", "-"),
}


def extract_first(df: DataFrame, patterns: Sequence[Pattern], chosen: Column | None = None) -> DataFrame:
    """Add ``attrs``, ``matched``, ``pattern`` and ``error`` from the first pattern that matches ``_raw``.

    Higher priority goes first, list order breaks ties.  A line no pattern matches keeps
    its text as ``message`` and says so in ``error``.  With ``chosen``, the name of a
    pattern per row, only that pattern is tried on the row.
    """
    ordered = sorted(patterns, key=lambda p: -p.priority)
    compiled = [compile_grok(p.pattern, p.custom_patterns) for p in ordered]
    rewritten = F.col("_raw")
    if chosen is None:
        for i, c in enumerate(compiled):
            rewritten = rewrite(rewritten, c, str(i))
    else:
        for i, (p, c) in enumerate(zip(ordered, compiled)):
            rewritten = F.when(chosen == p.name, rewrite(F.col("_raw"), c, str(i))).otherwise(rewritten)
    parts = F.col("_parts")
    tag = F.get(parts, 1)
    attrs, name = None, None
    for i, (p, c) in enumerate(zip(ordered, compiled)):
        hit = tag == str(i)
        attrs = F.when(hit, fields_of(parts, c)) if attrs is None else attrs.when(hit, fields_of(parts, c))
        name = F.when(hit, p.name) if name is None else name.when(hit, p.name)
    only = ordered[0].name if len(ordered) == 1 else ""
    failure = f"Log line did not match the '{only}' pattern" if only else "Log line did not match any configured pattern"
    return (
        df.withColumn("_cut", rewritten)
        .withColumn("matched", F.col("_cut").startswith(CUT))
        .withColumn("_parts", F.when(F.col("matched"), F.split("_cut", CUT, -1)))
        .withColumns(
            {
                "attrs": F.when(F.col("matched"), attrs).otherwise(F.create_map(F.lit("message"), F.col("_raw"))),
                "pattern": name,
                "error": F.when(~F.col("matched"), failure),
            }
        )
        .drop("_cut", "_parts")
    )


def extract_suggested(df: DataFrame, patterns: DataFrame | Sequence[Pattern]) -> DataFrame:
    """``extract_first`` with each source's own best pattern (see ``suggest``); a source that none fits matches nothing.

    The choice is a small table with a row per source; hot sources are split by the join.
    """
    known = library(patterns)
    if len({p.name for p in known}) < len(known):
        raise ValueError("patterns to choose from need names of their own")
    best = settle(suggest(df, known).select(F.coalesce("_src", F.lit(NO_SOURCE)).alias("_best_src"), F.col("name").alias("_best")))
    small = best.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = df.join(F.broadcast(best) if small else best, F.coalesce("_src", F.lit(NO_SOURCE)) == F.col("_best_src"), "left")
    return extract_first(named, known, F.col("_best")).drop("_best", "_best_src")


def extract(
    df: DataFrame, pattern: str = DEFAULT, custom_patterns: Mapping[str, str] | None = None, name: str = ""
) -> DataFrame:
    """Extraction with one pattern."""
    return extract_first(df, [Pattern(name, pattern, custom_patterns=custom_patterns or {})]).drop("pattern")


def split_matched(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("matched"), df.filter("not matched")


def parse_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("_src").agg(
        F.count_if("matched").alias("processed"), F.count_if(~F.col("matched")).alias("failed")
    )


def library(patterns: DataFrame | Sequence[Pattern]) -> list[Pattern]:
    """A pattern library from a table (name, pattern, and the optional columns of Pattern), written by hand."""
    if not isinstance(patterns, DataFrame):
        return list(patterns)
    rows = patterns.collect()  # each pattern becomes an expression of the plan
    known = set(Pattern.__dataclass_fields__)
    return [Pattern(**{k: v for k, v in r.asDict().items() if k in known and v is not None}) for r in rows]


def pattern_hits(df: DataFrame, patterns: DataFrame | Sequence[Pattern]) -> DataFrame:
    """Line counts per source and per set of matching patterns: ``_src, hits, n``.

    One scan; every line is reduced to the set of patterns it fits before the shuffle.
    """
    tests = [
        F.when(F.col("_raw").rlike(compile_grok(p.pattern, p.custom_patterns).regex), i)
        for i, p in enumerate(library(patterns))
    ]
    return (
        df.select("_src", F.array_compact(F.array(*tests)).alias("hits"))
        .groupBy("_src", "hits")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def suggest(df: DataFrame, patterns: DataFrame | Sequence[Pattern]) -> DataFrame:
    """Best single pattern of each source: name, coverage and its time hint.

    Sources no pattern fits are left out.  Ties go to the higher priority, then the name.
    """
    known = library(patterns)
    hits = pattern_hits(df, known)
    per_pattern = hits.select("_src", F.explode("hits").alias("i"), "n").groupBy("_src", "i").agg(F.sum("n").alias("n"))
    order = sorted(range(len(known)), key=lambda i: (-known[i].priority, known[i].name))
    rank = F.array(*[F.lit(order.index(i)) for i in range(len(known))])
    best = per_pattern.groupBy("_src").agg(
        F.max(F.struct(F.col("n"), (-F.get(rank, F.col("i"))).alias("r"), F.col("i"))).alias("b")
    )
    totals = hits.groupBy("_src").agg(F.sum("n").alias("total"))

    def of(values: Sequence[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("b.i"))

    return best.join(totals, "_src").select(
        "_src",
        of([p.name for p in known]).alias("name"),
        (F.col("b.n") / F.col("total")).alias("coverage"),
        of([p.timestamp_field for p in known]).alias("timestamp_field"),
        of([p.timestamp_layout for p in known]).alias("timestamp_layout"),
    )


def suggest_multi(df: DataFrame, patterns: DataFrame | Sequence[Pattern], k: int | None = None) -> DataFrame:
    """Pattern set of each source by greedy cover: ``_src, rank, name, coverage, combined``.

    The lines are first reduced to counts per set of matching patterns, so each round
    works on a small table: it picks the pattern that explains most of what is left and
    drops the sets it covers.  Coverage is the newly covered share, ``combined`` the sum
    so far.  Without ``k`` it goes on until no pattern explains anything more.
    """
    known = library(patterns)
    order = sorted(range(len(known)), key=lambda i: (-known[i].priority, known[i].name))
    rank = F.array(*[F.lit(order.index(i)) for i in range(len(known))])
    names = F.array(*[F.lit(p.name) for p in known])
    hits = pattern_hits(df, known)
    left = hits.withColumn("total", F.sum("n").over(Window.partitionBy("_src"))).filter(F.size("hits") > 0)
    left = left.withColumn("chosen", F.array().cast("array<struct<i:int,n:bigint>>"))
    # Every round keeps all sets and marks the choice on them; a set is used up once a chosen pattern is in it.
    for _ in range(len(known) if k is None else min(k, len(known))):
        used = F.exists("chosen", lambda c: F.array_contains(F.col("hits"), c["i"]))
        fresh = F.when(~used, F.col("n")).otherwise(F.lit(0))
        per = [
            F.struct(
                F.sum(F.when(F.array_contains("hits", i), fresh).otherwise(0)).over(Window.partitionBy("_src")).alias("n"),
                (-F.get(rank, F.lit(i))).alias("r"),
                F.lit(i).alias("i"),
            )
            for i in range(len(known))
        ]
        left = left.withColumn("best", F.array_max(F.array(*per)))
        if k is None:
            left = settle(left)  # a row per source and set of patterns
            if left.filter("best.n > 0").isEmpty():
                left = left.drop("best")
                break
        grown = F.concat("chosen", F.array(F.struct(F.col("best.i").alias("i"), F.col("best.n").alias("n"))))
        left = left.withColumn("chosen", F.when(F.col("best.n") > 0, grown).otherwise(F.col("chosen"))).drop("best")
    done = left.groupBy("_src").agg(F.first("chosen").alias("chosen"), F.first("total").alias("total"))
    rows = done.select("_src", "total", "chosen", F.posexplode("chosen").alias("pos", "c"))
    so_far = F.aggregate(F.slice("chosen", F.lit(1), F.col("pos") + 1), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    return rows.select(
        "_src",
        (F.col("pos") + 1).alias("rank"),
        F.get(names, F.col("c.i")).alias("name"),
        (F.col("c.n") / F.col("total")).alias("coverage"),
        (so_far / F.col("total")).alias("combined"),
    )


def smart_decode(df: DataFrame, column: str = "_raw") -> DataFrame:
    """Add arrays with all IPv4, e-mail, URL, MAC and UUID values of the text."""
    text, none = F.col(column), F.array().cast("array<string>")

    def hits(pattern: str, needle: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.when(~text.contains(needle), none).otherwise(found) if needle else found

    return df.withColumns({out: hits(*rule) for out, rule in SMART.items()})


def with_meta(df: DataFrame, meta: Mapping[str, object]) -> DataFrame:
    """Stamp fixed fields on all rows.

    They override parsed fields and ``_src``.  On rows that did not parse they also
    override ``timestamp``.
    """
    out, plain = {}, {}
    for key, value in meta.items():
        if key == "timestamp":
            if "timestamp" in df.columns and isinstance(value, (dt.datetime, str)):
                moment = F.lit(value).cast("timestamp")
                out[key] = F.when(F.col("error").isNotNull(), moment).otherwise(F.col(key))
        elif key in model.CORE_COLUMNS or key in df.columns:
            out[key] = F.lit(value)
        else:
            plain[key] = value
    if plain:
        kept = F.map_filter("attrs", lambda k, v: ~k.isin(*plain))
        added = F.create_map(*[x for k, v in plain.items() for x in (F.lit(k), F.lit(v).cast("string"))])
        out["attrs"] = F.map_concat(kept, added)
    return df.withColumns(out)


def num_view(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Numeric columns of chosen fields; text values give null."""
    from brooklog.functions.text import num

    return df.withColumns({f: num(model.field(f)) for f in fields})
