"""Secret scans with a ledger of blobs, in DataFrame operations only.

Every version of a text is addressed by its SHA-256.  A blob is scanned once per rule version; a later scan over the
same ledger reads only the pairs of blob and rule version that it does not hold.  Findings are joined back to every
path (row) that holds the blob, so copies cost a join and not a scan.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brooklog.llm.common import work_folder
from brooklog.session import BROADCAST_ROWS


def either_case(word: str) -> str:
    """A pattern for ASCII letters in either case; inline flags differ between engines for other letters."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are taken from left to right without overlap; those with a group ``group`` shorter
    than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


#: The words and character sets of the three kinds.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(map(either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs of hex digits and of key letters are maximal, so a lower bound in the pattern finds the same runs.
RULES = (Rule("assign", ASSIGN, 2, 6), Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20), Rule("hex", "[0-9a-f]{24,}", 0, 24))
RULE_VERSION = "1"
#: Spans that a broadcast of findings holds at most.
BROADCAST_SPANS = 4 * BROADCAST_ROWS

LEDGER = "blob string, rule_version string, spans array<struct<start:int,rule:int,end:int,upto:int>>"


def lengths(text: Column, rule: Rule, number: int) -> Column:
    """For each match in order: the rule, the characters before it since the last match, its length, and if it counts."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    each = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"), part.alias("p")),
        lambda x: F.struct(F.lit(number).alias("rule"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["p"]) >= rule.least).alias("counts")),
    )
    none = F.array().cast("array<struct<rule:int,gap:int,size:int,counts:boolean>>")
    return F.when(text.rlike(rule.pattern), each).otherwise(none)


def scan_blobs(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob`` and ``text`` to ``blob`` and ``spans``: (start, rule, end, upto) in order of start and rule.

    Positions are code points, the end is exclusive; ``upto`` is the greatest end of the spans before it.  Rows of
    one blob are scanned as one.
    """
    found = texts.select("blob", F.concat(*(lengths(F.col("text"), r, i) for i, r in enumerate(rules))).alias("found"))
    rows = found.groupBy("blob").agg(F.first("found").alias("found")).select("blob", F.posexplode_outer("found").alias("i", "f"))
    rows = rows.select("blob", "i", F.col("f.rule").alias("rule"), F.col("f.gap").alias("gap"), F.col("f.size").alias("size"), F.col("f.counts").alias("counts"))
    along = Window.partitionBy("blob", "rule").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    span = F.struct("start", "rule", "end").alias("span")
    rows = rows.select("blob", F.when(F.col("counts"), span).alias("span"))
    earlier = Window.partitionBy("blob").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("upto", F.coalesce(F.max("span.end").over(earlier), F.lit(0)))
    full = F.when(F.col("span").isNotNull(), F.struct("span.start", "span.rule", "span.end", "upto"))
    return rows.groupBy("blob").agg(F.sort_array(F.collect_list(full)).alias("spans"))


def with_blob(docs: DataFrame, text: str) -> DataFrame:
    """Only the text (null as empty) and its address, beside the columns given."""
    return docs.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("blob", F.sha2(F.col(text), 256))


def version_of(rules: tuple[Rule, ...], name: str = RULE_VERSION) -> str:
    """How the ledger names a set of rules: own rules by their content too, so that no others' findings are taken for theirs."""
    if rules == RULES:
        return name
    return f"{name}:{hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()}"


def read_ledger(docs: DataFrame, ledger: str, rule_version: str, shared: bool = True) -> DataFrame:
    """What the ledger holds for a rule version, a row per blob; a folder that is not there yet holds nothing.

    Scans that ran at once may both have added a blob: of such entries, which are equal, one is read.
    """
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    schema = T._parse_datatype_string(LEDGER)
    held = spark.read.schema(schema).parquet(ledger).filter(F.col("rule_version") == rule_version)
    return held.dropDuplicates(["blob"]) if shared else held


def scan_new(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, text: str = "text", key: str = "doc_id") -> None:
    """Scan the blobs that the ledger lacks for this rule version and add them to it."""
    version = version_of(rules, rule_version)
    versions = with_blob(docs.select(docs[key].alias("path"), docs[text].alias("text")), "text")
    # One path of each blob stands for it, so that its text is moved once.
    chosen = versions.groupBy("blob").agg(F.min("path").alias("chosen"))
    unseen = chosen.join(read_ledger(docs, ledger, version).select("blob"), "blob", "left_anti")
    texts = versions.join(unseen.withColumnRenamed("blob", "new").hint("shuffle_hash"), (F.col("blob") == F.col("new")) & F.col("path").eqNullSafe(F.col("chosen")), "left_semi")
    scanned = scan_blobs(texts.select("blob", "text"), rules)
    scanned.select("blob", F.lit(version).alias("rule_version"), "spans").write.mode("append").parquet(ledger)


def scan(
    docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """A row per input row: the key, ``blob`` and ``spans`` (in order of start, then rule).

    ``ledger`` is a folder that later scans share, also at the same time; without one a new ledger is used.
    ``rule_version`` names the rules in the ledger; to own rules their digest is added.  A null text is empty and has no
    spans; null keys and repeated rows stay; an empty table gives no rows; other columns are left out.
    """
    own = ledger or work_folder(docs.sparkSession, "ledger")
    scan_new(docs, own, rules, rule_version, text, key)
    paths = with_blob(docs.select(docs[key].alias("path"), docs[text].alias("text")), "text").select(F.col("path").alias(key), "blob")
    found = read_ledger(docs, own, version_of(rules, rule_version), shared=ledger is not None).select("blob", "spans")
    return paths.join(found, "blob", "left").select(key, "blob", "spans")


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def small_findings(found: DataFrame) -> bool:
    """Whether findings were counted to be few enough, in blobs and in spans, for a broadcast."""
    blobs, spans = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans_")), F.lit(0))).first()
    return blobs <= BROADCAST_ROWS and spans <= BROADCAST_SPANS


def mask(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id", rule_version: str = RULE_VERSION) -> DataFrame:
    """``docs`` with every character of a secret replaced by ``*``; all rows and columns stay, lengths too.

    ``ledger``, ``rules`` and ``rule_version`` are as for ``scan``.  A null text stays null, an empty one empty; null
    keys and repeated rows stay; an empty table gives no rows.  The texts are moved once, to be scanned; findings
    come to the texts by broadcast if they were counted to be few, else the texts are moved a second time.
    """
    own_ledger = ledger or work_folder(docs.sparkSession, "ledger")
    scan_new(docs, own_ledger, rules, rule_version, text, key)
    held = read_ledger(docs, own_ledger, version_of(rules, rule_version), shared=ledger is not None)
    found = held.filter(F.size("spans") > 0).select(F.col("blob").alias("blob_"), F.col("spans").alias("spans_"))
    if small_findings(found):
        found = F.broadcast(found)
    own, spans = docs[text], found["spans_"]
    parts = F.transform(
        spans,
        lambda s: F.concat(
            F.substring(own, s["upto"] + 1, F.greatest(s["start"] - s["upto"], F.lit(0))),
            F.repeat(F.lit("*"), F.greatest(s["end"] - F.greatest(s["start"], s["upto"]), F.lit(0))),
        ),
    )
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    masked = F.concat(F.array_join(parts, ""), F.substring(own, last + 1, F.length(own)))
    joined = docs.join(found, F.sha2(F.coalesce(own, F.lit("")), 256) == found["blob_"], "left")
    new_text = F.when(spans.isNull(), own).otherwise(masked).alias(text)
    return joined.select(*(new_text if c == text else docs[c] for c in docs.columns))
