"""Language identification by fusing evidence with Bayes' rule.

* Text: log-likelihoods of character trigrams and single characters, from a model fitted on a bounded sample of
  the rows of every label.  Trigrams overlap, so their sum is damped to that of at most ``TEXT_GRAMS`` of them.
* Declared language of the markup: how often texts of a language declare which language, counted over all rows.
* Address suffix and host: priors from the text posteriors of all rows, a host smoothed towards its suffix and the
  suffix towards the whole corpus; a row's own share is taken out of its priors.

All corpus counts are grouped aggregations over every row; the driver sees tables of languages only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklog.llm.common import add_columns, held_by_worker, small_side, through_table
from brooklog.llm.fingerprints import MULTIPLIER, mixed

#: Labelled rows that the text model is fitted on, spread evenly over the languages; and those of a language at least.
SAMPLE_ROWS, LABEL_ROWS = 2000, 100
#: Hash buckets of trigrams.
BUCKETS = 1 << 16
TEXT_GRAMS = 60.0
#: Rows that a parent prior counts for in a host and in a suffix.
HOST_ROWS, SUFFIX_ROWS = 10.0, 100.0
#: A row with a best posterior under this is rejected.
LEAST_CONFIDENCE = 0.5
#: Hash buckets of trigrams of letters.
LETTER_BUCKETS = 1 << 20
#: A trigram of letters is known in a language by two sample texts.  By one if the sample says little of the language:
#: fewer texts than this, or fewer trigrams that two texts have (codes with hardly any letters).
ENOUGH_TEXTS, ENOUGH_GRAMS = 20, 200
#: So many known trigrams are lent to each text, so that a word or two are not held against it.
LENT = 4
#: A text is in no known language if its share of unknown trigrams is over bounds between these in every language.
LEAST_BOUND, MOST_BOUND = 2 / 3, 0.95


@cache
def alphabet() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_grams(text: str) -> np.ndarray:
    """Buckets of the trigrams around each letter in lower case; what is no letter is a blank to them."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = alphabet()[c]
    at = np.flatnonzero(letter)
    c = np.where(letter, c, 32).astype(np.uint64)
    times = np.uint64(MULTIPLIER)
    return (mixed((c[at - 1] * times + c[at]) * times + c[at + 1]) % np.uint64(LETTER_BUCKETS)).astype(np.int64)


def known_grams(texts: list[str]) -> tuple[np.ndarray, float]:
    """The trigrams of letters known by the sample texts of a language (packed bits), and the share of unknown ones
    that its texts may have: LEAST_BOUND, more if its median text has many trigrams that no other text has."""
    found = [g for g in map(letter_grams, sorted(set(texts))) if len(g)]
    n = np.zeros(LETTER_BUCKETS, np.int64)
    for g in found:
        n[np.unique(g)] += 1
    alone = float(np.median([(n[g] < 2).mean() for g in found])) if found else 1.0
    bound = min(LEAST_BOUND + (1 - LEAST_BOUND) * alone, MOST_BOUND)
    enough = len(found) >= ENOUGH_TEXTS and np.count_nonzero(n >= 2) >= ENOUGH_GRAMS
    return np.packbits(n >= (2 if enough else 1)), bound


def grams(text: str) -> tuple[np.ndarray, int]:
    """Buckets of the trigrams and characters of a text in lower case, blanks as one, and its number of letters."""
    words = " ".join(text.lower().split())
    if not words:
        return np.empty(0, np.int64), 0
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    times = np.uint64(MULTIPLIER)
    three = mixed((c[:-2] * times + c[1:-1]) * times + c[2:])
    one = mixed(c[1:-1] + np.uint64(1 << 40))
    letters = sum(map(str.isalpha, words))
    return (np.concatenate([three, one]) % np.uint64(BUCKETS)).astype(np.int64), letters


@dataclass
class TextModel:
    """Log-probabilities (bucket, language), and of each language the known trigrams of letters and the bound for
    the share of unknown ones."""

    languages: list[str]
    weights: np.ndarray
    known: list[np.ndarray]
    bounds: list[float]

    def strange(self, text: str) -> float:
        """How far the share of unknown trigrams is over the bound, in the language where that is least."""
        found = letter_grams(text)
        byte, bit = found >> 3, (7 - (found & 7)).astype(np.uint8)
        shares = ((len(found) - np.count_nonzero(known[byte] >> bit & 1)) / (len(found) + LENT) for known in self.known)
        return min((share - bound for share, bound in zip(shares, self.bounds, strict=True)), default=0.0)

    def score(self, texts: list[str]) -> list[list]:
        """The damped log-likelihood in each language, the posterior of each by the text alone (none without a letter),
        how strange the text is, and the number of letters."""
        held_by_worker("language", lambda: None)  # what the operators before have kept can go
        table = np.zeros((len(texts), len(self.languages)))
        letters = []
        for i, text in enumerate(texts):
            found, n = grams(text)
            letters.append(n)
            if len(found):
                mean = self.weights[found].mean(axis=0)
                table[i] = mean * (len(found) / (1 + len(found) / TEXT_GRAMS))
        parts = np.exp(table - table.max(axis=1, keepdims=True, initial=-np.inf)) * (np.array(letters) > 0)[:, None]
        says = parts / np.maximum(parts.sum(axis=1, keepdims=True), 1e-300)
        return [*table.T.tolist(), *says.T.tolist(), [self.strange(t) for t in texts], letters]


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id", label: str = "lang") -> TextModel:
    """Fit the text model on all languages that a row with a text is labelled with.

    Each has about an equal part of ``sample_rows``, ``LABEL_ROWS`` at least (all its rows if it has no more), chosen
    by a hash of key and text; a repeated row counts once.  A language is fitted in one task from its sample; the
    driver sees a table row a language.
    """
    place = F.xxhash64(key, text) / F.lit(2.0**64) + 0.5  # from 0 to 1
    rows = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"), place.alias("place"))
    labels = rows.groupBy("label").agg(F.approx_count_distinct("place").alias("n"), F.min("place").alias("least")).collect()
    if not labels:
        return TextModel([], np.empty((BUCKETS, 0)), [], [])
    each = max(-(-sample_rows // len(labels)), LABEL_ROWS)
    upto = [(r["label"], max(each / r["n"], r["least"])) for r in labels]  # the lowest row is always in
    sample = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(upto, "label string, upto double")), "label").filter("place <= upto")
    sample = sample.groupBy("label", "place").agg(F.first("text").alias("text"))

    def fit_label(group: pa.Table) -> pa.Table:
        texts = group.column("text").to_pylist()
        counts = np.full(BUCKETS, 0.5)
        for t in texts:
            counts += np.bincount(grams(t)[0], minlength=BUCKETS)
        known, bound = known_grams(texts)
        weights = np.log(counts / counts.sum()).astype(np.float32)
        return pa.table({"label": group.column("label").slice(0, 1), "weights": pa.array([weights.tobytes()], pa.binary()), "known": pa.array([known.tobytes()], pa.binary()), "bound": [bound]})

    fitted = sample.select("label", "text").groupBy("label").applyInArrow(fit_label, "label string, weights binary, known binary, bound double").collect()
    fitted.sort(key=lambda r: r["label"])
    weights = np.stack([np.frombuffer(r["weights"], np.float32) for r in fitted], axis=1)
    return TextModel([r["label"] for r in fitted], weights, [np.frombuffer(r["known"], np.uint8) for r in fitted], [r["bound"] for r in fitted])


def declared(text: Column) -> Column:
    """The language that the root tag of the markup declares, two or three letters in lower case; else null."""
    found = F.lower(F.regexp_extract(text, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def without_markup(text: Column) -> Column:
    """The text between the tags; scripts, styles and comments go."""
    return F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def host_of(url: Column) -> Column:
    """The host of an address in lower case; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(found != "", found)


def suffix_of(host: Column) -> Column:
    """What follows the last dot of a host; null without a dot."""
    found = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return F.when(found != "", found)


def identify(docs: DataFrame, model: TextModel, text: str = "text", key: str = "doc_id", host: Column | None = None, url: Column | None = None, markup: bool = False) -> DataFrame:
    """A row per input row: the key, ``host``, ``text_hash``, ``lang``, ``confidence`` (its posterior), ``kept``.

    ``host`` or else the host of ``url`` groups rows; rows without one use the prior of the corpus.  With ``markup``
    the texts are pages: tags are taken off before the text is scored.  A declaration in the markup counts in either
    case.  Rejected (``kept`` false): texts without a letter (null and empty ones too; ``lang`` is null), a best
    posterior under ``LEAST_CONFIDENCE``, texts whose trigrams of letters are mostly unknown in every language
    (digits and symbols say nothing there).  Null keys and repeated rows stay; an empty
    table gives no rows; a model without languages rejects all; other columns are left out.
    """
    langs = model.languages
    source = F.coalesce(F.col(text).cast("string"), F.lit(""))
    where = host.cast("string") if host is not None else host_of(url.cast("string")) if url is not None else F.lit(None).cast("string")
    rows = docs.select(
        F.col(key), where.alias("host"), F.xxhash64(source).alias("text_hash"), declared(source).alias("declared"),
        (without_markup(source) if markup else source).alias("text_"),
    )
    n = range(len(langs))
    scored = add_columns(rows, "text_", "".join(f"{c}{i} double, " for c in "tp" for i in n) + "strange double, letters bigint", model.score, [key, "host", "text_hash", "declared"])
    scored = through_table(scored.withColumn("suffix", suffix_of(F.col("host"))), "language-scores")
    if not langs:
        return scored.select(key, "host", "text_hash", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    # A row's say in the corpus counts is its text posterior.
    says, post = F.col("letters") > 0, scored
    sums = [F.sum(f"p{i}").alias(f"s{i}") for i in n]
    declaring = [F.sum(F.when(F.col("declared").isNotNull(), F.col(f"p{i}"))) for i in n]
    whole = post.agg(*sums, *declaring).first()
    total = sum(whole[i] or 0.0 for i in n)
    base = [((whole[i] or 0.0) + 1.0) / (total + len(langs)) for i in n]
    suffixes = post.filter("suffix is not null").groupBy("suffix").agg(*(s.alias(f"x{i}") for i, s in enumerate(sums)))
    hosts = post.filter("host is not null").groupBy("host").agg(*(s.alias(f"h{i}") for i, s in enumerate(sums)))
    said = post.filter("declared is not null").groupBy("declared").agg(*(s.alias(f"d{i}") for i, s in enumerate(sums)))
    of_lang = whole[len(langs) :]
    said = through_table(said, "language-declared")
    kinds = 1.0 + said.count()
    joined = post
    for name, table in (("host", through_table(hosts, "language-host")), ("suffix", through_table(suffixes, "language-suffix")), ("declared", said)):
        joined = joined.join(small_side(table), name, "left")

    def others(column: str, i: int) -> Column:
        """The count of all rows but this one."""
        return F.greatest(F.coalesce(F.col(f"{column}{i}"), F.col(f"p{i}")) - F.col(f"p{i}"), F.lit(0.0))

    def add(columns: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, columns)

    # In steps, each value once: the plan grows with the languages and not with their square.
    joined = joined.withColumns({"sum_x_": add([others("x", j) for j in n]), "sum_h_": add([others("h", j) for j in n])})
    by_suffix = [(others("x", i) + SUFFIX_ROWS * base[i]) / (F.col("sum_x_") + SUFFIX_ROWS) for i in n]
    joined = joined.withColumns({f"f{i}": p for i, p in enumerate(by_suffix)})
    by_host = [(others("h", i) + HOST_ROWS * F.col(f"f{i}")) / (F.col("sum_h_") + HOST_ROWS) for i in n]
    declares = [F.when(F.col("declared").isNull(), 0.0).otherwise(F.log((others("d", i) + 1.0) / ((of_lang[i] or 0.0) + kinds))) for i in n]
    logs = joined.withColumns({f"l{i}": F.col(f"t{i}") + F.log(by_host[i]) + declares[i] for i in n})
    top = F.greatest(*(F.col(f"l{i}") for i in n)) if len(langs) > 1 else F.col("l0")
    parts = logs.withColumn("top_", top).withColumns({f"e{i}": F.exp(F.col(f"l{i}") - F.col("top_")) for i in n})
    first = [F.struct(F.col(f"e{i}").alias("e"), F.lit(l).alias("lang")) for i, l in enumerate(langs)]
    fused = parts.withColumns({"total_": add([F.col(f"e{i}") for i in n]), "first_": F.greatest(*first) if len(langs) > 1 else first[0]})
    best = F.struct((F.col("first_.e") / F.col("total_")).alias("q"), F.col("first_.lang").alias("lang"))
    out = fused.select(key, "host", "text_hash", says.alias("says"), "strange", best.alias("best"))
    kept = F.col("says") & (F.col("best.q") >= LEAST_CONFIDENCE) & (F.col("strange") <= 0)
    return out.select(key, "host", "text_hash", F.when(F.col("says"), F.col("best.lang")).alias("lang"), F.when(F.col("says"), F.col("best.q")).otherwise(0.0).alias("confidence"), kept.alias("kept"))


def keep_identified(docs: DataFrame, model: TextModel, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects; all columns stay."""
    found = identify(docs, model, text, key, F.col(host))
    gone = through_table(found.filter(~F.col("kept")).select(F.col(key).alias("k_"), F.col("host").alias("h_"), F.col("text_hash").alias("t_")).distinct(), "language-rejected")
    same = docs[key].eqNullSafe(gone["k_"]) & docs[host].cast("string").eqNullSafe(gone["h_"]) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == gone["t_"])
    return docs.join(small_side(gone), same, "left_anti")
