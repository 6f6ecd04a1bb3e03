"""One query per operator over its whole table, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklog.llm import alignment, bpe, fingerprints, hard_negatives, language, near_duplicates, packing, pattern_packing, secret_scan, token_counts, token_files, vantage_trees, warc
from brooklog.llm.common import work_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "word", end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: two-word shingles, similarity 0.8."""
    return near_duplicates.near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def _secret_digest(scanned: DataFrame) -> DataFrame:
    def count(rule: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("bigint")

    text = secret_scan.spans_text(F.col("spans"))
    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.RULES)]
    return scanned.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, through a new ledger of blobs."""
    return _secret_digest(secret_scan.scan(_read(spark, sf_dir, "documents")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by the sentencepiece model."""
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector; factor one is exact."""
    vectors = _read(spark, sf_dir, "embeddings")
    return vantage_trees.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5, factor=1.0)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    found = fingerprints.fingerprint(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, their source as host; ``kept`` is false for the rejected."""
    docs = _read(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs), host=F.col("source"))
    return found.select("doc_id", "lang", "confidence", "kept")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all pages: text, declared language, address suffix and host."""
    model = language.fit(_read(spark, sf_dir, "documents"))
    found = language.identify(_read(spark, sf_dir, "pages"), model, "html", "page_id", url=F.col("url"), markup=True)
    return found.select("page_id", "host", "lang", "confidence", "kept")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts decoded from them."""
    found = bpe.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    folder = work_folder(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), folder)
    measured = warc.candidates(spark, folder).withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    records = warc.verified(measured.drop("payload"))
    page = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]*)>$", 1).try_cast("bigint").alias("page_id")
    first = F.regexp_extract("refers_to", "^<urn:page:(-?[0-9]*)>$", 1).try_cast("bigint").alias("refers_to")
    rows = records.select(page, "payload_bytes", F.coalesce("payload_digest", "digest").alias("payload_digest"), F.col("type").alias("record_type"), first)
    sizes = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest")).agg(F.first("payload_bytes").alias("of_bytes"))
    joined = rows.join(sizes, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to token files in order and read back."""
    folder = work_folder(spark, "token-files")
    token_files.write_token_files(_read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=0)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into few sequences of 1024 tokens."""
    pieces = pattern_packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=2)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers aligned over all documents, with corpus-wide counts of linked pairs."""
    docs = _read(spark, sf_dir, "documents")
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    texts = alignment.align_texts(docs, a, b).select("blob", "copies", "n_a", "n_b", "n_groups", "n_links", digest, "links")
    found = alignment.per_document(docs, alignment.measure(texts, a, b))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, labels of every seventh moved on by one."""
    vectors = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), vectors.filter("vec_id % 50 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_nearest": op5_nearest,
    "op6_fingerprints": op6_fingerprints,
    "op7_language_id": op7_language_id,
    "language_id_pages": language_id_pages,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_token_files": op10_token_files,
    "op11_pattern_packing": op11_pattern_packing,
    "op12_alignment": op12_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}

_ASSIGN = secret_scan.ASSIGN.replace("'", "''")


def _sql_spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind in SQL: the pieces between matches and the matches, added up."""
    return f"""
    select doc_id, '{kind}' as kind, {order} as rule, e - m as s, e from (
      select doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: length(m[i]))) as m,
        unnest(list_transform(range(1, len(m) + 1), lambda i: length(p[i]))) as part,
        unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(m[:i], lambda x: length(x))) + list_sum(list_transform(g[:i], lambda x: length(x))))) as e
      from (select doc_id, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {group}) as p,
        string_split_regex(text, '{pattern}') as g from docs where regexp_matches(text, '{pattern}'))
    ) where part >= {least}"""


ORACLES = {
    "op3_secret_scan": f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
spans as ({" union all ".join(_sql_spans(r.kind, i, r.pattern.replace("'", "''"), r.group, r.least) for i, r in enumerate(secret_scan.RULES))}),
found as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, rule) as spans from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join found f on d.doc_id = f.doc_id""",
    "op5_nearest": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and vec_id is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
w as (select *, list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y) as n from v),
c as (
  select q.vec_id as query_id, v.vec_id,
    list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]), lambda x, y: x + y) / (sqrt(q.n) * sqrt(v.n)) as score
  from w q join w v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from c qualify rank <= 5""",
    "op13_hard_negatives": """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and vec_id is not null and label is not null and len(embedding) > 0
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
c as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label,
    cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
  from r a join r b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from c where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join c using (anchor_id) where label <> anchor_label and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3""",
    "op9_warc": """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
d as (select page_id, payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when f.first is not null and d.page_id <> f.first then 'revisit' else 'response' end as record_type,
  case when d.page_id <> f.first then f.first end as refers_to
from d left join f on d.payload_digest = f.payload_digest""",
}
