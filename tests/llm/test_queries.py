"""The registered queries: against their SQL where there is one, and the pipeline against its stages."""

import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from brooklog.llm.queries import ORACLES, QUERIES
from checks.compare import _key, connect, rows_of
from tests.llm.test_documents import near_rows, plain_components, plain_spans

SF = "/root/testdata/sf0.001"


def rounded(rows):
    return [_key(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    if name in ORACLES:
        cursor = connect(SF).execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(found.columns) and rounded(got) == rounded(rows_of(columns, cursor.fetchall()))
    else:
        assert got


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "packing"]


def test_pipeline_against_a_plain_version(spark, table, tmp_path):
    """Rejected, repeated and secret text goes; every id of what is left lies in one piece."""
    rows = near_rows() + [(900, "1234 !!"), (901, None), (902, "password = hunter2222 and more words for a text"), (903, "x")]
    table(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [(k, t) for k, t in rows if t and re.search("[^\\W\\d_]", t)]
    parts = plain_components(left, 5, 80)
    left = [(k, t) for k, t in left if parts[k][1] == k]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for k, t in left:
        for part in filter(None, plain_spans(t).split(",")):
            _, a, b = part.split(":")
            t = t[: int(a)] + "*" * (int(b) - int(a)) + t[int(b) :]
        want[k] = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert {r.doc_id: r.doc_tokens for r in found} == want
    assert sum(r.length for r in found) == sum(want.values())


def test_digests_of_the_edited_texts(spark):
    found = {r.doc_id: r for r in QUERIES["op6_fingerprints"](spark, SF).collect()}
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    for (k, t), (_, following) in zip(docs, [*docs[1:], docs[0]], strict=True):
        third = len(t) // 3
        assert found[k].edited_sha256 == hashlib.sha256((t[: len(t) - third] + following[:third]).encode()).hexdigest()
