"""Folding and its detection."""

import random
import re

import pytest
from pyspark.sql import functions as F

from brooklog.operators import fold as fo
from brooklog.operators.ordering import carry, with_seq

DATE = r"^\d{4}-\d{2}-\d{2}"


def lines(spark, texts, per_block=100, src="s"):
    return spark.createDataFrame(
        [(src, i // per_block, i, t) for i, t in enumerate(texts)], "_src string, block long, line_no long, line string"
    )


def folded(df, *args, **kw):
    return [r._raw for r in fo.fold(df, *args, **kw).orderBy("_src", "block", "line_no").collect()]


SAMPLE = ["2031-08-09 kiln 4 lit", "  fuel: birch", "  target 980", "2031-08-10 kiln 4 cold"]


@pytest.mark.parametrize("per_block", [1, 2, 3, 100])
def test_header_and_indent(spark, per_block):
    want = ["2031-08-09 kiln 4 lit   fuel: birch   target 980", "2031-08-10 kiln 4 cold"]
    df = lines(spark, SAMPLE, per_block)
    assert folded(df, "header", DATE) == want
    assert folded(df, "indent") == want
    assert folded(df, "off") == SAMPLE


def test_orphans_form_the_first_record(spark):
    assert folded(lines(spark, ["a", "b", "2024-01-01 x", "c"], 2), "header", DATE) == ["a b", "2024-01-01 x c"]


def test_bad_settings(spark):
    df = lines(spark, SAMPLE)
    for mode, header in (("header", None), ("header", "("), ("bogus", None)):
        with pytest.raises(ValueError):
            fo.fold(df, mode, header)


@pytest.mark.parametrize("per_block", [1, 7, 1000])
def test_caps_against_a_plain_loop(spark, per_block):
    texts = ["h0"] + ["x"] * 25 + ["h1", "x", "h2"] + ["x"] * 11
    want, n = [], 0
    for t in texts:
        if not want or t.startswith("h") or n > 5:
            want.append(t)
            n = 1
        else:
            want[-1] += " " + t
            n += 1
    df = lines(spark, ["y", "y", *texts], per_block)
    assert folded(df, "header", "^h", max_lines=5) == ["y y", *want]
    out = fo.fold(df, "header", "^h", max_lines=5, max_bytes=8)
    assert {r.oversize for r in out.filter("n_lines = 6").collect()} == {True}


def test_one_source_without_headers_is_cut(spark):
    out = fo.fold(lines(spark, ["x"] * 1000, 50), "header", "^h")
    assert out.agg(F.max("n_lines")).first()[0] == 101
    assert out.agg(F.sum("n_lines")).first()[0] == 1000


def plain_score(texts, library=()):
    """The best way to fold some lines by the scoring rule, counted in a plain loop; None if none is of use."""
    known = lambda t: any(re.search(p, t) for p in library)
    best = (0, None)
    for name, mode, header in fo.CANDIDATES:
        opens = [i == 0 or bool(re.search(header, t) if mode == "header" else not re.match("[ \t]", t)) for i, t in enumerate(texts)]
        heads = [t for t, o in zip(texts, opens, strict=True) if o]
        orphans = sum(bool(re.search(fo.TRACE_CONTINUATION, t)) for t in heads)
        score = len(texts) - len(heads) - 8 * orphans + (2 if 2 * sum(map(known, heads)) > len(heads) else 0)
        bare = any(re.search(fo.TRACE_CONTINUATION, t) and not re.match("[ \t]", t) for t in texts)
        if len(texts) >= 3 and 2 <= len(heads) < len(texts) and score > best[0] and not (mode == "indent" and bare):
            best = (score, name)
    return best


def random_logs(n=150, seed=21):
    """Logs put together from openings and continuations, so that scores tie, and orphans tip them either way."""
    pick = random.Random(seed)
    heads = ["2030-07-01 10:00:0{} a", "Jul  1 10:00:0{} b", "2030-07-01T10:00:0{} c", "step {}", "{} plain"]
    tails = ["  more {}", "\tmore {}", "more {}", "at x.y{}", "Caused by: {}", "a.b.OddError{}", "... 4 more", ""]
    out = {}
    for i in range(n):
        some, rest = pick.sample(heads, pick.randint(1, 2)), pick.sample(tails, pick.randint(1, 3))
        lines = [(pick.choice(some) if pick.random() < pick.choice([0.3, 0.5, 0.8]) else pick.choice(rest)).format(j % 10) for j in range(pick.choice([1, 2, 3, 5, 9, 24]))]
        out[f"log-{i}"] = [x or "blank" for x in lines]
    return out


@pytest.mark.parametrize("library", [(), (r"^2030-\d\d-\d\d[ T]", "^step ")])
def test_detection_against_a_plain_count(spark, library):
    logs = random_logs()
    rows = [(src, i // 2, i, t) for src, texts in logs.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "_src string, block long, line_no long, line string")
    got = {r._src: (r.score, r.name) if r.name else (0, None) for r in fo.detect_fold(df, library).collect()}
    want = {src: plain_score(texts, library) for src, texts in logs.items()}
    assert got == want
    assert {name for _, name in want.values()} == {None, "syslog", "iso8601", "indent"}


def test_headers_in_the_words_of_the_engine(spark):
    df = lines(spark, ["Éclair", "  a", "Ünder", "b"])
    assert folded(df, "header", r"^\p{Lu}") == ["Éclair   a", "Ünder b"]
    assert folded(df, "header", r"^(?P<first>\p{Lu})") == ["Éclair   a", "Ünder b"]


def test_rows_without_a_source_stay(spark):
    df = spark.createDataFrame(
        [(None, 0, 0, "h a"), (None, None, 1, "b"), ("s", None, 0, "h c"), ("s", 1, 0, "d"), (None, 1, 0, "e")],
        "_src string, block long, line_no long, line string",
    )
    assert sorted(r._raw for r in fo.fold(df, "header", "^h").collect()) == ["b", "h a e", "h c d"]
    numbered = with_seq(df).collect()
    assert sorted((str(r._src), r._seq) for r in numbered) == [("None", 1), ("None", 2), ("None", 3), ("s", 1), ("s", 2)]
    held = carry(df, {"held": F.when(F.col("line").startswith("h"), F.col("line"))})
    assert sorted((r.line, str(r.held)) for r in held.collect()) == [("b", "None"), ("d", "h c"), ("e", "h a"), ("h a", "h a"), ("h c", "h c")]


def test_sequence_and_carry_over_blocks(spark):
    df = spark.createDataFrame(
        [("a", i // 3, i, str(i) if i % 5 == 2 else None) for i in range(20)] + [("b", 0, 0, None)],
        "_src string, block long, line_no long, v string",
    )
    got = carry(with_seq(df), {"held": F.col("v")}).orderBy("_src", "_seq").collect()
    assert [r._seq for r in got] == [*range(1, 21), 1]
    want, held = [], None
    for i in range(20):
        held = str(i) if i % 5 == 2 else held
        want.append(held)
    assert [r.held for r in got] == [*want, None]
