"""Predicates, pages, histograms, summaries, tags and views on hand-built rows."""

import datetime as dt
import decimal
import random
import re

import pytest
from pyspark.sql import functions as F

from brooklog import model
from brooklog.functions import predicates as q
from brooklog.functions import relative
from brooklog.operators import deep_paging, display, histogram, paging, summary, tagging
from brooklog.plans.search import search
from brooklog.plans.views import View, run_views, view_page

SCHEMA = "timestamp timestamp, _raw string, _src string, _seq long, error string, attrs map<string,string>"
T0 = dt.datetime(2024, 1, 15, 10, tzinfo=dt.timezone.utc)
MIN = dt.timedelta(minutes=1)


def log(spark, rows):
    df = spark.createDataFrame(
        [(r[0], r[1], r[2], i if len(r) < 5 else r[4], None, r[3]) for i, r in enumerate(rows)], SCHEMA
    )
    return model.with_row_id(model.with_log_date(df))


# Predicates are held against plain Python on random rows; the words are few, so that every predicate meets some rows.
WORDS = ("ash", "ashes", "Birch", "birch_bark", "cedar", "cedra", "elm", "Élan", "fir", "x1", "x10")
FIELDS = ("tree", "note", "girth")
FLOORS = ("upper.wood", "lower wood", "mill")


@pytest.fixture(scope="module")
def wood(spark):
    """(frame, plain rows): 80 random rows of three sources with overlapping words, numbers that are text, missing fields."""
    pick = random.Random(77)
    some = lambda n: pick.choice([" ", "-", " / "]).join(pick.choice(WORDS) for _ in range(pick.randint(1, n)))
    rows = []
    for i in range(80):
        values = {"tree": some(1), "note": some(4), "girth": pick.choice(["3", "10", "10.5", "-2", "1e2", "wide", " 7", "x10"])}
        fields = {k: v for k, v in values.items() if pick.random() < 0.7}
        rows.append((T0 + pick.randrange(0, 40) * MIN, some(3), pick.choice(FLOORS), fields, i))
    return log(spark, rows).cache(), rows


def cut_up(text):
    return re.findall(r"\w+", text.lower())


def parts_of(row, field):
    """The texts a predicate looks at."""
    if field is None:
        return [row[1], row[2], *row[3].values()]
    value = {"_raw": row[1], "_src": row[2]}.get(field, row[3].get(field))
    return [] if value is None else [value]


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
    return line[-1]


def any_token(row, field, test):
    return any(test(t) for text in parts_of(row, field) for t in cut_up(text))


def in_a_row(row, field, words, near):
    wanted = cut_up(words)
    return bool(wanted) and any(
        all(near(h, w) for h, w in zip(have[i:], wanted, strict=False))
        for have in map(cut_up, parts_of(row, field)) for i in range(len(have) - len(wanted) + 1)
    )


def number(row, field):
    value = row[3].get(field)
    return float(value) if value is not None and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value) else None


def random_cases(n=140, seed=5):
    """Pairs of a predicate and its plain meaning."""
    pick = random.Random(seed)
    out = []
    for i in range(n):
        word, field, other = pick.choice(WORDS), pick.choice([None, "_raw", "_src", *FIELDS]), pick.choice(WORDS)
        low, high, d = pick.choice([-2, 3, 7, 10]), pick.choice([3, 10, 10.5, 100]), pick.randint(0, 2)
        typo = word.replace(word[-1], "q", 1) if pick.random() < 0.5 else word
        loose = word[: pick.randint(1, 3)] + pick.choice(["*", "?", "?*"])
        fits = re.compile(loose.lower().replace("*", r"\w*").replace("?", r"\w")).fullmatch
        at = T0 + pick.randrange(0, 40) * MIN
        out.append([
            (q.term(f"{word} {other}", field), lambda r, f=field, w=(word, other): any_token(r, f, lambda t: t in [x.lower() for x in w])),
            (q.phrase(f"{word} {other}", field), lambda r, f=field, w=f"{word} {other}": in_a_row(r, f, w, lambda h, x: h == x)),
            (q.phrase(f"{typo} {other}", field, fuzziness=d), lambda r, f=field, w=f"{typo} {other}", d=d: in_a_row(r, f, w, lambda h, x: edits(h, x) <= d)),
            (q.wildcard(loose, field), lambda r, f=field, fits=fits: any_token(r, f, lambda t: fits(t))),
            (q.regex(f"{word.lower()[:2]}.*", field), lambda r, f=field, w=word.lower()[:2]: any_token(r, f, lambda t: t.startswith(w))),
            (q.regex(f"{word} ", field, on="text"), lambda r, f=field, w=f"{word} ": any(w in x for x in parts_of(r, f))),
            (q.fuzzy(typo, d, field), lambda r, f=field, w=typo.lower(), d=d: any_token(r, f, lambda t: edits(t, w) <= d)),
            (q.num_range("girth", ge=low, lt=high), lambda r, a=low, b=high: (x := number(r, "girth")) is not None and a <= x < b),
            (q.num_range("girth", gt=low, le=high), lambda r, a=low, b=high: (x := number(r, "girth")) is not None and a < x <= b),
            (q.num_eq(high, "girth"), lambda r, a=high: number(r, "girth") == a),
            (q.from_sources([FLOORS[i % 3], "none"]), lambda r, a=FLOORS[i % 3]: r[2] == a),
            (q.from_sources(["wood"], exact=False), lambda r: "wood" in cut_up(r[2])),
            (q.ts_range(gt=at, le=at + 9 * MIN), lambda r, a=at: a < r[0] <= a + 9 * MIN),
            (q.in_window(at, at + 9 * MIN), lambda r, a=at: a <= r[0] <= a + 9 * MIN),
        ][i % 14])
    for i in range(0, n - 2, 9):
        (a, x), (b, y), (c, z) = out[i : i + 3]
        out.append((q.all_of(a, b) | ~c, lambda r, x=x, y=y, z=z: (x(r) and y(r)) or not z(r)))
        out.append((q.none_of(a, b) & q.any_of(c, q.match_all()), lambda r, x=x, y=y: not (x(r) or y(r))))
    nothing = (q.phrase("--"), q.term("?!"), q.from_sources([]), q.in_window(T0 + MIN, T0), q.any_of())
    return out + [(p, lambda r: False) for p in nothing] + [(p, lambda r: True) for p in (q.match_all(), q.from_sources(None), q.all_of())]


def test_predicates(wood):
    df, rows = wood
    cases = random_cases()
    hits = {}
    for start in range(0, len(cases), 40):
        part = cases[start : start + 40]
        for r in df.select("_seq", *[p.alias(f"c{start + i}") for i, (p, _) in enumerate(part)]).collect():
            hits.setdefault(r._seq, {}).update(r.asDict())
    met = 0
    for i, (_, plain) in enumerate(cases):
        want = [row[4] for row in rows if plain(row)]
        assert [row[4] for row in rows if hits[row[4]][f"c{i}"]] == want, f"case {i}"
        met += 0 < len(want) < len(rows)
    assert met > 100


def test_open_ranges_skip_text(spark):
    df = log(spark, [(T0 + i * MIN, "r", "x", {"latency": v}) for i, v in enumerate(["100", "timeout", "20", "1d", " 70", "7e1"])])
    for kw, want in (({"gt": 50}, {"100", "7e1"}), ({"ge": 100}, {"100"}), ({"gt": 0}, {"20", "100", "7e1"}), ({"lt": 200}, {"20", "100", "7e1"}), ({"gt": 600}, set())):
        assert {r[0] for r in df.filter(q.num_range("latency", **kw)).select("attrs.latency").collect()} == want


@pytest.fixture(scope="module")
def tied(spark):
    """(frame, plain rows): 90 rows in 12 moments over three days, so that most moments are shared."""
    pick = random.Random(8)
    moments = [T0 + dt.timedelta(hours=pick.randrange(0, 72)) for _ in range(12)]
    rows = [(pick.choice(moments), f"line {i}", pick.choice(FLOORS), {"tree": pick.choice(WORDS)}, i) for i in range(90)]
    return log(spark, rows).cache(), rows


@pytest.mark.parametrize(("order", "limit", "offset"), [("desc", 7, 0), ("asc", 10, 13), ("desc", 25, 60), ("desc", 5, 400)])
def test_search(tied, order, limit, offset):
    """Page, totals, columns and histogram of a window of two sources."""
    df, rows = tied
    start, end, asked = T0 + dt.timedelta(hours=6), T0 + dt.timedelta(hours=60), FLOORS[:2]
    inside = sorted((r for r in rows if start <= r[0] <= end and r[2] in asked), key=lambda r: (r[0], r[4]), reverse=order == "desc")
    found = search(df, start=start, end=end, sources=asked, limit=limit, offset=offset, order=order)
    assert [r._raw for r in found.page.collect()] == [r[1] for r in inside[offset : offset + limit]] and "_seq" not in found.page.columns
    past = offset >= len(inside)
    assert tuple(found.totals.first()) == (len(inside), 0 if past else offset, len(inside[offset : offset + limit]))
    columns = {r.column for r in found.columns.collect()}
    assert {"_id", "_raw", "_src", "tree", "timestamp"} <= columns and "_seq" not in columns
    counted = found.distribution.collect()
    assert len(counted) == 100
    for source in asked:
        assert sum(b.source_counts.get(source, 0) for b in counted) == sum(r[2] == source for r in inside)
    word = cut_up(inside[0][3]["tree"])[0]
    narrowed = search(df, q.term(word, "tree"), start, end, asked, limit=100)
    assert narrowed.page.count() == sum(word in cut_up(r[3]["tree"]) for r in inside)
    assert "TakeOrderedAndProject" in narrowed.page._jdf.queryExecution().toString()


def test_page_limits(tied):
    for bad in ({"limit": 1001}, {"limit": 0}, {"limit": 1, "offset": -1}, {"limit": 1, "order": "up"}):
        with pytest.raises(ValueError):
            paging.page(tied[0], **bad)
        with pytest.raises(ValueError):
            deep_paging.page_deep(tied[0], **{"offset": 0, **bad})


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_after_a_key_go_through_all(tied, order):
    df, rows = tied
    got, key = [], None
    while key is None or len(got) % 16 == 0:
        page = (paging.page(df, 16, order=order) if key is None else paging.page_after(df, key, 16, order)).collect()
        got += [r._seq for r in page]
        key = paging.LastKey(page[-1].timestamp.replace(tzinfo=dt.timezone.utc), page[-1]._seq, page[-1]._id)
    assert got == [r[4] for r in sorted(rows, key=lambda r: (r[0], r[4]), reverse=order == "desc")]
    newest = [r[4] for r in sorted(rows, key=lambda r: (r[0], r[4]), reverse=True)][:11]
    assert [r._seq for r in paging.latest(df, 11).collect()] == newest and paging.dropped(df, 11).first().dropped == 79


def test_deep_pages(spark):
    """Rank selection gives the pages of the full order, over ties, nulls, numbers, text and equal ids."""
    pick = random.Random(4)
    values = [None, "7", "7", "-3", "1e400", "abc", "abd", "a", "longer text than one view", "longer text than one vieW", "10"]
    rows = [(T0 + pick.randrange(0, 6) * MIN, "r", pick.choice(["s", "t"]), {"v": x} if (x := pick.choice(values)) else {}, pick.randrange(0, 40)) for _ in range(400)]
    df = log(spark, rows)
    df = df.withColumn("timestamp", F.when(F.col("_seq") % 9 > 0, F.col("timestamp"))).cache()
    for sort_by, order in (("timestamp", "desc"), ("timestamp", "asc"), ("v", "asc"), ("v", "desc"), ("_src", "asc")):
        full = [r._id for r in df.orderBy(*paging.sort_columns(sort_by, order)).collect()]
        keys = {k: i for i, k in enumerate(dict.fromkeys(full))}
        for limit, offset in ((30, 0), (30, 185), (100, 333), (10, 399), (10, 400)):
            got = [r._id for r in deep_paging.page_deep(df, limit, offset, order, sort_by, few=20).collect()]
            assert [keys[k] for k in got] == [keys[k] for k in full[offset : offset + limit]], (sort_by, order, limit, offset)


def test_deep_pages_by_few_passes(spark):
    """Views that all rows share take no pass of their own."""
    df = spark.range(40_000).select(
        F.lit(None).cast("timestamp").alias("timestamp"), F.col("id").alias("_seq"), F.concat(F.lit("r"), "id").alias("_id"),
        F.create_map(F.lit("q"), (F.col("id") % 50).cast("string")).alias("attrs"),
    )
    spark.sparkContext.setJobGroup("few passes", "")
    page = deep_paging.page_deep(df, 30, 20_390, "asc", "q", few=50)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few passes")
    assert [r._seq for r in page.collect()] == [i * 50 + 25 for i in range(390, 420)]
    assert len(jobs) <= 16  # five aggregations of at most three jobs each


def test_deep_pages_of_odd_values(spark):
    """Texts that differ late, numbers that are none, bounds without end, decimals, and very uneven values."""
    pick = random.Random(9)
    same = "the same beginning of sixty characters, and a few more of them"
    values = {
        "string": [None, same + "b", same + "a", same, same + "a\0", "é" * 20, "é" * 20 + "x"],
        "double": [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e300, 5e-324, 1.5, 2.5],
        "decimal(12,2)": [None, *(decimal.Decimal(x) / 100 for x in (-1000, -999, 5, 40, 1000))],
        "bigint": [None, -(1 << 63), (1 << 63) - 1, (1 << 60) + 1, 1 << 60, *range(8)],
    }
    for kind, some in values.items():
        rows = [(pick.choice(some), i, f"r{i}") for i in pick.sample(range(900), 300)]
        df = spark.createDataFrame(rows, f"v {kind}, _seq long, _id string").coalesce(2).cache()
        for order in ("asc", "desc"):
            full = [r._seq for r in df.orderBy(*paging.sort_columns(F.col("v"), order)).collect()]
            for offset in (40, 150, 280):
                got = [r._seq for r in deep_paging.page_deep(df, 30, offset, order, F.col("v"), few=12).collect()]
                assert got == full[offset : offset + 30], (kind, order, offset)


def test_deep_pages_pass_over_no_rows(spark, monkeypatch):
    monkeypatch.setattr(deep_paging, "FEW", 50)
    monkeypatch.setattr(paging, "DEEP_OFFSET", 1000)
    df = spark.range(5000).select(F.timestamp_micros(F.col("id") * 1000).alias("timestamp"), F.col("id").alias("_seq"), F.col("id").cast("string").alias("_id"))
    page = paging.page(df, 20, 2500, "asc")
    assert [r._seq for r in page.collect()] == list(range(2500, 2520))
    monkeypatch.undo()
    plan = deep_paging.page_deep(df, 20, 2500, "asc", few=200)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("limit=(2520|2500)", plan)


def test_sort_by_mixed_field(spark):
    df = log(spark, [(T0, str(i), "s", {"v": v} if v else {}) for i, v in enumerate(["10", "9", "abc", None, "b", "9"])])
    assert [r._raw for r in paging.page(df, 10, order="asc", sort_by="v").collect()] == ["1", "5", "0", "2", "4", "3"]
    assert [r._raw for r in paging.page(df, 10, order="desc", sort_by="v").collect()] == ["4", "2", "0", "5", "1", "3"]


def test_histogram_buckets(spark):
    df = log(spark, [(T0 + dt.timedelta(milliseconds=m), "r", None if m == 0 else "s", {}) for m in (0, 999, 1000, 2500, 3000)])
    got = histogram.distribution(df, T0, T0 + dt.timedelta(seconds=3)).orderBy("bucket").collect()
    assert [r["count"] for r in got] == [1, 2, 0, 2] and got[0].source_counts == {}
    auto = histogram.distribution_auto(df).orderBy("bucket", "_src").collect()
    assert [(r.bucket, r._src, r["count"]) for r in auto] == [(0, "s", 1), (0, "unknown", 1), (1, "s", 1), (2, "s", 2)]
    empty = histogram.distribution(df.filter("false"), T0, T0).collect()
    assert [(r.bucket, r["count"]) for r in empty] == [(0, 0)]
    start, end, inner = histogram.drill(df, T0, T0 + dt.timedelta(seconds=3), 2, 1)
    assert sum(r["count"] for r in inner.collect()) == 2 and start > T0


def test_column_summaries(spark):
    df = log(spark, [(T0, "r", "s", {"ident": "-", "level": "x", "zeta": "1", "alpha": " ", "_hid": "1"}), (T0, "r", "s", {"level": "y", "auth": "q"})])
    fill = {r.column: r.filled for r in summary.column_fill(df).collect()}
    assert fill == {"ident": 0, "level": 2, "zeta": 1, "alpha": 0, "auth": 1, "error": 0}
    assert [r.column for r in summary.default_columns(df, 4).collect()] == ["level", "zeta", "auth", "alpha"]
    top = {(r.source, r.is_top): r["count"] for r in summary.top_sources(log(spark, [(T0, "r", s, {}) for s in "aaabbc"]), 2).collect()}
    assert top == {("a", True): 3, ("b", True): 2, ("other", False): 1}
    facet = summary.facets(df, ["level", "zeta"], 1).orderBy("field").collect()
    assert [(r.field, r.value, r["count"]) for r in facet] == [("level", "x", 1), ("zeta", "1", 1)]


@pytest.fixture(scope="module")
def kilns(spark):
    """Five rows: two of a kiln, two of a bell, one without fields."""
    fields = [{"state": "/Glowing", "heat": "940"}, {"state": "/cold", "heat": "12"}, {"level": "Warn", "text": "crack in the rim"}, {"level": "fine", "text": "rings true"}, {}]
    return log(spark, [(T0 + i * MIN, f"row {i}", "kiln" if i < 2 else "bell", f) for i, f in enumerate(fields)]).cache()


def test_first_rule_wins(kilns):
    rules = [
        tagging.Rule("level", "regex", "(", "never"),
        tagging.Rule("level", "eq", "WARN", "off", enabled=False),
        tagging.Rule("level", "eq", "WARN", "amber"),
        tagging.Rule("text", "contains", "RIM", "too late"),
        tagging.Rule("level", "neq", "warn", "calm"),
        tagging.Rule("state", "regex", "^/glowing", "wrong case"),
        tagging.Rule("state", "regex", r"^/(?P<word>\p{Ll}+)$", "small"),
        tagging.Rule("heat", "exists", "", "kiln"),
    ]
    got = tagging.tag(kilns, rules).orderBy("_seq").collect()
    assert [r.tag for r in got] == ["kiln", "small", "amber", "calm", None]
    assert got[2].tag_rule == 'Rule: level == "WARN"' and got[0].tag_rule == "Rule: heat exists"
    assert {r.tag: r["count"] for r in tagging.tag_counts(kilns, rules).collect() if r.tag} == {"kiln": 1, "small": 1, "amber": 1, "calm": 1}


def test_highlight(spark):
    df = log(spark, [(T0, "Connection reset; connection lost", "s", {})])
    m = display.Mark
    pick = lambda *marks: display.highlight(df, marks).first().highlighted
    assert pick(m("connection")) == "<b>Connection</b> reset; <b>connection</b> lost"
    assert pick(m("conn"), m("nection")) == "<b>Connection</b> reset; <b>connection</b> lost"
    assert pick(m("re.et", is_regex=True), m("lost", excluded=True), m("s", field="level")) == "Connection <b>reset</b>; connection lost"
    assert pick(m("(", is_regex=True)) == "Connection reset; connection lost"
    assert pick(m("zzz")) == "Connection reset; connection lost"


def test_columns_and_zone(kilns):
    df = display.select_columns(kilns, ["heat", "timestamp", "_src"])
    assert df.columns == ["timestamp", "heat", "_src"]
    assert str(kilns.select(relative.in_zone("timestamp", "America/New_York")).first()[0]) == "2024-01-15 05:00:00"


NOW = dt.datetime(2024, 6, 15, 12, tzinfo=dt.timezone.utc)


def test_relative_windows():
    d = dt.timedelta
    for args, want in (
        ((30, "minutes"), NOW - d(minutes=30)), ((2, "hours"), NOW - d(hours=2)), ((7, "days"), NOW - d(days=7)),
        ((2, "weeks"), NOW - d(weeks=2)), ((3, "months"), NOW.replace(month=3)), ((1, "years"), NOW.replace(year=2023)),
        ((5, "unknown"), NOW - d(days=1)),
    ):
        assert relative.window_of(NOW, "custom", *args)[0] == want
    assert relative.shift(NOW, 10, "minutes") == NOW + d(minutes=10)
    for preset, want in (
        ("last-5-minutes", NOW - d(minutes=5)), ("last-24-hours", NOW - d(hours=24)), ("last-quarter", NOW.replace(month=3)),
        ("year-to-date", dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)), ("last-1-year", NOW - d(days=365)),
        ("last-10-years", NOW - d(days=3650)), ("all-time", NOW - d(days=18250)), ("nonsense", NOW - d(hours=24)),
    ):
        assert relative.preset_start(preset, NOW) == want
    assert relative.window_of(NOW, "custom")[0] == NOW - d(days=7)
    assert relative.shift_months(dt.datetime(2024, 3, 31), -1) == dt.datetime(2024, 3, 2)


def test_views_in_one_scan(kilns):
    now = T0 + 10 * MIN
    views = [
        View("cracks", q.term("crack", "text")),
        View("kiln", sources=("kiln",), preset=None, start=T0, end=T0 + MIN),
        View("late", preset="custom", count=8, unit="minutes", columns=("level",), rules=(tagging.Rule("level", "eq", "WARN", "amber"),)),
        View("nothing", q.term("zzz")),
    ]
    got = {r.view_id: r for r in run_views(kilns, views, now).collect()}
    assert {k: v["count"] for k, v in got.items()} == {"cracks": 1, "kiln": 2, "late": 3, "nothing": 0}
    assert sum(got["kiln"].histogram.values()) == 2
    page = view_page(kilns, views[2], now).collect()
    assert [(r.level, r.tag) for r in page] == [(None, None), ("fine", None), ("Warn", "amber")]
    with pytest.raises(ValueError):
        run_views(kilns, [views[0], views[0]], now)


def test_windows_in_other_zones(spark):
    """Bounds in any zone find what the same moments in UTC find, with and without pruning by day."""
    from zoneinfo import ZoneInfo

    df = log(spark, [(dt.datetime(2031, 3, 9, tzinfo=dt.timezone.utc) + dt.timedelta(hours=i), "r", "s", {}) for i in range(72)])
    for zone in ("America/New_York", "Asia/Tokyo", "Australia/Lord_Howe"):
        start = dt.datetime(2031, 3, 9, 20, tzinfo=ZoneInfo(zone))
        end = start.replace(hour=23)
        want = df.filter(q.in_window(start.astimezone(dt.timezone.utc), end.astimezone(dt.timezone.utc))).count()
        assert df.filter(q.in_window(start, end)).count() == df.filter(q.in_window(start, end, prune=False)).count() == want == 4


def test_drill_over_a_change_of_the_clocks(spark):
    from zoneinfo import ZoneInfo

    df = log(spark, [(T0, "r", "s", {})])
    for day in (dt.datetime(2031, 7, 1), dt.datetime(2031, 3, 9), dt.datetime(2031, 11, 2)):
        start = day.replace(tzinfo=ZoneInfo("America/New_York"))
        end = start + dt.timedelta(days=1)
        got = histogram.drill(df, start, end, 0, histogram.bucket_count(start, end) - 1)
        assert (got[0], got[1]) == (start, end) and got[0].tzinfo == start.tzinfo


def test_error_is_a_column_to_fill(spark):
    df = log(spark, [(T0, "a", "s", {"level": "x"}), (T0, "b", "s", {"level": "-"}), (T0, "c", "s", {})]).withColumn("error", F.when(F.col("_raw") == "b", "no match"))
    got = {r.column: r.filled for r in summary.column_fill(df).collect()}
    assert got == {"level": 1, "error": 1}


def test_more_views_than_one_scan(spark, kilns, monkeypatch):
    from brooklog.plans import views as vw

    monkeypatch.setattr(vw, "VIEWS_PER_SCAN", 3)
    views = [View(f"v{i}", preset="custom", count=i + 1, unit="minutes") for i in range(8)]
    got = {r.view_id: r["count"] for r in run_views(kilns, views, T0 + 5 * MIN).collect()}
    assert got == {f"v{i}": min(i + 1, 5) for i in range(8)}
