"""Grok extraction, suggestion and smart decoding."""

import pytest

from brooklog.functions.grok import Pattern, compile_grok
from brooklog.operators import extract as ex

KV = (
    "ts=%{TIMESTAMP_ISO8601:timestamp} level=%{WORD:level} service=%{WORD:service} host=%{DATA:host} "
    'status=%{NUMBER:status} latency_ms=%{NUMBER:latency_ms} msg="%{GREEDYDATA:message}"'
)
GATE = r"gate=%{INT:gate} car=%{NOTSPACE:car} at \[%{HTTPDATE:timestamp}\] from %{IP:client_ip} fee=%{NUMBER:fee}"
SYSLOG = r"%{SYSLOGTIMESTAMP:timestamp} %{HOSTNAME:host} %{PROG:program}\[%{POSINT:pid}\]: %{GREEDYDATA:message}"

MIXED = [
    "gate=7 car=KX-204 at [19/Nov/2031:06:15:00 +0100] from 198.51.100.4 fee=3.10",
    "gate=7 car=MV-11 at [19/Nov/2031:06:15:09 +0100] from 198.51.100.4 fee=0",
    "gate=2 car=- at [19/Nov/2031:06:16:40 +0100] from 203.0.113.77 fee=12.5",
    "Nov 19 06:17:02 mast3 pumpd[640]: pressure 4 bar at 198.51.100.9",
    "Nov 19 06:17:30 mast3 pumpd[641]: valve shut by 203.0.113.8",
    "lamps off",
]


def raws(spark, texts, src="s"):
    return spark.createDataFrame([(src, i, t) for i, t in enumerate(texts)], "_src string, n int, _raw string")


def test_key_value_lines(spark):
    line = 'ts=2024-01-02T03:04:05.678Z level=WARN service=billing host=web-1 status=503 latency_ms=12.5 msg="a "b" c"'
    row = ex.extract(raws(spark, [line, "garbage"]), KV, name="kv").orderBy("n").collect()
    assert row[0].matched and row[0].error is None
    assert row[0].attrs == {
        "timestamp": "2024-01-02T03:04:05.678Z", "level": "WARN", "service": "billing", "host": "web-1",
        "status": "503", "latency_ms": "12.5", "message": 'a "b" c',
    }
    assert row[1].attrs == {"message": "garbage"} and row[1].error == "Log line did not match the 'kv' pattern"


def test_custom_groups_and_repeated_names(spark):
    df = raws(spark, ["id=A-1", "key=b_2", "id="])
    pattern = r"(?:id=%{CODE:code}|(key)=%{WORD:code})"
    got = ex.extract(df, pattern, {"CODE": "([A-Z])-(\\d+)"}).orderBy("n").collect()
    assert [r.attrs for r in got] == [{"code": "A-1"}, {"code": "b_2"}, {"message": "id="}]
    named = ex.extract(df, r"(?<left>\w+)=(?P<right>.*)").orderBy("n").collect()
    assert [r.attrs for r in named] == [{"left": "id", "right": "A-1"}, {"left": "key", "right": "b_2"}, {"left": "id"}]


def test_bad_patterns():
    for bad in ("%{NOPE:x}", "%{WORD:x", "("):
        if bad == "%{WORD:x":
            assert compile_grok(r"\(%{WORD:x}").names == ("x",)
            continue
        with pytest.raises(ValueError):
            compile_grok(bad)
    with pytest.raises(ValueError):
        compile_grok("%{A}", {"A": "%{B}", "B": "%{A}"})


def test_first_match_by_priority(spark):
    patterns = [Pattern("any", "%{GREEDYDATA:message}", 0), Pattern("gate", GATE, 10), Pattern("syslog", SYSLOG, 5)]
    got = ex.extract_first(raws(spark, MIXED), patterns).orderBy("n").collect()
    assert [r.pattern for r in got] == ["gate"] * 3 + ["syslog"] * 2 + ["any"]
    assert got[0].attrs["client_ip"] == "198.51.100.4" and got[3].attrs["pid"] == "640"
    none = ex.extract_first(raws(spark, MIXED), patterns[1:])
    summary = ex.parse_summary(none).collect()[0]
    assert (summary.processed, summary.failed) == (5, 1)
    ok, bad = ex.split_matched(none)
    assert ok.count() == 5 and bad.first().error == "Log line did not match any configured pattern"


LIBRARY = [
    Pattern("gate", GATE, 1, timestamp_field="timestamp", timestamp_layout="02/Jan/2006:15:04:05 -0700"),
    Pattern("syslog", SYSLOG, 1),
    Pattern("ip", "%{IP:ip}", 0),
]


def test_suggest(spark):
    df = raws(spark, MIXED).unionByName(raws(spark, ["nothing here"], "empty"))
    best = ex.suggest(df, LIBRARY).collect()
    # Two patterns, "ip" covers most lines.
    assert [(r._src, r.name, round(r.coverage, 3)) for r in best] == [("s", "ip", 0.833)]
    tie = ex.suggest(raws(spark, MIXED[:3]), LIBRARY).first()
    assert tie.name == "gate" and tie.coverage == 1.0 and tie.timestamp_field == "timestamp"
    multi = ex.suggest_multi(raws(spark, MIXED), LIBRARY[:2]).orderBy("rank").collect()
    assert [(r.name, round(r.coverage, 3), round(r.combined, 3)) for r in multi] == [
        ("gate", 0.5, 0.5),
        ("syslog", 0.333, 0.833),
    ]
    table = spark.createDataFrame([(p.name, p.pattern, p.priority) for p in LIBRARY], "name string, pattern string, priority int")
    assert ex.suggest(df, table).first().name == "ip"


def test_cover_goes_on_while_something_is_gained(spark):
    """Seven overlapping patterns; a greedy cover of six of them explains every line."""
    texts = [f"k{i} common" if i % 2 else f"k{i} other" for i in range(7)] * 3
    patterns = [Pattern(f"only{i}", f"k{i} %{{WORD:w}}", i) for i in range(7)] + [Pattern("common", "%{NOTSPACE:k} common", 9)]
    got = ex.suggest_multi(raws(spark, texts), patterns).orderBy("rank").collect()
    assert [r.name for r in got] == ["common", "only6", "only4", "only2", "only0"] and round(got[-1].combined, 9) == 1
    lone = [Pattern(f"only{i}", f"k{i} %{{WORD:w}}", i) for i in range(7)]
    assert len(ex.suggest_multi(raws(spark, texts), lone).collect()) == 7
    assert len(ex.suggest_multi(raws(spark, texts), lone, k=2).collect()) == 2


def test_smart_decode(spark):
    text = "from 10.0.0.1 and 300.1.1.1 mail a.b@c.org see https://x.io/p?q=1 mac 00:1A:2b:3c:4d:5e id 123e4567-e89b-12d3-a456-426614174000"
    r = ex.smart_decode(raws(spark, [text])).first()
    assert r._ipv4_addr == ["10.0.0.1"] and r._email_addr == ["a.b@c.org"] and r._urls == ["https://x.io/p?q=1"]
    assert r._mac_addr == ["00:1A:2b:3c:4d:5e"] and r._uuids == ["123e4567-e89b-12d3-a456-426614174000"]


def test_meta(spark):
    df = ex.extract(raws(spark, ["id=1", "x"]), "id=%{INT:id}").orderBy("n")
    got = ex.with_meta(df, {"_src": "file.a", "id": "9", "env": "dev"}).orderBy("n").collect()
    assert [r._src for r in got] == ["file.a"] * 2
    assert got[0].attrs == {"id": "9", "env": "dev"} and got[1].attrs == {"message": "x", "id": "9", "env": "dev"}


def test_patterns_in_the_words_of_the_engine(spark):
    """Letters of any script, and possessive quantifiers, are the engine's; a fault of its grammar is named."""
    df = spark.createDataFrame([("Éclair 12",), ("--",)], "_raw string")
    got = ex.extract_first(df, [Pattern("p", r"^(?<word>\p{Lu}\p{L}++) %{INT:n}$")]).orderBy("_raw").collect()
    assert [r.attrs for r in got] == [{"message": "--"}, {"word": "Éclair", "n": "12"}]
    with pytest.raises(ValueError, match="bad grok pattern"):
        ex.extract_first(df, [Pattern("p", "(?<word>[)")])
