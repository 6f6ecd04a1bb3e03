"""Near duplicates, secrets, fingerprints and languages against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brooklog.llm import fingerprints, language, near_duplicates, secret_scan
from brooklog.llm.common import work_folder
from brooklog.llm.components import components

BLANK = r"[^\x20\x09-\x0D]+"


def plain_components(rows, n, percent):
    """Shingle sets, links between all pairs, components."""
    sets = {}
    for k, t in rows:
        w = re.findall(BLANK, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_rows(seed=7):
    """Families of edited copies (some in chains), exact copies, and texts that share a long passage."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    shared = " ".join(pick.choice(words) for _ in range(60))
    for _ in range(25):
        text = [pick.choice(words) for _ in range(pick.choice([3, 30, 120]))]
        for _ in range(pick.randint(1, 9)):
            rows.append((k, " ".join(text)))
            k += 1
            text = list(text)
            for _ in range(max(1, len(text) // 40)):
                text[pick.randrange(len(text))] = pick.choice(words)
    rows += [(k + i, shared + " " + " ".join(pick.choice(words) for _ in range(40))) for i in range(30)]
    rows += [(k + 40 + i, "the same text in many rows of the table") for i in range(40)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(table, n):
    rows = near_rows()
    found = {r.doc_id: r for r in near_duplicates.near_duplicates(table(rows), n, 80).collect()}
    want = plain_components(rows, n, 80)
    assert {k: (r.n_shingles, r.component_id) for k, r in found.items()} == want
    assert all(r.kept == (r.component_id == k) for k, r in found.items())
    assert 1 < len({c for _, c in want.values()}) < len(want)


def test_near_duplicates_odd_rows(table, odd_rows):
    found = sorted(map(str, map(tuple, near_duplicates.near_duplicates(table(odd_rows), 2, 80).collect())))
    plain = plain_components([r for r in odd_rows if r[0] is not None], 2, 80)
    want = [(k, *plain[k], plain[k][1] == k) for k, _ in odd_rows if k is not None]
    want += [(None, 4, None, True), (None, 0, None, True)]
    assert found == sorted(map(str, want))
    assert near_duplicates.near_duplicates(table([]), 2).count() == 0
    stay = near_duplicates.keep_first(table(odd_rows), 2)
    keys = [k for k, _, _, kept in want if kept]
    assert stay.columns == table([]).columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(map(str, {k for k in keys if k is not None} | set())) + ["None"] * 2


def test_signature_keys_meet_under_the_distance():
    """Signatures that differ in no more than the greatest distance share a key, wherever they differ."""
    pick = random.Random(3)
    for _ in range(300):
        differ = set(pick.sample(range(near_duplicates.VALUES), near_duplicates.MAX_DISTANCE))
        assert any(not differ.intersection(key) for key in near_duplicates.KEYS)


def test_components(spark):
    pick = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(pick.randrange(200, 400), pick.randrange(200, 400)) for _ in range(120)]
    top = {}

    def find(k):
        while top.setdefault(k, k) != k:
            k = top[k]
        return k

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in components(frame).collect()} == {k: find(k) for k in top}
    assert components(frame.limit(0)).count() == 0


def plain_spans(text):
    """Matches from left to right by another engine; those too short are dropped."""
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


SECRETS = [
    "password = hunter2222 and TOKEN:'abc' secret:token:abcdefgh", "é😀 api_key=\"" + "0af9" * 9 + "\" AKIA" + "Z9" * 10, "AKIAAKIA" + "A" * 20 + " AKIA12", "token=token=abcdef" * 3,
    "passwd:" + "f" * 40 + " x " + "9" * 24, "nothing here", "secret" + " " * 50 + "= 'AKIA" + "B" * 30, "apikey=abcdefAKIA" + "0" * 20 + "\n" + "deadbeef" * 3,
]


def test_secrets(table, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(SECRETS)] + [(200 + i, SECRETS[1]) for i in range(20)]
    found = secret_scan.scan(table(rows)).select("doc_id", "blob", secret_scan.spans_text(F.col("spans")).alias("spans")).collect()
    want = [(k, hashlib.sha256((t or "").encode()).hexdigest(), plain_spans(t or "")) for k, t in rows]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert sum(bool(s) for *_, s in want) > 25
    assert secret_scan.scan(table([])).count() == 0


def test_ledger_scans_only_what_is_new(spark, table):
    ledger = work_folder(spark, "test-ledger")
    read = lambda: secret_scan.read_ledger(table([]), ledger, "1").select("blob").collect()
    secret_scan.scan(table([(1, SECRETS[0]), (2, SECRETS[0]), (3, None)]), ledger).collect()
    assert len(read()) == 2
    again = secret_scan.scan(table([(4, SECRETS[0]), (5, SECRETS[1])]), ledger).collect()
    assert len(read()) == 3 and all(r.spans for r in again)
    secret_scan.scan(table([(4, SECRETS[0])]), ledger, rule_version="2").collect()
    assert secret_scan.read_ledger(table([]), ledger, "2").count() == 1 and len(read()) == 3


def test_mask(table, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(SECRETS)]
    masked = secret_scan.mask(table(rows))
    assert masked.columns == table([]).columns

    def plain(text):
        if text is None:
            return None
        out = list(text)
        for part in filter(None, plain_spans(text).split(",")):
            _, a, b = part.split(":")
            out[int(a) : int(b)] = "*" * (int(b) - int(a))
        return "".join(out)

    assert sorted((str(r.doc_id), str(r.text)) for r in masked.collect()) == sorted((str(k), str(plain(t))) for k, t in rows)
    assert secret_scan.mask(table([])).count() == 0


def test_fingerprints(table):
    pick = random.Random(8)
    rows = [(pick.randrange(10**6), "".join(pick.choice("abcdefgh é中") for _ in range(pick.choice([0, 1, 5, 40, 900])))) for _ in range(60)]
    rows = list({k: (k, t) for k, t in rows}.values())
    found = {r.doc_id: r for r in fingerprints.fingerprint(table(rows).repartition(5)).collect()}
    order = sorted(rows, reverse=True)
    assert len(found) == len(rows)
    for i, (k, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        r = found[k]
        own, other, after = map(fingerprints.sketch, (t, edited, following))
        assert (r.n_chars, r.edited, r.fingerprint) == (len(t), edited, fingerprints.fingerprint_of(t, own))
        assert r.near_edited == fingerprints.overlap(own, other)[0] and r.near_next == fingerprints.overlap(own, after)[0]


def test_fingerprints_odd_rows(table, odd_rows):
    found = fingerprints.fingerprint(table(odd_rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in found) == sorted((str(k), len(t or "")) for k, t in odd_rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert len({r.fingerprint for r in found if r.doc_id in (1, 5)}) == 1
    assert fingerprints.fingerprint(table([])).count() == 0
    assert fingerprints.fingerprint(table([(1, "only one row of text")])).first().near_next == 1.0


def test_sketches_merge_and_estimate():
    pick = random.Random(2)
    a, b = ("".join(pick.choice("abcdefghij ") for _ in range(30_000)) for _ in range(2))
    kept = fingerprints.sketch(a)
    assert set(fingerprints.sketch(a + a).tolist()) >= set(kept.tolist())
    assert (fingerprints.from_text(fingerprints.as_text(kept)) == kept).all()
    assert abs(fingerprints.overlap(fingerprints.sketch(a[:9000]), kept)[1] - 1) < 0.05  # a short text in a long one
    assert abs(fingerprints.overlap(kept, fingerprints.sketch(a[:15_000] + b[:15_000]))[0] - 1 / 3) < 0.05


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, sample_rows=300)
    assert model.languages == ["de", "en", "es", "fr"]
    found = language.identify(docs, model, host=F.col("source")).join(docs.select("doc_id", F.col("lang").alias("want")), "doc_id").collect()
    assert len(found) == 1000 and all(r.kept for r in found)
    assert sum(r.lang == r.want for r in found) >= 990


def test_language_fuses_evidence(spark):
    """A text that says little is decided by its host and declaration."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, sample_rows=300)
    known = [(i, f"https://h.example.fr/{i}", f"<html lang=fr><p>{r.text}</p>") for i, r in enumerate(docs.filter("lang = 'fr'").limit(60).collect())]
    known += [(100 + i, f"https://g.example.de/{i}", f"<html lang=de><p>{r.text}</p>") for i, r in enumerate(docs.filter("lang = 'de'").limit(60).collect())]
    weak = [(200, "https://h.example.fr/x", "<html lang='fr'><b>en</b>"), (201, "https://g.example.de/x", "<html lang='de'><b>en</b>"), (202, None, None), (203, "no address", "<p>1234 !!</p>")]
    pages = spark.createDataFrame(known + weak, "page_id long, url string, html string")
    found = {r.page_id: r for r in language.identify(pages, model, "html", "page_id", url=F.col("url"), markup=True).collect()}
    assert found[200].lang == "fr" and found[201].lang == "de"
    assert not found[202].kept and found[202].lang is None and not found[203].kept


def test_language_odd_rows(table, odd_rows):
    rows = odd_rows + [(50, "1234 5678 !!"), (51, "the cat and the dog")]
    model = language.fit(table(rows))
    found = language.identify(table(rows), model, host=F.col("source")).collect()
    assert len(found) == len(rows) and {r.kept for r in found if r.doc_id in (2, 3, 6, 50)} == {False}
    stay = language.keep_identified(table(rows), model)
    assert stay.columns == table([]).columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(r.doc_id) for r in found if r.kept)
    nothing = language.fit(table([]))
    assert nothing.languages == [] and language.identify(table([]), nothing).count() == 0
    assert not any(r.kept for r in language.identify(table(rows), nothing).collect())


STRANGE = [
    "Съешь же ещё этих мягких французских булок да выпей чаю", "我们今天去公园散步然后回家吃饭", "これは日本語の文章です。今日は天気がいいですね", "هذا نص باللغة العربية عن الطقس اليوم",
    "Η γρήγορη καφέ αλεπού πηδάει πάνω από το σκυλί", "यह हिंदी भाषा का एक सरल वाक्य है और कुछ नहीं", "asdfkjh qwlkejr zxmcnvb sdkfjgh wieurty xcvmnb lkjhgf qpwoei zmxncb", "kjhsdf 8273 lkjsdhf !!! wqeiuy 9982 mznxbc qowieu",
]


def test_language_rejects_the_strange(spark):
    """Unknown scripts and mash go, also if they are labelled rows of the sample; clean rows rich in digits stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    clean = [(r.text[:60], r.lang) for r in docs.filter("lang is not null and length(text) > 60").orderBy("doc_id").limit(40).collect()]
    digits = [(10**6 + i, f"{t} {'4471 9930-22 %%% $$$ ' * 40}", lang, "s") for i, (t, lang) in enumerate(clean)]
    strange = [(2 * 10**6 + i, t, "en", "s") for i, t in enumerate(STRANGE)]
    both = docs.union(spark.createDataFrame(digits + strange, docs.schema))
    for model in (language.fit(docs), language.fit(both)):
        gone = {r.doc_id for r in language.identify(both, model, host=F.col("source")).filter("not kept").collect()}
        assert gone == {k for k, *_ in strange}


def test_language_models_every_label(spark):
    """Three rows of a label among a thousand are enough for a language, however small the sample is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rare = [(10**6 + i, t, lang, "s") for i, (t, lang) in enumerate([(STRANGE[0], "ru"), (STRANGE[0] + " и кофе", "ru"), (STRANGE[4], "el")])]
    rare += [(2 * 10**6, STRANGE[4] + " και καφέ", None, "s"), *[(None, STRANGE[0], "ru", "s")] * 300]  # unlabelled; repeated
    both = docs.union(spark.createDataFrame(rare, docs.schema))
    model = language.fit(both, sample_rows=40)
    assert model.languages == ["de", "el", "en", "es", "fr", "ru"]
    found = language.identify(both.filter("source = 's'"), model, host=F.lit("h")).collect()
    assert len(found) == len(rare) and all(r.kept and r.lang == ("el" if r.doc_id in (10**6 + 2, 2 * 10**6) else "ru") for r in found)


def test_short_sketches(spark, table):
    """Short texts: wholly contained in longer ones, their error by length, and no estimate without a hash."""
    pick = random.Random(4)
    some = lambda n: "".join(pick.choice("abcdefghij ") for _ in range(n))
    for short, long in ((some(n), some(3000)) for n in (1, 5, *range(12, 400, 3))):
        kept, whole = fingerprints.sketch(short), fingerprints.sketch(long + short)
        if len(short) >= 12:
            assert set(kept.tolist()) <= set(whole.tolist())  # so sketches merge
            pair = fingerprints.fingerprint_of(short, kept), fingerprints.fingerprint_of(long + short, whole)
            assert fingerprints.estimates(*pair)[1] == (1.0 if len(kept) else 0.0)
        assert len(kept) or 12 <= len(short) < 60
    for lengths, bound in (((12, 60), 0.15), ((60, 120), 0.1), ((120, 400), 0.05)):
        errors = []
        for _ in range(200):
            t = some(pick.randrange(*lengths))
            edited = fingerprints.edit(t, some(400))
            a, b = ({x[i : i + 12] for i in range(len(x) - 11)} for x in (t, edited))
            near, _ = fingerprints.estimates(*(fingerprints.fingerprint_of(x, fingerprints.sketch(x)) for x in (t, edited)))
            errors.append(abs(near - len(a & b) / len(a | b)))
        assert len(errors) > 150 and sum(errors) / len(errors) < bound
    unknown = next(t for t in iter(lambda: some(12), None) if not len(fingerprints.sketch(t)))
    found = {r.doc_id: r for r in fingerprints.fingerprint(table([(3, unknown), (2, unknown), (1, "short"), (0, "")])).collect()}
    assert found[2].fingerprint == found[3].fingerprint and found[2].fingerprint.startswith("-12-") and found[2].n_chars == 12
    assert (found[3].near_next, found[2].near_next, found[1].near_next, found[0].near_next) == (1.0, 0.0, 0.0, 0.0)
    assert fingerprints.fingerprint_of(unknown + "x", np.zeros(0)) != found[2].fingerprint and not len(fingerprints.from_text(found[2].fingerprint))


def test_two_scans_at_once(spark, table):
    """Both find the blobs new and add them; later reads see one entry per blob."""
    ledger = work_folder(spark, "test-ledger")
    docs = table([(1, SECRETS[0]), (2, SECRETS[1])])
    secret_scan.scan_new(docs, ledger)
    entries = secret_scan.read_ledger(docs, ledger, "1").collect()
    spark.createDataFrame(entries, secret_scan.LEDGER).write.mode("append").parquet(ledger)
    assert secret_scan.scan(docs, ledger).count() == 2 and secret_scan.mask(docs, ledger).count() == 2


def test_own_rules_and_a_shared_ledger(spark, table):
    """Findings of other rules under the same name are not taken for those of one's own."""
    ledger = work_folder(spark, "test-ledger")
    docs = table([(1, "pin 4711 and password = hunter2222"), (2, None), (3, "")])
    pins = (secret_scan.Rule("pin", "pin [0-9]{4}", 0, 8),)
    assert secret_scan.scan(docs, ledger).filter("size(spans) > 0").count() == 1
    masked = {r.doc_id: r.text for r in secret_scan.mask(docs, ledger, rules=pins).collect()}
    assert masked == {1: "******** and password = hunter2222", 2: None, 3: ""}
    assert {r.doc_id: len(r.spans) for r in secret_scan.scan(docs, ledger, rules=pins).collect()} == {1: 1, 2: 0, 3: 0}


def test_mask_without_a_broadcast(table, monkeypatch):
    monkeypatch.setattr(secret_scan, "BROADCAST_SPANS", 0)
    rows = [(i, SECRETS[i % len(SECRETS)]) for i in range(30)] + [(None, SECRETS[0]), (None, SECRETS[0])]
    assert secret_scan.mask(table(rows)).filter("text like '%hunter%'").count() == 0
    assert secret_scan.mask(table(rows)).count() == 32


def test_texts_under_one_key_are_kept_apart(table):
    """A near copy goes; a clean text under the same key stays, and so does one of rows that are equal."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, base), (2, base + " fifteen"), (2, "a clean text of quite other words than these"), (3, None), (3, ""), (3, "again"), (3, "again"), (None, base), (7, "again")]
    left = [(r.doc_id, r.text) for r in near_duplicates.keep_first(table(rows)).collect()]
    assert len(left) == 5 and {(1, base), rows[2], (7, "again"), (None, base)} < set(left)
    assert len({(3, None), (3, "")} & set(left)) == 1  # a null and an empty text are the same; either may stand for both
