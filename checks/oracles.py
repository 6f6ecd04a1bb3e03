"""The registered queries in DuckDB SQL."""

from __future__ import annotations

START, END = 1704240000000000, 1704672000000000
NOW = 1706184000000000
ANCHOR, LATER = 1704153599000000, 1705708800000000
DAY = 86400000000

E = r"""e AS (
  SELECT *, CAST(us * 1000 AS VARCHAR) || '-' || src || '-' || CAST(event_id AS VARCHAR) AS id,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || src || ' user' || CAST(user_id AS VARCHAR) AS raw
  FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, epoch_us(CAST(ts AS TIMESTAMP)) AS us, event_type AS src, user_id,
               value, CAST(value AS VARCHAR) AS vtxt, json_extract_string(props, '$.k') AS k FROM events))"""
ASKED = f"us BETWEEN {START} AND {END} AND src IN ('error', 'click') AND value > 50"
DL = r"""dl AS (
  SELECT source AS src, doc_id, pos - 1 AS line_no,
         CASE WHEN regexp_matches(piece, '^[a-z]') THEN ' ' || piece ELSE piece END AS line
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS piece,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE piece <> '')"""
LINES = r"""l AS (
  SELECT event_id, event_type AS src, CASE
    WHEN event_id % 5 < 3 THEN t || ' ' || upper(event_type) || ' user=' || CAST(user_id AS VARCHAR) || ' k=' || json_extract_string(props, '$.k')
    WHEN event_id % 5 = 3 THEN 'ts=' || t || ' type=' || event_type || ' user=' || CAST(user_id AS VARCHAR) || ' msg="seen"'
    ELSE '?? ' || event_type END AS raw
  FROM (SELECT *, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS t FROM events))"""
PLAIN_RE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}) ([A-Za-z0-9_]+) user=([0-9]+) k=([0-9]+)$"
PAIRS_RE = r"^ts=([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}) type=([A-Za-z0-9_]+) user=([0-9]+) msg=\"(.*?)\"$"


def _tok(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')"


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


def _docs(where: str) -> str:
    return f"SELECT doc_id FROM documents WHERE {where}"


def _buckets(lo: int, hi: int, n: int = 100) -> str:
    span = hi - lo + 1
    at = f"CAST((CAST(us AS HUGEINT) - {lo}) * {n} // {span} AS BIGINT)"
    return f"""c AS (SELECT {at} AS bucket, count(*) AS n FROM e WHERE us BETWEEN {lo} AND {hi} GROUP BY 1)
      SELECT CAST(i AS BIGINT) AS bucket, CAST({lo} + (i * {span} + {n - 1}) // {n} AS BIGINT) AS start_us,
             CAST({lo} + ((i + 1) * {span} + {n - 1}) // {n} AS BIGINT) AS end_us, coalesce(c.n, 0) AS n
      FROM range({n}) r(i) LEFT JOIN c ON c.bucket = r.i"""


def _drill_dst() -> str:
    """12:00 EST on 9 March to 12:00 EDT on 11 March is 47 hours; buckets 10 to 89 of 100 of them, over moved events."""
    lo, hi = 1710003600000000, 1710172800000000
    span = hi - lo + 1
    moved = E.replace("e AS (", "e0 AS (", 1) + f", e AS (SELECT us + {60 * DAY} AS us FROM e0)"
    return _with(moved, ", " + _buckets(lo - (-10 * span // 100), lo - (-90 * span // 100) - 1))


def _auto(rows: str) -> str:
    return f"""WITH r AS ({rows}), s AS (SELECT min(us) AS lo, max(us) AS hi, (max(us) - min(us)) * 1000 AS span FROM r),
      w AS (SELECT *, greatest(span // 100, 1000000000) AS w0 FROM s),
      f AS (SELECT lo, hi, least(greatest(span // w0, 1), 100) AS n, span FROM w),
      g AS (SELECT *, greatest(span // n, 1) AS width FROM f),
      b AS (SELECT src, lo, width, CASE WHEN us = hi THEN n - 1 ELSE least((us - lo) * 1000 // width, n - 1) END AS bucket FROM r, g)
      SELECT CAST(bucket AS BIGINT) AS bucket, CAST(lo + bucket * width // 1000 AS BIGINT) AS start_us, src, count(*) AS n
      FROM b GROUP BY bucket, src, lo, width"""


def _page(body: str) -> str:
    return _with(E, f"SELECT us AS ts_us, id AS _id, src AS _src, event_id AS seq, vtxt AS value FROM e {body}")


SMART_RE = {
    "ipv4_addr": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
    "email_addr": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "urls": r"\bhttps?://[^\s\"''<>]+",
    "mac_addr": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "uuids": r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b",
}


def _smart(text: str, form: str) -> str:
    return ", ".join(form.format(x=f"regexp_extract_all({text}, '{p}')", n=n) for n, p in SMART_RE.items())


def _fold(head: str, max_lines: int, max_bytes: int) -> str:
    step = max_lines + 1
    return _with(
        DL,
        f""", g AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id, line_no) AS g FROM dl),
      h AS (SELECT *, coalesce(max(CASE WHEN {head} THEN g END) OVER (PARTITION BY src ORDER BY g), 1) AS h FROM g),
      s AS (SELECT *, g - (g - h) % {step} AS start FROM h),
      r AS (SELECT src, start, first(doc_id ORDER BY g) AS doc_id, first(line_no ORDER BY g) AS line_no, count(*) AS n_lines,
                   string_agg(line, ' ' ORDER BY g) AS raw FROM s GROUP BY src, start)
      SELECT src, doc_id, line_no, n_lines, strlen(raw) > {max_bytes} AS oversize, md5(raw) AS raw_md5 FROM r""",
    )


def _suggest_share(pattern: str) -> str:
    return f"count(*) FILTER (WHERE regexp_matches(raw, '{pattern}'))"


CARRIED = f"""c AS (SELECT event_id, event_type AS src, user_id < 40 AS own,
    last_value(CASE WHEN user_id < 40 THEN epoch_us(date_trunc('second', CAST(ts AS TIMESTAMP))) END IGNORE NULLS)
      OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held,
    row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
  q AS (SELECT event_id, src, coalesce(held, {ANCHOR}) AS ts_us,
    CASE WHEN own THEN 'exact' WHEN held IS NOT NULL OR rn > 1 THEN 'carried' ELSE 'synthetic' END AS confidence FROM c)"""

TAG = r"""t AS (SELECT event_id, CASE WHEN src = 'error' THEN 'red' WHEN regexp_matches(vtxt, '^9[0-9]\.') THEN 'high'
    WHEN contains(raw, 'user1') THEN 'ones' WHEN k <> '5' THEN 'rest' ELSE 'any' END AS tag FROM e)"""
TITLES = {
    "red": 'Rule: _src == "ERROR"', "high": r'Rule: value matches regex "^9\d\."', "ones": 'Rule: _raw contains "USER1"',
    "rest": 'Rule: k != "5"', "any": "Rule: user_id exists",
}

VIEW_SPECS = (
    ("errors", "src = 'error'", NOW - 7 * DAY, NOW),
    ("costly", "value >= 80", NOW - 3 * DAY, NOW),
    ("five days", "true", START, END),
)
VIEWS = "v AS (" + " UNION ALL ".join(
    f"SELECT '{v}' AS view_id, us, CAST((us - {lo}) * 100 // {hi - lo + 1} AS BIGINT) AS bucket FROM e WHERE us BETWEEN {lo} AND {hi} AND {test}"
    for v, test, lo, hi in VIEW_SPECS
) + ")"

FILL = """SELECT 'user_id' AS name, count(user_id) AS filled, 55 AS priority FROM e
        UNION ALL SELECT 'value', count(*) FILTER (WHERE trim(vtxt) NOT IN ('', '-')), 30 FROM e
        UNION ALL SELECT 'k', count(*) FILTER (WHERE trim(k) NOT IN ('', '-')), 30 FROM e
        UNION ALL SELECT 'error', count(*) FILTER (WHERE false), 30 FROM e"""

STAMPED = "CAST(ts AS TIMESTAMP)"
SECONDS = f"epoch_us(date_trunc('second', {STAMPED}))"

ORACLES: dict[str, str] = {
    "page_desc": _page(f"WHERE {ASKED} ORDER BY us DESC, event_id DESC LIMIT 100 OFFSET 20"),
    "page_by_field": """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS _id, l_orderkey * 8 + l_linenumber AS seq,
        l_quantity AS quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30 AND l_quantity < 40
        ORDER BY l_quantity, seq, _id LIMIT 200 OFFSET 100""",
    "page_summary": _with(E, f"SELECT count(*) AS total, CASE WHEN count(*) <= 20 THEN 0 ELSE 20 END AS \"offset\", greatest(least(count(*) - 20, 100), 0) AS \"count\" FROM e WHERE {ASKED}"),
    "page_after": _page("WHERE (us, event_id, id) < (1705276800000000, 5000, 'x') ORDER BY us DESC, event_id DESC LIMIT 50"),
    "latest_n": _page("ORDER BY us DESC, event_id DESC LIMIT 1000"),
    "dropped": "SELECT greatest(count(*) - 1000, 0) AS dropped FROM events",
    "bounds": _with(E, "SELECT min(us) AS first_us, max(us) AS last_us FROM e"),
    "total": _with(E, f"SELECT count(*) AS total FROM e WHERE {ASKED}"),
    "source_totals": "SELECT event_type AS src, count(*) AS n FROM events GROUP BY 1",
    "source_names": "SELECT DISTINCT source AS src FROM documents",
    "day_counts": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1",
    "top_sources": """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS s, count(*) AS n FROM events GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY n DESC, s) AS rk FROM c)
        SELECT CASE WHEN rk <= 8 THEN s ELSE 'other' END AS source, rk <= 8 AS is_top, CAST(sum(n) AS BIGINT) AS "count", count(*) AS n_sources
        FROM r GROUP BY 1, 2""",
    "distribution": _with(E, ", " + _buckets(START, END)),
    "distribution_by_source": _with(E, f""", c AS (SELECT CAST((us - {START}) * 100 // {END - START + 1} AS BIGINT) AS bucket, src FROM e WHERE us BETWEEN {START} AND {END}),
        d AS (SELECT bucket, count(*) AS n, count(*) FILTER (WHERE src = 'error') AS n_error, count(*) FILTER (WHERE src = 'click') AS n_click FROM c GROUP BY 1)
        SELECT CAST(i AS BIGINT) AS bucket, coalesce(n, 0) AS n, coalesce(n_error, 0) AS n_error, coalesce(n_click, 0) AS n_click
        FROM range(100) r(i) LEFT JOIN d ON d.bucket = r.i"""),
    "distribution_auto": _auto("SELECT epoch_us(CAST(ts AS TIMESTAMP)) AS us, event_type AS src FROM events"),
    "distribution_auto_orders": _auto("SELECT epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS us, o_orderpriority AS src FROM orders"),
    "drill": _with(E, ", " + _buckets(START + -(-20 * (END - START + 1) // 100), START + -(-41 * (END - START + 1) // 100) - 1)),
    "fit_window": f"SELECT epoch_us(date_trunc('day', min(ts))) - {DAY} AS start_us, epoch_us(date_trunc('day', max(ts))) + {2 * DAY - 1000000} AS end_us FROM events",
    "available_columns": _with(E, """, c AS (SELECT count(*) AS n, count(user_id) AS u, count(value) AS v, count(k) AS k FROM e)
        SELECT name FROM (SELECT unnest(['timestamp', '_raw', '_src', '_id']) AS name, n FROM c UNION ALL SELECT 'user_id', u FROM c
          UNION ALL SELECT 'value', v FROM c UNION ALL SELECT 'k', k FROM c) WHERE n > 0"""),
    "facets": _with(E, """, p AS (SELECT 'user_id' AS field, CAST(user_id AS VARCHAR) AS value FROM e UNION ALL SELECT 'k', k FROM e UNION ALL SELECT '_src', src FROM e),
        c AS (SELECT field, value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c)
        SELECT field, value, n, rank FROM r WHERE rank <= 5"""),
    "column_fill": _with(E, FILL),
    "default_columns": _with(E, f"SELECT name FROM ({FILL}) ORDER BY filled = 0, priority DESC, name LIMIT 2".replace(", SELECT", " SELECT")),
    "match_all": "SELECT doc_id FROM documents",
    "term": _docs(f"list_contains({_tok('text')}, 'was') OR list_contains({_tok('source')}, 'was') OR lang = 'was'"),
    "field_term": _docs("lang = 'fr'"),
    "term_any_field": f"SELECT page_id FROM pages WHERE list_contains({_tok('html')}, 'track') OR list_contains({_tok('url')}, 'track') OR list_contains({_tok('html')}, 'ref') OR list_contains({_tok('url')}, 'ref')",
    "phrase": _docs(f"contains(' ' || array_to_string({_tok('text')}, ' ') || ' ', ' of the ')"),
    "phrase_fuzzy": f"""WITH d AS (SELECT doc_id, {_tok('text')} AS t FROM documents),
        p AS (SELECT doc_id, unnest(t) AS a, unnest(t[2:] || [NULL]) AS b, unnest(t[3:] || [NULL, NULL]) AS c FROM d WHERE len(t) >= 3)
        SELECT DISTINCT doc_id FROM p WHERE b IS NOT NULL AND c IS NOT NULL AND abs(length(a) - 4) <= 1 AND abs(length(b) - 3) <= 1
          AND levenshtein(a, 'that') <= 1 AND levenshtein(b, 'was') <= 1 AND levenshtein(c, 'the') <= 1""",
    "wildcard_prefix": _docs(f"len(list_filter({_tok('text')}, lambda t: starts_with(t, 'erst'))) > 0"),
    "wildcard_suffix": _docs(f"len(list_filter({_tok('text')}, lambda t: ends_with(t, 'tioning'))) > 0"),
    "regex_term": _docs(f"len(list_filter({_tok('text')}, lambda t: regexp_full_match(t, 'to(ken|wer)s?'))) > 0"),
    "regex_text": r"SELECT page_id FROM pages WHERE regexp_matches(url, '/[0-9]{2}\?page=')",
    "fuzzy": _docs(f"len(list_filter({_tok('text')}, lambda t: abs(length(t) - 5) <= 1 AND levenshtein(t, 'tokem') <= 1)) > 0"),
    "bool_query": _docs(f"(list_contains({_tok('text')}, 'was')) AND lang IN ('en', 'de') AND NOT contains(' ' || array_to_string({_tok('text')}, ' ') || ' ', ' of the ')"),
    "num_range": _docs("n_chars > 1000 AND n_chars <= 5000"),
    "num_eq": _docs(f"n_chars = 250 OR list_contains({_tok('text')}, '250')"),
    "ts_range": _docs("doc_id * 60 > 5 * 3600 AND doc_id * 60 <= 9 * 3600"),
    "source_phrase": _docs("source IN ('src1', 'src3')"),
    "no_sources": _docs("false"),
    "in_window": _with(E, f"SELECT event_id FROM e WHERE us BETWEEN {START} AND {END}"),
    "in_last": _with(E, f"SELECT event_id FROM e WHERE us BETWEEN {NOW - 7 * DAY} AND {NOW}"),
    "in_last_units": _with(E, f"SELECT event_id FROM e WHERE us BETWEEN {NOW - 7 * DAY} AND {NOW} AND NOT us BETWEEN {NOW - 30 * 3600000000} AND {NOW}"),
    "select_columns": _with(E, "SELECT us AS ts_us, k, src FROM e"),
    "in_zone": """SELECT event_id, strftime(t - CASE WHEN t >= TIMESTAMP '2024-03-10 07:00:00' AND t < TIMESTAMP '2024-11-03 06:00:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END,
        '%Y-%m-%d %H:%M:%S') AS shown FROM (SELECT event_id, CAST(ts AS TIMESTAMP) + to_days(CAST(event_id % 340 AS INTEGER)) AS t FROM events)""",
    "null_source": """SELECT event_id, nullif(event_type, 'error') AS src, row_number() OVER w AS seq,
        last_value(CASE WHEN event_id % 3 = 0 THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""",
    "in_window_zone": "SELECT event_id FROM events WHERE CAST(ts AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-05 01:00:00' AND TIMESTAMP '2024-01-05 04:00:00'",
    "in_last_zone": "SELECT event_id FROM events WHERE CAST(ts AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-04 12:00:00' AND TIMESTAMP '2024-01-04 21:00:00'",
    "retain_zone": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1",
    "drill_dst": _drill_dst(),
    "mixed_dates": f"""SELECT event_id, epoch_us(CAST(last_value(CASE WHEN user_id < 70 OR event_id < 60 THEN CAST(s AS DATE) END IGNORE NULLS)
          OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS TIMESTAMP)) + epoch_us(s) % {DAY} AS ts_us,
        CASE WHEN user_id < 40 OR event_id < 60 THEN 'exact' ELSE 'inferred' END AS confidence
        FROM (SELECT *, date_trunc('second', CAST(ts AS TIMESTAMP)) AS s FROM events)""",
    "store_days": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(length(event_type)) AS BIGINT) AS n_bytes
        FROM (SELECT CAST(ts AS DATE) AS ts, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""",
    "highlight": _with(E, rf"SELECT event_id, regexp_replace(raw, '(error|user1[0-9])', '<b>\1</b>', 'g') AS highlighted FROM e WHERE {ASKED}"),
    "extract_fields": _with(LINES, f""", m AS (SELECT *, regexp_matches(raw, '{PLAIN_RE}') AS matched FROM l)
        SELECT event_id AS line_no, matched, CASE WHEN NOT matched THEN 'Log line did not match the ''plain'' pattern' END AS error,
          {", ".join(f"CASE WHEN matched THEN regexp_extract(raw, '{PLAIN_RE}', {i}) END AS f_{n}" for i, n in enumerate(("timestamp", "type", "user", "k"), 1))},
          CASE WHEN NOT matched THEN raw END AS f_message FROM m"""),
    "extract_first": _with(LINES, f"""SELECT event_id AS line_no,
          CASE WHEN regexp_matches(raw, '{PLAIN_RE}') THEN 'plain' WHEN regexp_matches(raw, '{PAIRS_RE}') THEN 'pairs' END AS pattern,
          CASE WHEN regexp_matches(raw, '{PLAIN_RE}') THEN regexp_extract(raw, '{PLAIN_RE}', 3) WHEN regexp_matches(raw, '{PAIRS_RE}') THEN regexp_extract(raw, '{PAIRS_RE}', 3) END AS f_user,
          CASE WHEN regexp_matches(raw, '{PLAIN_RE}') OR regexp_matches(raw, '{PAIRS_RE}') THEN 4 ELSE 1 END AS n_fields FROM l"""),
    "unmatched": _with(LINES, f"SELECT event_id AS line_no, 'Log line did not match any configured pattern' AS error, raw AS message FROM l WHERE NOT regexp_matches(raw, '{PLAIN_RE}') AND NOT regexp_matches(raw, '{PAIRS_RE}')"),
    "parse_summary": _with(LINES, f"SELECT src, {_suggest_share(PLAIN_RE)} AS processed, count(*) - {_suggest_share(PLAIN_RE)} AS failed FROM l GROUP BY src"),
    "suggest": _with(LINES, f""", c AS (SELECT src, count(*) AS total, {_suggest_share(PLAIN_RE)} AS a, {_suggest_share(PAIRS_RE)} AS b, {_suggest_share('user=[+-]?[0-9]+')} AS c FROM l GROUP BY src),
        u AS (SELECT src, total, 'plain' AS name, 5 AS p, a AS n FROM c UNION ALL SELECT src, total, 'pairs', 3, b FROM c UNION ALL SELECT src, total, 'loose', 1, c FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, p DESC, name) AS rk FROM u WHERE n > 0)
        SELECT src, name, round(n / total, 9) AS coverage, CASE WHEN name = 'plain' THEN 'timestamp' ELSE '' END AS timestamp_field,
          CASE WHEN name = 'plain' THEN '2006-01-02 15:04:05' ELSE '' END AS timestamp_layout FROM r WHERE rk = 1"""),
    "suggest_multi": _with(LINES, f""", c AS (SELECT src, count(*) AS total, {_suggest_share(PLAIN_RE)} AS a, {_suggest_share(PAIRS_RE)} AS b FROM l GROUP BY src),
        u AS (SELECT src, total, 'plain' AS name, 5 AS p, a AS n FROM c UNION ALL SELECT src, total, 'pairs', 3, b FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, p DESC) AS rank FROM u WHERE n > 0)
        SELECT src, rank, name, round(n / total, 9) AS coverage, round(sum(n) OVER (PARTITION BY src ORDER BY rank) / total, 9) AS combined FROM r"""),
    "smart_decode": f"SELECT doc_id, {_smart('text', 'array_to_string({x}, chr(124)) AS {n}')} FROM documents",
    "smart_decode_pages": f"SELECT page_id, {_smart('html', 'len({x}) AS n_{n}')} FROM pages",
    "with_meta": "SELECT 'file.events' AS src, '0' AS k, 'dev' AS env, count(value) AS n FROM events",
    "num_view": _with(DL, r""", w AS (SELECT src, unnest(regexp_split_to_array(line, '[^0-9A-Za-z.+-]+')) AS w FROM dl),
        n AS (SELECT src, CASE WHEN regexp_matches(w, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(w AS DOUBLE) END AS v FROM w)
        SELECT src, count(v) AS n, max(v) AS largest FROM n GROUP BY src"""),
    "fold_header": _fold("regexp_matches(line, '^(The|Is|And|En|Der|De|To|In|La|It) ')", 20, 1 << 20),
    "fold_indent": _fold(r"NOT regexp_matches(line, '^[ \t]')", 100, 2000),
    "detect_fold": _with(DL, r""", t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id, line_no) AS g,
          regexp_matches(line, '(?i)^(?:[\t ]|at |Caused by:|\.\.\. [0-9]+ more|(?:[a-zA-Z_$][A-Za-z0-9_$]*\.)+[A-Za-z_$][A-Za-z0-9_$]*(?:Exception|Error|Throwable)\b)') AS trace,
          NOT regexp_matches(line, '^[ \t]') AS indent, regexp_matches(line, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}') AS iso,
          regexp_matches(line, '^[A-Z][a-z]{2}\s+[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}') AS syslog FROM dl),
        c AS (SELECT src, 'syslog' AS name, 'header' AS mode, 3 AS o, g, trace, syslog AS head, indent FROM t
          UNION ALL SELECT src, 'iso8601', 'header', 2, g, trace, iso, indent FROM t UNION ALL SELECT src, 'indent', 'indent', 1, g, trace, indent, indent FROM t),
        s AS (SELECT src, name, mode, o, count(*) AS lines, count(*) FILTER (WHERE head OR g = 1) AS records,
          count(*) FILTER (WHERE (head OR g = 1) AND trace) AS orphans, count(*) FILTER (WHERE trace AND indent) AS bare FROM c GROUP BY ALL),
        k AS (SELECT *, lines - records - 8 * orphans AS score FROM s),
        u AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, o DESC) AS rk FROM k
          WHERE lines >= 3 AND records >= 2 AND records < lines AND score > 0 AND (mode = 'header' OR bare = 0))
        SELECT d.src, u.name, u.mode, u.score FROM (SELECT DISTINCT src FROM dl) d LEFT JOIN u ON u.src = d.src AND u.rk = 1"""),
    "trace_lines": _with(DL, r"SELECT src, count(*) AS n FROM dl WHERE regexp_matches(line, '(?i)^(?:[\t ]|at |Caused by:|\.\.\. [0-9]+ more|(?:[a-zA-Z_$][A-Za-z0-9_$]*\.)+[A-Za-z_$][A-Za-z0-9_$]*(?:Exception|Error|Throwable)\b)') GROUP BY src"),
    "turn_order": "SELECT CAST(conv_id AS VARCHAR) AS conv, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations",
    "parse_ts": f"""SELECT event_id, CASE event_id % 9 WHEN 1 THEN {SECONDS} - 7200000000 WHEN 7 THEN epoch_us({STAMPED}) // 1000 * 1000
        WHEN 8 THEN epoch_us({STAMPED}) ELSE {SECONDS} END AS ts_us FROM events""",
    "component_times": f"SELECT event_id, epoch_us({STAMPED}) // 1000 * 1000 - 7200000000 AS ts_us, 'exact' AS confidence FROM events",
    "carry_forward": _with(CARRIED, "SELECT event_id, ts_us, confidence FROM q"),
    "rollover_days": f"""WITH t AS (SELECT event_id, event_type AS src, epoch_us({STAMPED}) % {DAY} AS tod,
          lag(epoch_us({STAMPED}) % {DAY}) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events)
        SELECT event_id, CAST({ANCHOR - ANCHOR % DAY} + {DAY} * sum(CASE WHEN before - tod > {DAY // 2} THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY event_id) + tod AS BIGINT) AS ts_us,
          'inferred' AS confidence FROM t""",
    "rollover_years": f"SELECT event_id, {SECONDS} - {15 * DAY} AS ts_us, 'inferred' AS confidence FROM events",
    "two_digit_year": f"""WITH y AS (SELECT event_id, {STAMPED} AS ts, 2000 + user_id % 100 AS y FROM events),
        c AS (SELECT *, CASE WHEN y = 2000 THEN 2024 WHEN y > 2024 THEN y - 100 ELSE y END AS yy FROM y),
        t AS (SELECT event_id, yy, y, ts, epoch_us(make_timestamp(yy, 2, 3, hour(ts), minute(ts), CAST(second(ts) AS DOUBLE))) AS us FROM c)
        SELECT event_id, CASE WHEN us > {LATER} + 3600000000 THEN epoch_us(make_timestamp(yy - 1, 2, 3, hour(ts), minute(ts), CAST(second(ts) AS DOUBLE))) ELSE us END AS ts_us,
          'inferred' AS confidence FROM t""",
    "forced_date": f"SELECT event_id, epoch_us(TIMESTAMP '2020-03-01 00:00:00') + {SECONDS} % {DAY} + 12600000000 AS ts_us, 'exact' AS confidence FROM events",
    "synthetic_ts": f"SELECT event_id, {LATER} + row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS ts_us, 'synthetic' AS confidence FROM events",
    "profile_time": f"""WITH f AS (SELECT event_type AS src, first({STAMPED} ORDER BY event_id) AS ts FROM events GROUP BY 1)
        SELECT src, CASE src WHEN 'view' THEN 'exact' WHEN 'purchase' THEN 'missing' ELSE 'inferred' END AS status,
          CASE src WHEN 'view' THEN 'timestamp' WHEN 'click' THEN 'timestamp' WHEN 'error' THEN 'time|year' ELSE '' END AS components,
          CASE src WHEN 'view' THEN 4 WHEN 'error' THEN 2 WHEN 'signup' THEN 4 ELSE 0 END AS year_width,
          CASE WHEN src IN ('view', 'signup') THEN 'first_parsed' ELSE 'now' END AS anchor_kind,
          CASE WHEN src IN ('view', 'signup') THEN epoch_us(date_trunc('second', ts)) ELSE {NOW} END AS anchor_us,
          CASE src WHEN 'view' THEN 'parsed' WHEN 'signup' THEN 'parsed' WHEN 'error' THEN 'inferred_century' ELSE 'from_anchor' END AS year_strategy,
          src <> 'view' AS rollover, CASE WHEN src = 'signup' THEN 'created_at' END AS source_field, CASE WHEN src = 'signup' THEN 'unix_seconds' END AS source_format
        FROM f""",
    "time_candidates": f"""WITH f AS (SELECT event_type AS src, first({STAMPED} ORDER BY event_id) AS ts, first(user_id ORDER BY event_id) AS u FROM events GROUP BY 1)
        SELECT src, 'created_at' AS name, CAST(epoch_us(date_trunc('second', ts)) // 1000000 AS VARCHAR) AS sample, true AS parses, 16 AS score, 1 AS rank FROM f WHERE src = 'signup'
        UNION ALL SELECT src, 'user', CAST(u AS VARCHAR), false, 0, CASE WHEN src = 'signup' THEN 2 ELSE 1 END FROM f""",
    "time_quality": _with(CARRIED, "SELECT src, confidence, count(*) AS n FROM q GROUP BY 1, 2"),
    "time_examples": _with(CARRIED, """, r AS (SELECT *, row_number() OVER (PARTITION BY src, confidence ORDER BY event_id) AS n FROM q)
        SELECT src, confidence, n, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.000Z') AS resolved,
          CASE WHEN confidence = 'exact' THEN strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') END AS captured FROM r WHERE n <= 5"""),
    "tag_rows": _with(E + ", " + TAG, "SELECT event_id, tag, CASE tag " + " ".join(f"WHEN '{t}' THEN '{x}'" for t, x in TITLES.items()) + " END AS tag_rule FROM t"),
    "tag_counts": _with(E + ", " + TAG, "SELECT tag, count(*) AS n FROM t GROUP BY 1"),
    "run_views": _with(E + ", " + VIEWS, "SELECT view_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us, count(DISTINCT bucket) AS n_buckets FROM v GROUP BY 1 UNION ALL SELECT 'none', count(*), min(us), max(us), 0 FROM e WHERE list_contains(regexp_split_to_array(lower(raw), '[^a-z0-9_]+'), 'nowhere')"),
    "view_buckets": _with(E + ", " + VIEWS, "SELECT view_id, bucket, count(*) AS n FROM v GROUP BY 1, 2"),
    "view_page": _with(E, rf"""SELECT us AS ts_us, CAST(user_id AS VARCHAR) AS user_id, vtxt AS value,
          CASE WHEN regexp_matches(vtxt, '^9[0-9]\.') THEN 'high' WHEN contains(raw, 'user1') THEN 'ones' WHEN k <> '5' THEN 'rest' ELSE 'any' END AS tag
        FROM e WHERE src = 'error' AND us BETWEEN {NOW - 7 * DAY} AND {NOW} ORDER BY us DESC, event_id DESC LIMIT 50"""),
    "row_ids": _with(E, "SELECT id AS _id, CAST(CAST(ts AS DATE) AS VARCHAR) AS log_date FROM e"),
    "upsert": _with(E, "SELECT src, CASE WHEN src = 'error' THEN 'second' END AS raw, count(*) AS n, CAST(sum(CASE WHEN src = 'error' THEN event_id + 1 ELSE event_id END) AS BIGINT) AS seq_sum FROM e GROUP BY 1, 2"),
    "delete_ids": "SELECT event_type AS src, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS seq_sum FROM events WHERE user_id >= 20 GROUP BY 1",
    "delete_count": "SELECT count(*) AS n_deleted FROM events WHERE user_id < 20",
    "retain": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1",
    "validate_lines": _with(DL, "SELECT CASE WHEN strlen(line) <= 400 THEN 'ok' ELSE 'rejected' END AS kind, count(*) AS n, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM dl GROUP BY 1"),
    "export_rows": _with(E, f"SELECT id, value, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts FROM e WHERE {ASKED}"),
    "skipped_while_paused": _with(E, f""", p AS (SELECT n_name AS viewer, 1704067200000000 + n_nationkey * {DAY} AS lo FROM nation)
        SELECT viewer, src, count(*) AS skipped FROM p JOIN e ON us BETWEEN lo AND lo + {DAY * 3 // 2} GROUP BY 1, 2"""),
    "skipped_for_a_year": _with(E, f""", p AS (SELECT n_name AS viewer, 1704067200123456 + n_nationkey * 90000000000 AS lo, n_nationkey % 5 = 0 AS one FROM nation)
        SELECT viewer, src, count(*) AS skipped FROM p JOIN e ON us BETWEEN lo AND lo + {DAY} * 365 AND (NOT one OR src = 'click') GROUP BY 1, 2"""),
    "page_deep": _page("ORDER BY us DESC, event_id DESC LIMIT 200 OFFSET (SELECT count(*) // 2 FROM events)"),
    "page_deep_by_field": """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS _id, l_orderkey * 8 + l_linenumber AS seq,
        l_quantity AS quantity FROM lineitem ORDER BY l_quantity, seq, _id LIMIT 300 OFFSET (SELECT count(*) // 2 FROM lineitem)""",
    "search_page": _with(E, f"SELECT id AS _id, vtxt AS value FROM e WHERE {ASKED} ORDER BY value ASC, event_id ASC LIMIT 50 OFFSET 10".replace("ORDER BY value", "ORDER BY e.value")),
    "search_totals": _with(E, f"SELECT count(*) AS total, 0 AS \"offset\", 0 AS \"count\" FROM e WHERE us BETWEEN {START} AND {END} AND value > 50"),
    "ingest_hint": f"""WITH r AS (SELECT event_type AS src, event_id, user_id, epoch_us(date_trunc('second', CAST(ts AS TIMESTAMP))) AS ts_us,
            row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events WHERE event_type IN ('click', 'view'))
        SELECT CAST(ts_us * 1000 AS VARCHAR) || '-' || src || '-' || CAST(seq AS VARCHAR) AS _id, ts_us, src, CAST(user_id AS VARCHAR) AS f_user, 'exact' AS ts_confidence FROM r""",
    "ingest_rows": _with(LINES, f""", m AS (SELECT l.*, regexp_matches(raw, '{PLAIN_RE}') OR regexp_matches(raw, '{PAIRS_RE}') AS matched, {SECONDS} AS own,
            CAST(user_id AS VARCHAR) AS u FROM l JOIN events USING (event_id)),
        h AS (SELECT *, last_value(CASE WHEN matched THEN own END IGNORE NULLS) OVER (PARTITION BY src ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held,
            row_number() OVER (PARTITION BY src ORDER BY event_id) AS seq FROM m),
        t AS (SELECT *, coalesce(held, {ANCHOR}) AS ts_us FROM h)
        SELECT CAST(ts_us * 1000 AS VARCHAR) || '-' || src || '-' || CAST(seq AS VARCHAR) AS _id, ts_us, src,
          CASE WHEN NOT matched THEN 'Log line did not match any configured pattern' END AS error, CASE WHEN matched THEN u END AS f_user,
          CASE WHEN matched THEN 'exact' WHEN held IS NOT NULL THEN 'carried' ELSE 'synthetic' END AS ts_confidence FROM t"""),
}
