"""Run every registered query beside its SQL and compare the results.

    python -m checks.compare [sf_dir] [name …]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from brooklog.session import local_session  # noqa: E402
from checks.oracles import ORACLES  # noqa: E402
from checks.queries import QUERIES  # noqa: E402


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _key(row: tuple) -> tuple:
    return tuple("" if v is None else str(v) for v in row)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=_key)


def compare(spark, con, sf: str, name: str) -> str:
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return f"no oracle, {len(got)} rows"
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}"
    if [_key(r) for r in got] != [_key(r) for r in want]:
        diff = [(g, w) for g, w in zip(got, want) if _key(g) != _key(w)][:2]
        return f"DIFFERENT {len(got)} vs {len(want)} rows {diff}"
    return f"ok {len(got)} rows"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8, "compare")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        at = time.time()
        try:
            verdict = compare(spark, con, sf, name)
        except Exception as e:
            verdict = f"ERROR {type(e).__name__} {str(e)[:300]}"
        bad += not verdict.startswith(("ok", "no oracle"))
        print(f"{name:26s} {time.time() - at:6.2f}s {verdict}", flush=True)
    print(f"{len(names) - bad}/{len(names)} fine")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
