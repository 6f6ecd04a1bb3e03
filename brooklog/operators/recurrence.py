"""The clock of a source: each line's time may lean on the time of the line before.

A line without a year, or without a date, borrows it from the previous line, and a jump
back moves the line on by a day or a year.  That is a recurrence along the source.  It is
computed block by block: what a block does to the time that enters it is captured by a
small table, and tables of neighbouring blocks compose into one.  So runs of blocks are
composed, the few runs of a source are applied in order, then the blocks of each run, and
with the entering time of every block known each block is run on its own.

The table is exact because the first line of a kind leaves only few possible times:

* lines with the time of day alone move whatever date enters by a fixed number of days;
* the first line that names month or day leaves, per year, the named day itself or the
  day or year after.  Years repeat every four (1901-2099), so four years stand for all;
* the first line that names a year leaves its own time or the day or year after.

The functions here see one block (or one row per block) at a time.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa

DAY = 86_400_000_000
HOUR = 3_600_000_000
EPOCH = dt.date(1970, 1, 1).toordinal()
FOUR_YEARS = 1461 * DAY

CLAMP_SLACK = HOUR
DAY_JUMP = 12 * HOUR
YEAR_JUMP = 180 * DAY


class State(NamedTuple):
    """A resolved time: wall clock, seconds east of UTC, zone name."""

    wall: int
    off: int
    zone: str

    @property
    def utc(self) -> int:
        return self.wall - self.off * 1_000_000


class Line(NamedTuple):
    """Time parts of one matched line; ``tod`` is None when the line has no time."""

    y: int | None
    mo: int | None
    d: int | None
    tod: int | None
    off: int
    zone: str
    two_digit: bool


class Rules(NamedTuple):
    anchor: int  # UTC microseconds
    rollover: bool

    @property
    def start(self) -> State:
        return State(self.anchor, 0, "+00:00")


@lru_cache(maxsize=4096)
def _month_start(y: int, mo: int) -> int:
    y, mo = y + (mo - 1) // 12, (mo - 1) % 12 + 1
    return (dt.date(min(max(y, 1), 9999), mo, 1).toordinal() - EPOCH) * DAY


@lru_cache(maxsize=4096)
def _civil(day: int) -> dt.date:
    return dt.date.fromordinal(day + EPOCH)


def wall_of(y: int, mo: int, d: int, tod: int) -> int:
    """A day the month lacks runs over into the next month."""
    return _month_start(y, mo) + (d - 1) * DAY + tod


def add_years(wall: int, n: int) -> int:
    day = _civil(wall // DAY)
    return wall_of(day.year + n, day.month, day.day, wall % DAY)


def step(line: Line, prev: State | None, rules: Rules) -> State:
    """Time of a line after ``prev`` (None before the first line of the source)."""
    if line.tod is None:
        return prev or rules.start
    y, mo, d = line.y, line.mo, line.d
    from_anchor = line.two_digit
    if y is None or mo is None or d is None:
        day = _civil((prev or rules.start).wall // DAY)
        if y is None:
            y, from_anchor = day.year, from_anchor or prev is None
        mo = day.month if mo is None else mo
        d = day.day if d is None else d
    now = State(wall_of(y, mo, d, line.tod), line.off, line.zone)
    if from_anchor and now.utc > rules.anchor + CLAMP_SLACK:
        now = now._replace(wall=add_years(now.wall, -1))
    if rules.rollover and prev is not None:
        back = prev.utc - now.utc
        if back > YEAR_JUMP:
            now = now._replace(wall=add_years(now.wall, 1))
        elif back > DAY_JUMP:
            now = now._replace(wall=now.wall + DAY)
    return now


def _outcomes(line: Line, rules: Rules) -> set[State]:
    """Every time a line that names a year, month or day can resolve to."""
    years = [line.y] if line.y is not None else range(2000, 2004)
    months = [line.mo] if line.mo is not None else range(1, 13)
    days = [line.d] if line.d is not None else range(1, 32)
    out = set()
    for y in years:
        for mo in months:
            for d in days:
                wall = wall_of(y, mo, d, line.tod)
                if line.two_digit and wall - line.off * 1_000_000 > rules.anchor + CLAMP_SLACK:
                    wall = add_years(wall, -1)
                # The year before: a year guessed from the anchor is taken back if it lies past it.
                for w in (wall, wall + DAY, add_years(wall, 1), *([add_years(wall, -1)] if line.y is None else [])):
                    out.add(State(w, line.off, line.zone))
    if line.y is None:
        out = {_canonical(s)[0] for s in out}
    return out


def _canonical(s: State) -> tuple[State, int]:
    """The same time in the years 2000-2003 and the shift that was taken off."""
    shift = (_civil(s.wall // DAY).year - 2000) // 4 * FOUR_YEARS
    return s._replace(wall=s.wall - shift), shift


def _table(lines: list[Line], rules: Rules) -> list:
    """Exits of a run of lines for every outcome of its first line; equal paths are walked once."""
    starts = sorted(_outcomes(lines[0], rules))
    now = {s: s for s in starts}
    for line in lines[1:]:
        if line.tod is None:
            continue
        moved = {s: step(line, s, rules) for s in set(now.values())}
        now = {s: moved[at] for s, at in now.items()}
    return [[s.wall, *now[s]] for s in starts]


def summarise(lines: list[Line], rules: Rules) -> str:
    """What a block does to the time that enters it."""
    timed = [x for x in lines if x.tod is not None]
    out: dict = {"rules": list(rules), "opens": bool(lines) and lines[0].tod is None}
    in_year = next((i for i, x in enumerate(timed) if x.y is not None), len(timed))
    in_date = next((i for i, x in enumerate(timed[:in_year]) if x.mo is not None or x.d is not None), in_year)
    bare, dated, full = timed[:in_date], timed[in_date:in_year], timed[in_year:]
    if bare:
        first = State(bare[0].tod, bare[0].off, bare[0].zone)
        last = first
        for line in bare[1:]:
            last = step(line, last, rules)
        out["bare"] = [list(bare[0]), last.wall - first.wall, last.off, last.zone]
    if dated:
        out["dated"] = [list(dated[0]), _table(dated, rules)]
    if full:
        out["full"] = [list(full[0]), _table(full, rules)]
    return json.dumps(out)


def _exits(part: list, dated: bool) -> Callable[[State, Rules], State]:
    """What the lines of one part make of a time before them."""
    first, table = Line(*part[0]), {row[0]: row[1:] for row in part[1]}

    def through(now: State | None, rules: Rules) -> State:
        at = step(first, now, rules)
        at, shift = _canonical(at) if dated else (at, 0)
        wall, off, zone = table[at.wall]
        return State(wall + shift, off, zone)

    return through


def _moves(part: list) -> Callable[[State, Rules], State]:
    first, moved, off, zone = part

    def through(now: State | None, rules: Rules) -> State:
        return State(step(Line(*first), now, rules).wall + moved, off, zone)

    return through


def _parts_of(summary: dict) -> dict[str, Callable[[State, Rules], State]]:
    """The effects of a summary, in order."""
    made = {"bare": _moves, "dated": lambda p: _exits(p, True), "full": lambda p: _exits(p, False)}
    return {name: make(summary[name]) for name, make in made.items() if name in summary}


def compose(one: dict, other: dict) -> dict:
    """The summary of two runs of lines, one after the other."""
    if not one["opens"] and not any(p in one for p in ("bare", "dated", "full")):
        return other
    rules, out = Rules(*one["rules"]), dict(one)
    for name, through in _parts_of(other).items():
        if "full" in out:
            first, table = out["full"]
            out["full"] = [first, [[row[0], *through(State(*row[1:]), rules)] for row in table]]
        elif name == "full":
            out["full"] = other["full"]
        elif "dated" in out:
            first, table = out["dated"]
            out["dated"] = [first, [[row[0], *through(State(*row[1:]), rules)] for row in table]]
        elif name == "bare" and "bare" in out:
            first, moved, off, zone = out["bare"]
            tod = Line(*first).tod
            now = through(State(tod + moved, off, zone), rules)
            out["bare"] = [first, now.wall - tod, now.off, now.zone]
        else:
            out[name] = other[name]
    return out


def advance(summary: str | dict, entering: State | None) -> State | None:
    """The time that leaves a block or a run of blocks."""
    s = json.loads(summary) if isinstance(summary, str) else summary
    rules = Rules(*s["rules"])
    now = entering
    if now is None and s["opens"]:
        now = rules.start
    for through in _parts_of(s).values():
        now = through(now, rules)
    return now


def lines_of(rows: pa.Table) -> list[Line]:
    return [Line(*x) for x in zip(*[rows[c].to_pylist() for c in ("y", "mo", "d", "tod", "off", "zone", "two")])]


def rules_of(rows: pa.Table) -> Rules:
    return Rules(rows["anchor"][0].as_py(), rows["rollover"][0].as_py())


def block_summary(rows: pa.Table) -> pa.Table:
    """One block in, its summary out."""
    rows = rows.sort_by("line_no")
    text = summarise(lines_of(rows.filter(rows["matched"])), rules_of(rows))
    return pa.table({"_src": rows["_src"][:1], "block": rows["block"][:1], "summary": [text]})


def run_summary(blocks: pa.Table) -> pa.Table:
    """The blocks of one run in, their composed summary out."""
    blocks = blocks.sort_by("block")
    out = None
    for summary in blocks["summary"].to_pylist():
        out = json.loads(summary) if out is None else compose(out, json.loads(summary))
    return pa.table({"_src": blocks["_src"][:1], "run": blocks["run"][:1], "block": blocks["block"][:1], "summary": [json.dumps(out)]})


def _entering(rows: pa.Table, now: State | None) -> dict[str, pa.Array]:
    entering = []
    for summary in rows["summary"].to_pylist():
        entering.append(now or (None, None, None))
        now = advance(summary, now)
    walls, offs, zones = zip(*entering)
    return {"in_wall": pa.array(walls, pa.int64()), "in_off": pa.array(offs, pa.int64()), "in_zone": pa.array(zones, pa.string())}


def entering_times(runs: pa.Table) -> pa.Table:
    """Summaries of the runs of one source in, the time that enters each run out."""
    runs = runs.sort_by("block")
    return pa.table({"_src": runs["_src"], "block": runs["block"], "run": runs["run"], **_entering(runs, None)})


def entering_blocks(blocks: pa.Table) -> pa.Table:
    """The blocks of one run with the time that enters it in, the time that enters each block out."""
    blocks = blocks.sort_by("block")
    wall, off, zone = (blocks[c][0].as_py() for c in ("in_wall", "in_off", "in_zone"))
    return pa.table({"_src": blocks["_src"], "block": blocks["block"], **_entering(blocks, None if wall is None else State(wall, off, zone))})


def block_times(rows: pa.Table) -> pa.Table:
    """One block with its entering time in, the time of every line out."""
    rows = rows.sort_by("line_no")
    rules = rules_of(rows)
    wall, off, zone = (rows[c][0].as_py() for c in ("in_wall", "in_off", "in_zone"))
    now = None if wall is None else State(wall, off, zone)
    walls, zones, labels = [], [], []
    for line, matched, inferred in zip(lines_of(rows), rows["matched"].to_pylist(), rows["inferred"].to_pylist()):
        if matched and line.tod is not None:
            now = step(line, now, rules)
            labels.append("inferred" if inferred else "exact")
        else:
            labels.append("synthetic" if now is None else "carried")
            if matched:
                now = now or rules.start
        at = now or rules.start
        walls.append(at.wall)
        zones.append(at.zone)
    return pa.table(
        {
            "_src": rows["_src"],
            "block": rows["block"],
            "line_no": rows["line_no"],
            "wall": pa.array(walls, pa.int64()),
            "zone": pa.array(zones, pa.string()),
            "ts_confidence": pa.array(labels, pa.string()),
        }
    )
