"""Schedules of five fields (minute, hour, day, month, weekday) as sets of allowed values, and when they fall due."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges of the fields, the names of months and weekdays, and the number of ticks that a gap is looked for in.
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "sun mon tue wed thu fri sat".split()
TICKS = 64

_PART = re.compile(r"(\*|[0-9]+)(?:-([0-9]+))?(?:/([0-9]+))?")
#: Months that hold 65 due days of any kind (65 times the 29th of February), and days after which calendar and weekdays repeat themselves.
_MONTHS, _CYCLE = 12 * 290, 146_097


def _field(text: str, number: int) -> list[int] | None:
    """The values that a field allows, ascending; None if it can't be read."""
    low, high = RANGES[number]
    names, first = {3: (MONTHS, 1), 4: (WEEKDAYS, 0)}.get(number, ((), 0))
    for i, name in enumerate(names):
        text = re.sub(rf"\b{name}\b", str(i + first), text, flags=re.ASCII | re.IGNORECASE)
    top = 7 if number == 4 else high  # Sunday is 0 and 7
    found = set()
    for part in text.replace("?", "*").split(","):
        match = _PART.fullmatch(part)
        if not match or match[1] == "*" and match[2]:
            return None
        begin = low if match[1] == "*" else int(match[1])
        end = high if match[1] == "*" else int(match[2]) if match[2] else high if match[3] else begin
        step = int(match[3] or 1)
        if not (low <= begin <= end <= top and 1 <= step < 2**31):
            return None
        found.update(range(begin, end + 1, step))
    return sorted({v % 7 for v in found} if number == 4 else found)


@lru_cache(maxsize=4096)
def _parsed(expression: str) -> dict | None:
    parts = re.split(r"[ \t\n\x0b\f\r]+", expression.strip(" "))
    sets = [_field(p, i) for i, p in enumerate(parts)] if len(parts) == 5 else [None]
    return None if None in sets else dict(zip(("minutes", "hours", "days", "months", "weekdays"), sets)) | {"any_day": parts[2][0] in "*?", "any_weekday": parts[4][0] in "*?"}


def fields(expression: Column) -> Column:
    """(minutes, hours, days, months, weekdays, any_day, any_weekday) of an expression; null if it can't be read or has not five fields."""
    lists = [(c, pa.list_(pa.int32())) for c in ("minutes", "hours", "days", "months", "weekdays")]
    kind = pa.struct([*lists, ("any_day", pa.bool_()), ("any_weekday", pa.bool_())])

    def parsed(expressions: pa.Array) -> pa.Array:
        coded = expressions.dictionary_encode()  # each text of a batch becomes a struct once
        return pa.array([_parsed(e) for e in coded.dictionary.to_pylist()], kind).take(coded.indices)

    return F.arrow_udf(parsed, "minutes array<int>, hours array<int>, days array<int>, months array<int>, weekdays array<int>, any_day boolean, any_weekday boolean")(expression)


@lru_cache(maxsize=512)
def _due_days(days: bytes, months: bytes, weekdays: bytes, either: bool) -> np.ndarray:
    """The days of a cycle that are due, counted from 1970-01-01, ascending; arguments are int32 values as bytes."""
    day, month, weekday = (np.isin(x, np.frombuffer(v, np.int32)) for x, v in zip(_calendar(), (days, months, weekdays)))
    return np.flatnonzero(month & (day | weekday if either else day & weekday)).astype(np.int32)


@lru_cache(maxsize=1)
def _calendar() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Day of month, month and weekday (0 is Sunday) of each day of a cycle from 1970-01-01 on."""
    days = np.arange(_CYCLE).astype("datetime64[D]")
    months = days.astype("datetime64[M]")
    return (days - months).astype(int) + 1, months.astype(int) % 12 + 1, (np.arange(_CYCLE) + 4) % 7


@lru_cache(maxsize=1024)
def _seconds(hours: bytes, minutes: bytes) -> np.ndarray:
    """The times of a due day, in seconds, ascending."""
    return np.add.outer(np.frombuffer(hours, np.int32).astype(np.int64) * 3600, np.frombuffer(minutes, np.int32) * 60).ravel()


def _next(due: np.ndarray, times: np.ndarray, now: int, n: int) -> np.ndarray:
    """The first ``n`` times behind ``now`` (seconds since 1970)."""
    today = now // 86400
    if not (len(due) and len(times)):
        return np.zeros(0, np.int64)
    at = np.searchsorted(due, today % _CYCLE) + np.arange(-(-n // len(times)) + 1)  # a day more than needed, as today may be over
    days = today // _CYCLE * _CYCLE + at // len(due) * _CYCLE + due[at % len(due)]
    if days[-1] - today > _MONTHS * 28:
        days = days[days < (np.datetime64(today, "D").astype("datetime64[M]") + _MONTHS + 1).astype("datetime64[D]").astype(int)]
    found = np.add.outer(days * 86400, times).ravel()
    return found[np.searchsorted(found, now, "right") :][:n]


def ticks(schedule: Column, after: Column, n: int = TICKS) -> Column:
    """The first ``n`` times behind ``after`` (both without a zone, in the schedule's own clock) as seconds since 1970.

    ``schedule`` is a column of what ``fields`` yields. A day is due if its month is allowed and its day is; where both day and weekday are
    restricted, either will do. Due days are found once for all rows of the same days, months and weekdays, as the calendar repeats
    itself after 400 years. 290 years are looked at: a schedule that is due more rarely (Mondays that are a 29 February) has fewer ticks.
    """

    def found(schedules: pa.Array, afters: pa.Array) -> pa.Array:
        known, now = schedules.is_valid().to_pylist(), [None if v is None else v // 1_000_000 for v in afters.cast(pa.int64()).to_pylist()]
        minutes, hours, days, months, weekdays = (_value_bytes(schedules.field(c)) for c in ("minutes", "hours", "days", "months", "weekdays"))
        either = [not (d or w) for d, w in zip(schedules.field("any_day").to_pylist(), schedules.field("any_weekday").to_pylist())]
        none = np.zeros(0, np.int64)
        rows = [none if not k or t is None else _next(_due_days(days[i], months[i], weekdays[i], either[i]), _seconds(hours[i], minutes[i]), t, n) for i, (k, t) in enumerate(zip(known, now))]
        ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32(), mask=np.append(~np.array(known, bool), False))
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([none, *rows])))

    return F.arrow_udf(found, "array<bigint>")(schedule, after.cast("timestamp_ntz"))


def _value_bytes(lists: pa.ListArray) -> list[bytes]:
    """The int32 values of each list as bytes."""
    data, ends = lists.values.to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), lists.offsets.to_pylist()
    return [data[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]


def smallest_gap(found: Column) -> Column:
    """The smallest distance between neighbours of ascending times; 0 if there are fewer than two."""
    gaps = F.zip_with(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), lambda b, a: b - a)
    return F.when(found.isNotNull(), F.coalesce(F.array_min(gaps), F.lit(0)))


def next_run(found: Column) -> Column:
    """The first of the times, as a timestamp without a zone."""
    return F.timestamp_seconds(F.get(found, F.lit(0))).cast("timestamp_ntz")
