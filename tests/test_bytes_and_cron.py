"""Cuts in bytes against Python's own decoding; schedules against a walk over minutes."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from brindle.functions import byte_text, cron
from brindle.plans.analytics import cron_schedules
from brindle.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def head_tail(text, cap):
    data = text.encode()
    if cap <= 0 or len(data) <= cap:
        return text
    head = cap // 2
    cut = lambda b: b.decode(errors="ignore")
    return f"{cut(data[:head])}\n\n...[truncated {len(data) - cap} bytes]...\n\n{cut(data[head - cap:])}"


def head_lines(text, cap):
    data = text.encode()
    if len(data) <= cap:
        return text
    data = data[:cap]
    at = data.rfind(b"\n")
    return (data[: at + 1] if at > len(data) // 2 else data).decode(errors="ignore")


def test_cuts_of_random_unicode(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\n é日😀\U0010ffff") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "\n", "日" * 30, "a" * 40, "\n" + "b" * 50, "b" * 30 + "\n" + "c" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for cap in (1, 2, 3, 7, 16, 31, 40):
        got = df.select("i", byte_text.head_tail(F.col("t"), cap).alias("a"), byte_text.head_lines(F.col("t"), cap).alias("b")).orderBy("i").collect()
        for t, r in zip(texts, got):
            assert (r["a"], r["b"]) == (head_tail(t, cap), head_lines(t, cap)), (t, cap)
    same = spark.createDataFrame([("x" * 99,), (None,)], "t string").select(byte_text.head_tail(F.col("t"), 0).alias("a"), byte_text.head_lines(F.col("t"), 5).alias("b")).collect()
    assert [tuple(r) for r in same] == [("x" * 99, "xxxxx"), (None, None)]


NAMES = {n: i for i, n in enumerate("sun mon tue wed thu fri sat".split())} | {n: i + 1 for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def allowed(field, low, high, top):
    out = set()
    for part in field.replace("?", "*").split(","):
        span, _, step = part.partition("/")
        number = lambda x: NAMES[x.lower()] if x.lower() in NAMES else int(x)
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(number, span.split("-"))
        else:
            a = number(span)
            b = high if step else a
        if not (low <= a <= b <= top) or step and int(step) < 1:
            raise ValueError(field)
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def brute(expression, after, n=64):
    """The first n ticks, a day at a time and a minute at a time within it; None for what can't be read."""
    try:
        minute, hour, day, month, weekday = expression.split()
        minutes, hours, days, months = (allowed(f, *r) for f, r in ((minute, (0, 59, 59)), (hour, (0, 23, 23)), (day, (1, 31, 31)), (month, (1, 12, 12))))
        weekdays = {w % 7 for w in allowed(weekday, 0, 6, 7)}
    except (ValueError, KeyError):
        return None
    either = day[0] not in "*?" and weekday[0] not in "*?"
    out, date = [], datetime(after.year, after.month, after.day)
    while len(out) < n:
        d, w = date.day in days, (date.weekday() + 1) % 7 in weekdays
        if date.month in months and (d or w if either else d and w):
            for m in range(1440):
                t = date + timedelta(minutes=m)
                if t > after and t.hour in hours and t.minute in minutes and len(out) < n:
                    out.append(t)
        date += timedelta(days=1)
    return out


def test_ticks_of_a_table_of_expressions(spark):
    after = [datetime(2024, 2, 28, 23, 58, 30), datetime(2023, 12, 31, 9, 0), datetime(2024, 1, 31, 12, 59, 59)]
    expressions = [
        "* * * * *", "*/7 * * * *", "* 9 * * *", "0 0 1 * *", "0 0 31 * *", "30 4 1,15 * 5", "0 22 * * 1-5", "23 0-20/2 * * *", "5 4 * * sun", "0 0 29 2 *", "0 12 * jan-mar,DEC mon", "15/20 3 * * *", "0 0 * * 7", "0 0 */2 * 1", "0 0 ? * ?",
        "  1 2 3 4 5  ", "59 23 31 12 *", "0 0 13 * 5-7", "60 * * * *", "* * * *", "* * * * * *", "a * * * *", "*/0 * * * *", "5-2 * * * *", "", "1-2-3 * * * *", "*-5 * * * *", "0 0 0 * *", "0 24 * * *", "1,,2 * * * *",
    ]
    rows = [(i * 10 + k, e, a) for i, e in enumerate(expressions) for k, a in enumerate(after)]
    df = spark.createDataFrame(rows, "i int, e string, a timestamp_ntz").withColumn("s", cron.fields(F.col("e"))).withColumn("t", cron.ticks(F.col("s"), F.col("a")))
    epoch = datetime(1970, 1, 1)
    got = {r["i"]: (r["t"], r["g"]) for r in df.select("i", "t", cron.smallest_gap(F.col("t")).alias("g")).collect()}
    for i, e, a in rows:
        want = brute(e, a)
        if want is None:
            assert got[i] == (None, None), e
            continue
        seconds = [int((t - epoch).total_seconds()) for t in want]
        assert got[i] == (seconds, min(b - a for a, b in zip(seconds, seconds[1:]))), (e, a)


def test_gaps_on_the_tables(spark):
    want = {}
    for r in cron_schedules(spark, SF).filter("event_id % 8 <> 5").collect():
        t = brute(r["expression"], r["after"]) if r["event_id"] % 8 != 4 else None
        want[r["event_id"]] = t and (min(int((b - a).total_seconds()) for a, b in zip(t, t[1:])), t[0].strftime("%Y-%m-%d %H:%M:%S"))
    got = {r["event_id"]: (r["gap"], r["next_run"]) for r in QUERIES["cron_gaps"](spark, SF).collect()}
    assert len(got) > 500 and all(got[i] == (want[i] or (None, None)) for i in want if i % 8 != 4)
    yearly = [got[i] for i in got if i % 8 == 4]
    assert all(g in (365 * 86400,) and n for g, n in yearly)
    assert {got[i] for i in got if i % 8 == 5} == {(1461 * 86400, next(got[i][1] for i in got if i % 8 == 5))}


def test_many_rare_schedules(spark):
    rows = spark.range(5000, numPartitions=1).select("id", F.concat(F.lit("0 0 29 feb "), F.lit("?")).alias("e"), F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_interval(0, 0, 0, cast(id as int))").alias("a"))
    began = time.time()
    found = rows.select("id", cron.ticks(cron.fields(F.col("e")), F.col("a")).alias("t")).groupBy(F.size("t").alias("n"), F.get("t", F.lit(0)).alias("first")).count().collect()
    assert time.time() - began < 15  # a walk over the days of each row's own 290 years takes minutes
    want = [datetime(y, 2, 29) for y in (2028, 2032, 2036, 2040)]
    assert {r["n"] for r in found} == {64} and sorted(r["first"] for r in found) == [(d - datetime(1970, 1, 1)) // timedelta(seconds=1) for d in want]
    assert sum(r["count"] for r in found) == 5000


def test_fewer_ticks_than_asked_for(spark):
    row = spark.createDataFrame([("0 0 29 2 */7", datetime(2024, 2, 29)), ("0 0 30 2 *", datetime(2024, 1, 1)), ("* * * * *", None), (None, datetime(2024, 1, 1))], "e string, a timestamp_ntz")
    sundays, date = [], datetime(2024, 3, 1)
    while date < datetime(2314, 3, 1):
        sundays += [date] * ((date.month, date.day, date.weekday()) == (2, 29, 6))
        date += timedelta(days=1)
    got = [r["t"] for r in row.select(cron.ticks(cron.fields(F.col("e")), F.col("a")).alias("t")).collect()]
    assert got == [[(d - datetime(1970, 1, 1)) // timedelta(seconds=1) for d in sundays], [], [], None]
