"""Streams with timers against their batch forms, with rows that come late and in several files."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from brindle.streaming import jobs, timers

KIND = "user_id long, event_id long, ts timestamp, heartbeat timestamp, ended boolean"


def late_rows(seed, n=240):
    """Rows in about the order of time; some come up to 25 minutes late."""
    rng, start, rows = random.Random(seed), datetime(2024, 3, 1), []
    for i in range(n):
        at = start + timedelta(minutes=7 * i) + timedelta(microseconds=rng.randrange(1_000_000) * (i % 3))
        at -= timedelta(minutes=rng.choice([0, 0, 0, 12, 25]))
        rows.append((rng.randrange(6), i, at, at + timedelta(minutes=3) if i % 4 == 0 else None, rng.random() < 0.01))
    return rows


def stream_of(spark, path, rows, per_file):
    """Files of some rows each, read one a batch; a last one moves the watermark two days on."""
    files = [rows[i : i + per_file] for i in range(0, len(rows), per_file)] + [[(-1, -1, max(r[2] for r in rows) + timedelta(days=2), None, True)]]
    for i, part in enumerate(files):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(path)
        new = [f for f in os.listdir(path) if f.endswith(".parquet") and not f.startswith("p0")]
        for f in new:
            os.rename(f"{path}/{f}", f"{path}/p0{i:03d}.parquet")
            os.utime(f"{path}/p0{i:03d}.parquet", (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"file://{path}").withWatermark("ts", "30 minutes")


def test_rate_budget(spark, tmp_path):
    rows = late_rows(3)
    rows = rows[:100] + [(r[0], 1000 + r[1], r[2], None, False) for r in rows[95:100]] + rows[100:]  # at the same times, later ids
    got = timers.drain_timers(timers.rate_budget_stream(stream_of(spark, f"{tmp_path}/in", rows, 40), "user_id", 3600, 2))
    want = jobs.rate_budget(spark.createDataFrame(rows, KIND).select("event_id", "user_id", "ts"), "user_id", "ts", 3600, 2)
    columns = ("user_id", "event_id", "used", "allowed")
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect()) and got.count() == len(rows)


def test_liveness(spark, tmp_path):
    rows = late_rows(4)
    quiet = [r for r in rows if not (r[0] == 2 and 60 <= r[1] < 120)]  # one is silent for hours and comes again
    got = timers.drain_timers(timers.stale_stream(stream_of(spark, f"{tmp_path}/in", quiet, 30), "user_id", 240))
    found = [(r["user_id"], r["last"]) for r in got.collect() if r["user_id"] >= 0]
    frame = spark.createDataFrame(quiet, KIND)
    now = (max(r[2] for r in quiet) + timedelta(days=1)).strftime("%Y-%m-%d %H:%M:%S")
    want = {r["user_id"] for r in jobs.stale(frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("heartbeat", F.col("heartbeat").cast("timestamp_ntz")), "user_id", now, 240).collect()}
    last = {r["user_id"]: r["last"] for r in frame.groupBy("user_id").agg(F.unix_micros(F.max(F.greatest("ts", F.coalesce("heartbeat", "ts")))).alias("last")).collect()}
    assert {u for u, at in found if at == last[u]} == want and len(found) == len(set(found))
    ended = {r[0] for r in quiet if r[4]}
    assert (2 in ended) or sum(u == 2 for u, _ in found) >= 2  # once in its silence, once at the end
