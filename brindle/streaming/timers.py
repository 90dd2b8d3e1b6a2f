"""Rate budgets that re-arm and signs of life, as streams: state with timers in event time.

Rows may come late, up to the watermark's delay: what depends on their order waits until the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.streaming.jobs import drain
from brindle.streaming.writer import with_timers

_NEVER = -1


class _OneTimer(StatefulProcessor):
    """A processor with one timer a key, at most."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _wake(self, milliseconds: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(milliseconds)

    def close(self) -> None:
        pass


class RateBudget(_OneTimer):
    """A key's requests in order of time: each counts, up to a budget, since the last silence."""

    def __init__(self, key: str, seconds: int, budget: int):
        self.key, self.silence, self.budget = key, seconds * 1_000_000, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "at bigint, event_id bigint")
        self.count = handle.getValueState("count", "last bigint, used bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        held += [(int(a), int(i)) for part in rows for a, i in zip(part["at"], part["event_id"])]
        self.waiting.put(held)
        self._wake(min(held)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        last, used = self.count.get() if self.count.exists() else (_NEVER, 0)
        out = []
        for at, event_id in held:
            if at >= passed:
                break
            used = 1 if last == _NEVER or at - last >= self.silence else used + 1
            last = at
            out.append((key[0], event_id, used, used <= self.budget))
        left = held[len(out) :]
        if left:
            self.waiting.put(left)
            self._wake(left[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if out or left:
            self.count.update((last, used))
        elif passed >= last + self.silence:
            self.count.clear()  # the next request starts anew anyway
        if not left and out:
            self._wake((last + self.silence) // 1000 + 1)
        yield pd.DataFrame(out, columns=[self.key, "event_id", "used", "allowed"])


class Liveness(_OneTimer):
    """A key's last sign of life, until it ends or has been silent for too long."""

    def __init__(self, key: str, minutes: int):
        self.key, self.idle = key, minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "last bigint, ended boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, ended = self.state.get() if self.state.exists() else (_NEVER, False)
        for part in rows:
            last, ended = max(last, int(part["at"].max())), bool(ended or part["ended"].any())
        self.state.update((last, ended))
        if not ended:
            self._wake((last + self.idle) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, ended = self.state.get() if self.state.exists() else (_NEVER, True)
        out = [] if ended else [(key[0], last)]
        yield pd.DataFrame(out, columns=[self.key, "last"])


def rate_budget_stream(events: DataFrame, key: str, seconds: int, budget: int) -> DataFrame:
    """The key, event_id, used, allowed of each request (key, ts with a watermark, event_id): as ``jobs.rate_budget``, once the watermark is behind it."""
    rows = events.select(key, "ts", "event_id", F.unix_micros("ts").alias("at"))
    return rows.groupBy(key).transformWithStateInPandas(RateBudget(key, seconds, budget), f"{key} {dict(events.dtypes)[key]}, event_id long, used long, allowed boolean", "Append", "EventTime")


def stale_stream(events: DataFrame, key: str, idle_minutes: int) -> DataFrame:
    """The key and the last sign of life (microseconds since 1970) of what has been silent for too long, each time that the watermark shows it.

    events have the key, ts with a watermark, heartbeat (may be null) and ended; one that has ended is never stale.
    """
    at = F.greatest(F.unix_micros("ts"), F.coalesce(F.unix_micros(F.col("heartbeat").cast("timestamp")), F.lit(0)))
    rows = events.select(key, "ts", at.alias("at"), "ended")
    return rows.groupBy(key).transformWithStateInPandas(Liveness(key, idle_minutes), f"{key} {dict(events.dtypes)[key]}, last long", "Append", "EventTime")


def drain_timers(stream: DataFrame) -> DataFrame:
    """Run such a stream over all that is there; its rows."""
    with with_timers(stream.sparkSession):
        return drain(stream, "append")
