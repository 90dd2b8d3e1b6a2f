"""A journal written in small batches: a message's events go out sixteen at a time, or as they are after a tenth of a second."""

from __future__ import annotations

import bisect
import time
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.sources.shared import fresh_path

# Events of a batch, and how long one waits for more of them.
SIZE, MILLISECONDS = 16, 100

KEY, ORDER = "message_id", "sequence_no"
_STATE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_timers(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state where timers can be kept too."""
    before = spark.conf.get(_STATE, None)
    spark.conf.set(_STATE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STATE, before) if before else spark.conf.unset(_STATE)


def add_number(ranges: list[list[int]], n: int) -> bool:
    """Put a number into ascending ranges (first, last) that neither overlap nor touch; false if it is there."""
    at = bisect.bisect_right(ranges, [n, float("inf")])
    if at and ranges[at - 1][1] >= n:
        return False
    left, right = at and ranges[at - 1][1] == n - 1, at < len(ranges) and ranges[at][0] == n + 1
    if left and right:
        ranges[at - 1][1] = ranges.pop(at)[1]
    elif left:
        ranges[at - 1][1] = n
    elif right:
        ranges[at][0] = n
    else:
        ranges.insert(at, [n, n])
    return True


class JournalBatches(StatefulProcessor):
    """One message's events: which numbers were seen (as ranges, so one for a message without gaps), and those that wait."""

    def __init__(self, columns: list[str], waiting: T.StructType, size: int, milliseconds: int):
        self.columns, self.waiting_schema, self.size, self.milliseconds = columns, waiting, size, milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ranges array<array<bigint>>, flushes bigint")
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def _state(self) -> tuple[list[list[int]], int]:
        ranges, flushes = self.seen.get() if self.seen.exists() else ([], 0)
        return [list(map(int, r)) for r in ranges], int(flushes)

    def _out(self, key: tuple, rows: list[tuple], flush: int, reason: str) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.columns)
        out.insert(0, KEY, key[0])
        return out.assign(flush=flush, reason=reason)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ranges, flushes = self._state()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        came = pd.concat(list(rows)).sort_values(ORDER, kind="stable")
        last = bool(came["last"].fillna(False).any())
        fresh = [r for r in came[self.columns].astype(object).where(came[self.columns].notna(), None).itertuples(index=False, name=None) if add_number(ranges, int(r[0]))]
        ready = [tuple(r) for r in held] + fresh
        while len(ready) >= self.size or last and ready:
            flushes += 1
            yield self._out(key, ready[: self.size], flushes, "size" if len(ready) >= self.size else "close")
            ready = ready[self.size :]
        self.seen.update((ranges, flushes))
        if ready:
            self.waiting.put(ready)
            if len(ready) <= len(fresh):  # what waits came now, so it waits from now on
                self._no_timers()
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.milliseconds)
        else:
            self.waiting.clear()
            self._no_timers()

    def _no_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        if held:
            ranges, flushes = self._state()
            self.seen.update((ranges, flushes + 1))
            self.waiting.clear()
            yield self._out(key, held, flushes + 1, "time")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        ranges: list[list[int]] = []
        for n in initialState[ORDER]:
            add_number(ranges, int(n))
        self.seen.update((ranges, int(initialState["flush"].max())))

    def close(self) -> None:
        pass


def write_journal(messages: DataFrame, path: str, size: int = SIZE, milliseconds: int = MILLISECONDS, checkpoint: str | None = None):
    """Append a stream of (message_id, sequence_no, ..., last) to a journal; the streaming query.

    The journal has the same columns without ``last``, and ``flush``, the number of the batch of its message, and ``reason``: ``size``
    (``size`` events were there), ``time`` (the oldest had waited for ``milliseconds``) or ``close`` (one was marked last). An event whose
    (message_id, sequence_no) is there is rejected. Which are there is known from state, which a new query fills once from the
    journal; no batch reads it. Each micro-batch writes a folder of its own, so one that is run again after a failure
    replaces what it wrote. ``checkpoint`` goes on with an earlier query, and what it held is written then.
    """
    spark = messages.sparkSession
    checkpoint = checkpoint or fresh_path(spark, "journal")
    columns = [c for c in messages.columns if c not in (KEY, "last")]
    columns.sort(key=lambda c: c != ORDER)
    waiting = T.StructType([messages.schema[c] for c in columns])
    schema = T.StructType([messages.schema[KEY], *waiting, T.StructField("flush", T.LongType()), T.StructField("reason", T.StringType())])
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/run=none/batch=0")
    run = quote(checkpoint.rstrip("/").rpartition("/")[2], safe="-")
    # what other queries wrote; what this one did before a failure is known from its own state
    there = spark.read.schema(schema).parquet(path).filter(F.col("run") != run).select(*schema.names).groupBy(KEY)
    out = messages.groupBy(KEY).transformWithStateInPandas(JournalBatches(columns, waiting, size, milliseconds), schema, "Append", "ProcessingTime", there)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={epoch}")

    with with_timers(spark):
        return out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=f"{milliseconds} milliseconds").foreachBatch(sink).start()


def read_journal(spark, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All that queries have written."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path).drop("run", "batch")


def finish(query, quiet_batches: int = 3) -> None:
    """Stop a query that has read all there is and written what waited: a few micro-batches without input went by."""
    done, quiet = -1, 0
    while query.isActive and quiet < quiet_batches:
        time.sleep(0.1)
        for p in query.recentProgress:
            if p["batchId"] > done:
                done, quiet = p["batchId"], 0 if p["numInputRows"] else quiet + 1
    error = query.exception()
    query.stop()
    if error:
        raise error
