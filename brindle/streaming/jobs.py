"""Structured Streaming: event windows, journals, capped streams; and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import approx_tokens
from brindle.sources.shared import fresh_path


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream of its files."""
    still = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(still.schema)
    if all(f.rstrip("/").endswith(f"/{name}") for f in still.inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def events_stream(spark: SparkSession, path: str, watermark: str = "10 minutes") -> DataFrame:
    """The events below ``path`` as a stream with an event-time watermark."""
    return table_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there, and give its result as a batch frame.

    State and sink live in the shared folder, so that a lost executor's work is done again elsewhere.
    """
    spark = stream.sparkSession
    base = fresh_path(spark, "stream")
    if mode == "complete":

        def sink(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start()
    else:
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def journal(messages: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """An ordered journal: an event that repeats (message_id, sequence_no) is rejected."""
    return messages.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["message_id", "sequence_no"])


def replay_after(rows: DataFrame, key: str, order: str, cursors: DataFrame) -> DataFrame:
    """Rows of each key after its cursor (all of them without one)."""
    joined = rows.join(cursors.select(key, F.col("last").alias("_last")), key, "left")
    return joined.filter(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")


def fold_journal(events: DataFrame) -> DataFrame:
    """message_id, answer (in order), sources (the last), calls (one per call id, first-seen order, last state), n.

    Events of one message are one answer's, so they meet in one group.
    """
    listed = F.array_sort(F.collect_list(F.struct("sequence_no", "kind", "payload", "call_id")))
    some = lambda k: F.filter(listed, lambda e: e["kind"] == k)
    ids = F.array_distinct(F.transform(some("tool"), lambda e: e["call_id"]))
    state = lambda i: F.element_at(F.filter(some("tool"), lambda e: e["call_id"] == i), -1)["payload"]
    return events.groupBy("message_id").agg(
        F.array_join(F.transform(some("answer"), lambda e: e["payload"]), "").alias("answer"), F.get(F.reverse(some("source")), F.lit(0))["payload"].alias("sources"),
        F.array_join(F.transform(ids, lambda i: F.concat_ws("=", i, state(i))), ";").alias("calls"), F.count("*").alias("n"),
    )


def stale(rows: DataFrame, key: str, now: str, idle_minutes: int) -> DataFrame:
    """Keys whose last sign of life is older than the idle time, and that have not ended."""
    last = rows.groupBy(key).agg(F.max(F.greatest("ts", F.coalesce("heartbeat", "ts"))).alias("last"), F.bool_or("ended").alias("ended"))
    return last.filter(~F.col("ended") & (F.col("last") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {idle_minutes} MINUTE"))).select(key)


def capped(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def rate_budget(rows: DataFrame, key: str, gap: str, seconds: int, budget: int) -> DataFrame:
    """Requests and whether each is allowed: a counter that starts again after ``seconds`` of silence, up to a budget."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.coalesce((at - F.lag(at).over(w) >= seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = rows.withColumn("_fresh", fresh).withColumn("_session", F.sum("_fresh").over(w))
    inner = Window.partitionBy(key, "_session").orderBy("ts", "event_id")
    return numbered.withColumn("used", F.row_number().over(inner)).withColumn("allowed", F.col("used") <= budget).drop("_fresh", "_session")


def usage_events(calls: DataFrame) -> DataFrame:
    """One row a call: request_id, prompt_tokens, generated_tokens, counted by the provider where it says so, else by the length of the texts."""
    return calls.select(
        "request_id", F.coalesce("provider_prompt_tokens", approx_tokens(F.col("prompt"))).cast("long").alias("prompt_tokens"),
        F.coalesce("provider_generated_tokens", approx_tokens(F.col("answer"))).cast("long").alias("generated_tokens"),
    )


def state_delta(before: str, after: str):
    """The entries of a map that an update changed or added."""
    return F.map_filter(F.col(after), lambda k, v: ~v.eqNullSafe(F.try_element_at(F.col(before), k)))
