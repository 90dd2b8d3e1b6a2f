"""Streaming jobs run to the end of what is there, and the batch forms of journal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.plans.registry import query
from brindle.sources.files import table
from brindle.sources.shared import fresh_path
from brindle.streaming import jobs as J
from brindle.streaming import release, timers, writer


def _window(df):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.select(stamp("w.start").alias("w_start"), stamp("w.end").alias("w_end"), *(c for c in df.columns if c != "w"))


@query("events_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS w_start, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS w_end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    return _window(J.drain(J.tumbling(J.events_stream(spark, f"{sf}/events.parquet"))))


@query("events_sliding", """WITH s AS (SELECT event_type, unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS w_start, strftime(s + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS w_end, event_type, count(*) AS n FROM s GROUP BY ALL""")
def events_sliding(spark, sf):
    return _window(J.drain(J.sliding(J.events_stream(spark, f"{sf}/events.parquet"))))


@query("events_session", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS w_start, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS w_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf):
    return _window(J.drain(J.sessions(J.events_stream(spark, f"{sf}/events.parquet"))))


_CHUNKS_SQL = "WITH c AS (SELECT conv_id AS message_id, turn AS sequence_no, CASE turn % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'answer' WHEN 2 THEN 'source' ELSE 'tool' END AS kind, coalesce(text, '') AS payload, 'call' || (turn % 2) AS call_id FROM conversations)"


def _chunks(spark, sf):
    kind = F.when(F.col("turn") % 4 < 2, "answer").when(F.col("turn") % 4 == 2, "source").otherwise("tool")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("message_id"), F.col("turn").alias("sequence_no"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("payload"), F.concat(F.lit("call"), (F.col("turn") % 2).cast("string")).alias("call_id")
    )


@query("journal_fold", f"""{_CHUNKS_SQL}, t AS (SELECT message_id, call_id, min(sequence_no) AS first, arg_max(payload, sequence_no) AS payload FROM c WHERE kind = 'tool' GROUP BY 1, 2)
SELECT message_id, coalesce(string_agg(payload, '' ORDER BY sequence_no) FILTER (kind = 'answer'), '') AS answer, arg_max(payload, sequence_no) FILTER (kind = 'source') AS sources,
  coalesce((SELECT string_agg(call_id || '=' || payload, ';' ORDER BY first) FROM t WHERE t.message_id = c.message_id), '') AS calls, count(*) AS n FROM c GROUP BY message_id""")
def journal_fold(spark, sf):
    return J.fold_journal(_chunks(spark, sf))


@query("replay_after", "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0 OR turn > 1")
def replay_after(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    cursors = c.filter("conv_id % 3 = 0").select("conv_id", F.lit(1).alias("last")).distinct()
    return J.replay_after(c, "conv_id", "turn", cursors)


@query("capped_stream", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 25")
def capped_stream(spark, sf):
    return J.capped(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 25).drop("ts")


_RATE_SQL = """
WITH g AS (SELECT event_id, user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT event_id, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) <= 3 AS allowed FROM s"""


@query("session_rate_budget", _RATE_SQL)
def session_rate_budget(spark, sf):
    return J.rate_budget(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 6 * 3600, 3).select("event_id", "allowed")


@query("stale_streams", """SELECT user_id FROM events GROUP BY 1 HAVING NOT bool_or(event_type = 'signup' AND value > 95) AND max(greatest(ts, ts + INTERVAL 5 MINUTE)) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 600 MINUTE""")
def stale_streams(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", (F.col("ts") + F.expr("INTERVAL 5 MINUTE")).alias("heartbeat"), ((F.col("event_type") == "signup") & (F.col("value") > 95)).alias("ended"))
    return J.stale(e, "user_id", "2024-01-30 12:00:00", 600)


def _until_a_day_later(spark, sf):
    """The events as a stream, and behind them a row of nobody that carries the watermark past them."""
    path = f"{sf}/events.parquet"
    end = spark.read.parquet(path).agg(F.max(F.col("ts").cast("timestamp")).alias("end"))
    rows = J.table_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).crossJoin(F.broadcast(end))  # one row
    later = F.struct(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), (F.col("end") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("").alias("event_type"), F.lit(0.0).alias("value"))
    own = F.struct("user_id", "event_id", "ts", "event_type", "value")
    return rows.select(F.inline(F.when(F.col("ts") == F.col("end"), F.array(own, later)).otherwise(F.array(own)))).withWatermark("ts", "10 minutes")


@query("session_rate_budget_stream", _RATE_SQL)
def session_rate_budget_stream(spark, sf):
    """The same from a stream, whose state re-arms by timers."""
    return timers.drain_timers(timers.rate_budget_stream(_until_a_day_later(spark, sf), "user_id", 6 * 3600, 3)).select("event_id", "allowed")


@query("stale_streams_timed", """SELECT user_id, epoch_us(max(ts) + INTERVAL 5 MINUTE) AS last FROM events GROUP BY 1 HAVING NOT bool_or(event_type = 'signup' AND value > 95) AND max(ts) + INTERVAL 605 MINUTE < (SELECT max(ts) FROM events) + INTERVAL 1430 MINUTE""")
def stale_streams_timed(spark, sf):
    """Users that have been silent for ten hours when the stream is a day past its last event, as timers find them."""
    e = _until_a_day_later(spark, sf).withColumn("heartbeat", F.col("ts") + F.expr("INTERVAL 5 MINUTE")).withColumn("ended", (F.col("event_type") == "signup") & (F.col("value") > 95))
    return timers.drain_timers(timers.stale_stream(e, "user_id", 600)).filter("user_id >= 0")


@query("stale_sweep", """SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate >= TIMESTAMP '1998-06-01')""")
def stale_sweep(spark, sf):
    o = table(spark, sf, "orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    alive = table(spark, sf, "lineitem").filter(F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(alive, "o_orderkey", "left_anti").select("o_orderkey")


@query("state_delta", """WITH v AS (SELECT user_id, event_id, event_type AS t, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS q FROM events), m AS (SELECT *, lag(t) OVER w AS bt, lag(q) OVER w AS bq FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, concat_ws(';', CASE WHEN bt IS NULL OR bt <> t THEN 'type=' || t END, CASE WHEN bq IS NULL OR bq <> q THEN 'value=' || q END) AS delta FROM m""")
def state_delta(spark, sf):
    from pyspark.sql import Window

    after = F.create_map(F.lit("type"), "event_type", F.lit("value"), F.floor(F.col("value") / 10).cast("string"))
    rows = table(spark, sf, "events").select("user_id", "event_id", after.alias("after"))
    rows = rows.withColumn("before", F.coalesce(F.lag("after").over(Window.partitionBy("user_id").orderBy("event_id")), F.create_map().cast("map<string,string>")))
    entries = F.transform(F.map_entries(J.state_delta("before", "after")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("event_id", F.array_join(entries, ";").alias("delta"))


@query("workflow_runs", """
WITH RECURSIVE w AS (
  SELECT o_orderkey AS run, 'start' AS node, 0 AS step, o_orderkey % 97 + 1 AS n, 0::BIGINT AS halved, 0::BIGINT AS top FROM orders
  UNION ALL
  SELECT run, CASE node WHEN 'start' THEN 'mark' WHEN 'mark' THEN 'check' WHEN 'check' THEN CASE WHEN n = 1 THEN 'end' WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END ELSE 'mark' END, step + 1,
    CASE node WHEN 'even' THEN n // 2 WHEN 'odd' THEN 3 * n + 1 ELSE n END, halved + CASE WHEN node = 'even' THEN 1 ELSE 0 END, CASE WHEN node = 'mark' THEN greatest(top, n) ELSE top END
  FROM w WHERE node <> 'end' AND step < 49)
SELECT run, CASE WHEN node = 'end' THEN 'completed' ELSE 'max_steps' END AS status, step + 1 AS steps, CASE node WHEN 'even' THEN n // 2 WHEN 'odd' THEN 3 * n + 1 ELSE n END AS n, halved + CASE WHEN node = 'even' THEN 1 ELSE 0 END AS halved, CASE WHEN node = 'mark' THEN greatest(top, n) ELSE top END AS top
FROM w WHERE node = 'end' OR step = 49""")
def workflow_runs(spark, sf):
    """A run for each order: halve what is even, else three times it and one more, until it is 1 or the steps are used up."""
    from brindle.operators.workflow import Node, Workflow, run_workflow

    nodes = {
        "start": Node("start"), "mark": Node("state", (("top", "greatest(top, n)"),)), "check": Node("condition", cases=(("one", "n = 1"), ("even", "n % 2 = 0"))),
        "even": Node("state", (("n", "n div 2"), ("halved", "halved + 1"))), "odd": Node("state", (("n", "3 * n + 1"),)), "end": Node("end"),
    }
    edges = (("start", "mark", None), ("mark", "check", None), ("check", "end", "one"), ("check", "even", "even"), ("check", "odd", "else"), ("even", "mark", None), ("odd", "mark", None))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 97 + 1).alias("n"), F.lit(0).cast("long").alias("halved"), F.lit(0).cast("long").alias("top"))
    return run_workflow(Workflow(nodes, edges), runs, "run")[0]


@query("journal_append", "SELECT user_id AS message_id, CAST(event_id AS BIGINT) AS sequence_no FROM events")
def journal_append(spark, sf):
    """Every event appended twice to an ordered journal; the repeat is rejected."""
    events = J.table_stream(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("message_id"), F.col("event_id").alias("sequence_no"), F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return J.drain(J.journal(events.drop("copy"), "60 days"), "append").select("message_id", "sequence_no")


@query("journal_writer", """WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT DISTINCT conv_id, turn, any_value(text) AS text FROM conversations GROUP BY 1, 2))
SELECT conv_id AS message_id, turn AS sequence_no, text, CAST((i - 1) // 4 + 1 AS BIGINT) AS flush, CASE WHEN i <= n - n % 4 THEN 'size' ELSE 'close' END AS reason FROM t""")
def journal_writer(spark, sf):
    """Every turn written to a journal, four at a time, by two queries one after the other; the second finds all of it there."""
    path = f"{sf}/conversations.parquet"
    ends = spark.read.parquet(path).groupBy("conv_id").agg(F.max("turn").alias("end"))
    turns = J.table_stream(spark, path).join(ends, "conv_id").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("sequence_no"), "text", (F.col("turn") == F.col("end")).alias("last"))
    to = fresh_path(spark, "turns")
    for _ in range(2):
        writer.finish(writer.write_journal(turns, to, size=4))
    return writer.read_journal(spark, to)


@query("usage_events", "SELECT conv_id, turn, CAST(CASE WHEN turn % 3 = 0 THEN 7 ELSE ceil(length(coalesce(text, '')) / 4.0) END AS BIGINT) AS prompt_tokens, CAST(ceil(length(role) / 4.0) AS BIGINT) AS generated_tokens FROM conversations")
def usage_events(spark, sf):
    calls = table(spark, sf, "conversations").select(
        F.struct("conv_id", "turn").alias("request_id"), F.when(F.col("turn") % 3 == 0, 7).alias("provider_prompt_tokens"), F.lit(None).cast("long").alias("provider_generated_tokens"), F.col("text").alias("prompt"), F.col("role").alias("answer")
    )
    return J.usage_events(calls).select("request_id.conv_id", "request_id.turn", "prompt_tokens", "generated_tokens")


@query("sentence_segments")
def sentence_segments(spark, sf):
    """Every conversation, a turn a chunk, in segments of whole sentences."""
    path = f"{sf}/conversations.parquet"
    ends = spark.read.parquet(path).groupBy("conv_id").agg(F.max("turn").alias("end"))
    chunks = J.table_stream(spark, path).join(ends, "conv_id")
    return J.drain(release.segment_stream(chunks.select(F.col("conv_id").alias("message_id"), F.col("turn").alias("sequence_no"), "text", (F.col("turn") == F.col("end")).alias("last"))), "append")


@query("stream_redact_equiv")
def stream_redact_equiv(spark, sf):
    """Redacted text of every conversation, made chunk by chunk in a stream."""
    path = f"{sf}/conversations.parquet"
    ends = spark.read.parquet(path).groupBy("conv_id").agg(F.max("turn").alias("end"))
    chunks = J.table_stream(spark, path).join(ends, "conv_id")
    chunks = chunks.select(F.col("conv_id").alias("message_id"), F.col("turn").alias("sequence_no"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"), (F.col("turn") == F.col("end")).alias("last"))
    return J.drain(release.redact_stream(chunks), "append")
