"""Aggregates, windows and top-k over documents, orders and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import aggregates as A
from brindle.operators import windows as W
from brindle.plans.registry import query
from brindle.plans.tables import RECORDS_SQL, records
from brindle.sources.files import table

_DIMENSION_SQL = {
    "repository": "repository", "source_type": "source_type", "label": "unnest(labels)", "month": "strftime(coalesce(published, created), '%Y-%m')",
    "state": "coalesce(state, 'unknown')",
}
_METRIC_SQL = {"count": "count(*)", "median": "quantile_cont(comments, 0.5)", "sum": "coalesce(sum(comments), 0)"}

for _metric in A.METRICS:
    for _dimension in A.DIMENSIONS:
        query(
            f"agg_{_metric}_by_{_dimension}",
            f"WITH {RECORDS_SQL}, d AS (SELECT {_DIMENSION_SQL[_dimension]} AS dimension, comments FROM records) SELECT dimension, CAST({_METRIC_SQL[_metric]} AS DOUBLE) AS value FROM d GROUP BY dimension",
        )(lambda spark, sf, m=_metric, d=_dimension: A.aggregate(records(spark, sf), m, d))


@query("capped_groups", """
WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS dimension, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1)
SELECT dimension, value, (SELECT count(*) FROM g) AS total_groups, (SELECT count(*) FROM g) > 20 AS capped FROM g ORDER BY value DESC, dimension LIMIT 20""")
def capped_groups(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderdate").alias("created"), F.lit(None).cast("timestamp_ntz").alias("published"))
    return A.aggregate(rows, "count", "month", limit=20)


@query("agg_median", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def agg_median(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"))


@query("coverage", f"""WITH {RECORDS_SQL}
SELECT repository, list_sort(list(DISTINCT source_type) FILTER (source_type IS NOT NULL)) AS source_types, strftime(min(coalesce(published, created)), '%Y-%m-%d') AS date_from,
  strftime(max(coalesce(published, created)), '%Y-%m-%d') AS date_to, count(*) AS n, count(*) FILTER (published IS NULL) AS undated FROM records GROUP BY 1""")
def coverage(spark, sf):
    at = F.coalesce("published", "created")
    return records(spark, sf).groupBy("repository").agg(
        F.sort_array(F.collect_set("source_type")).alias("source_types"), F.date_format(F.min(at), "yyyy-MM-dd").alias("date_from"), F.date_format(F.max(at), "yyyy-MM-dd").alias("date_to"),
        F.count("*").alias("n"), F.count_if(F.col("published").isNull()).alias("undated"),
    )


@query("agg_filter_counts", """SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases,
  count(*) FILTER (value > 50) AS large FROM events GROUP BY 1""")
def agg_filter_counts(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("value") > 50).alias("large")
    )


@query("feedback_pivot", """SELECT event_type, CAST(sum(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS likes,
  CAST(sum(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS dislikes FROM events GROUP BY 1""")
def feedback_pivot(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long") % 2
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.when(k == 0, 1).otherwise(0)).alias("likes"), F.sum(F.when(k == 1, 1).otherwise(0)).alias("dislikes"))


@query("agg_array_distinct", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY 1")
def agg_array_distinct(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))


@query("agg_bool_or_strongest", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_linestatus = 'O') AS all_open FROM lineitem GROUP BY 1")
def agg_bool_or_strongest(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_linestatus") == "O").alias("all_open"))


@query("distinct_plus_nulls", """SELECT event_type, count(DISTINCT r) + count(*) FILTER (r IS NULL) AS requests
FROM (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id // 3 END AS r FROM events) GROUP BY 1""")
def distinct_plus_nulls(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 5 != 0, F.floor(F.col("event_id") / 3)).alias("r"))
    return e.groupBy("event_type").agg(A.distinct_plus_nulls("r").alias("requests"))


@query("usage_window_sum", """SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events
WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR AND ts < TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1""")
def usage_window_sum(spark, sf):
    return W.trailing(table(spark, sf, "events"), "ts", "2024-01-30 00:00:00", 24).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


for _unit, _format in (("minute", "%Y-%m-%d %H:%M:00"), ("hour", "%Y-%m-%d %H:00:00"), ("day", "%Y-%m-%d")):
    query(
        f"bucketed_totals_{_unit}",
        f"SELECT strftime(ts, '{_format}') AS bucket, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2",
    )(lambda spark, sf, u=_unit: A.bucketed_totals(table(spark, sf, "events"), u, "event_type", start="2024-01-05 00:00:00", end="2024-01-25 00:00:00"))


@query("bucket_zero_fill", """
WITH spine AS (SELECT strftime(unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 HOUR)), '%Y-%m-%d %H:00:00') AS bucket),
c AS (SELECT strftime(ts, '%Y-%m-%d %H:00:00') AS bucket, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (bucket)""")
def bucket_zero_fill(spark, sf):
    counts = A.bucketed_totals(table(spark, sf, "events").filter("event_type = 'purchase'"), "hour").select("bucket", "n")
    return A.zero_filled(counts, "hour", "2023-12-25 00:00:00", "2024-02-05 00:00:00")


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("series_pivot", "SELECT strftime(ts, '%Y-%m-%d') AS bucket, " + ", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 6) AS {t}_total" for t in _TYPES) + " FROM events GROUP BY 1")
def series_pivot(spark, sf):
    day = A.bucket_of(F.col("ts"), "day").alias("bucket")
    wide = table(spark, sf, "events").groupBy(day).pivot("event_type", list(_TYPES)).agg(F.round(F.sum("value"), 6))
    return wide.select("bucket", *(F.col(t).alias(f"{t}_total") for t in _TYPES))


@query("tool_outcomes", """SELECT event_type, count(*) AS calls, count(*) FILTER (value < 10) AS failures, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def tool_outcomes(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("value") < 10).alias("failures"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("top_users", "SELECT user_id, round(sum(value), 6) AS total FROM events GROUP BY 1 ORDER BY total DESC, user_id LIMIT 10")
def top_users(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("total")).orderBy(F.desc("total"), "user_id").limit(10)


@query("last_seen", """SELECT c_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS last_seen FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def last_seen(spark, sf):
    last = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    return table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.date_format("at", "yyyy-MM-dd").alias("last_seen"))


@query("overview_scalars", """SELECT count(*) AS records, count(DISTINCT repository) AS repositories, count(DISTINCT source_type) AS source_types, count(*) FILTER (state = 'open') AS open_records,
  CAST(sum(comments) AS BIGINT) AS comments, strftime(max(created), '%Y-%m-%d') AS newest FROM (WITH """ + RECORDS_SQL + " SELECT * FROM records)")
def overview_scalars(spark, sf):
    return records(spark, sf).agg(
        F.count("*").alias("records"), F.count_distinct("repository").alias("repositories"), F.count_distinct("source_type").alias("source_types"), F.count_if(F.col("state") == "open").alias("open_records"),
        F.sum("comments").alias("comments"), F.date_format(F.max("created"), "yyyy-MM-dd").alias("newest"),
    )


@query("guardrail_summary", """
WITH five AS (SELECT event_type, user_id % 3 AS stage, value > 50 AS blocked, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS check_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n
  FROM events GROUP BY ALL)
SELECT event_type, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (blocked), 0) AS BIGINT) AS blocked, CAST(coalesce(sum(n) FILTER (stage = 0), 0) AS BIGINT) AS input_stage, count(DISTINCT check_id) AS checks
FROM five GROUP BY 1""")
def guardrail_summary(spark, sf):
    e = table(spark, sf, "events")
    five = e.groupBy("event_type", (F.col("user_id") % 3).alias("stage"), (F.col("value") > 50).alias("blocked"), (F.get_json_object("props", "$.k").cast("long") % 4).alias("check_id"), A.bucket_of(F.col("ts"), "day").alias("day")).agg(F.count("*").alias("n"))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return five.groupBy("event_type").agg(F.sum("n").alias("total"), some(F.col("blocked")).alias("blocked"), some(F.col("stage") == 0).alias("input_stage"), F.count_distinct("check_id").alias("checks"))


@query("dedup_sum_bytes", """
WITH r AS (SELECT l_suppkey AS owner, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey END AS path, CAST(l_quantity AS BIGINT) AS size FROM lineitem)
SELECT owner, CAST(sum(size) AS BIGINT) AS total FROM (SELECT DISTINCT owner, path, size FROM r WHERE path IS NOT NULL UNION ALL SELECT owner, path, size FROM r WHERE path IS NULL) GROUP BY 1""")
def dedup_sum_bytes(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), F.when(F.col("l_linenumber") != 1, F.col("l_partkey")).alias("path"), F.col("l_quantity").cast("long").alias("size"))
    return A.dedup_sum(r, "path", "size", "owner")


@query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
def having(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 10")


@query("count_zero_fill_ids", "SELECT c_custkey AS o_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def count_zero_fill_ids(spark, sf):
    return A.count_for_ids(table(spark, sf, "orders"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("metric_means", "SELECT source, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, count(quality) AS scored FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def metric_means(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.count("quality").alias("scored"))


@query("quality_gates", """SELECT lang, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS score, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) >= 0.5 AS passed
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def quality_gates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    score = F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))
    return d.groupBy("lang").agg(F.round(score, 6).alias("score"), (score >= 0.5).alias("passed"))


@query("regression_check", """
WITH m AS (SELECT event_type, avg(value) FILTER (ts < TIMESTAMP '2024-01-15') AS baseline, avg(value) FILTER (ts >= TIMESTAMP '2024-01-15') AS candidate FROM events GROUP BY 1)
SELECT event_type, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, baseline - candidate > 0.02 AS regressed FROM m""")
def regression_check(spark, sf):
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    m = table(spark, sf, "events").groupBy("event_type").agg(F.avg(F.when(early, F.col("value"))).alias("b"), F.avg(F.when(~early, F.col("value"))).alias("c"))
    return m.select("event_type", F.round("b", 6).alias("baseline"), F.round("c", 6).alias("candidate"), (F.col("b") - F.col("c") > 0.02).alias("regressed"))


@query("source_model_tally", "SELECT coalesce(lang, 'legacy') AS model, count(*) AS n FROM documents GROUP BY 1")
def source_model_tally(spark, sf):
    return table(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("legacy")).alias("model")).agg(F.count("*").alias("n"))


@query("next_ordinal", "SELECT conv_id, coalesce(max(turn), -1) + 1 AS next FROM conversations GROUP BY 1")
def next_ordinal(spark, sf):
    return A.next_ordinal(table(spark, sf, "conversations"), "conv_id", "turn")


@query("guarded_cast_max", """
WITH r AS (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN 'v' || event_id ELSE CAST(event_id % 1000 AS VARCHAR) END AS raw FROM events)
SELECT user_id, max(CASE WHEN regexp_full_match(raw, '[0-9]+') THEN TRY_CAST(raw AS BIGINT) END) + 1 AS next FROM r GROUP BY 1""")
def guarded_cast_max(spark, sf):
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("v"), F.col("event_id").cast("string"))).otherwise((F.col("event_id") % 1000).cast("string"))
    return table(spark, sf, "events").select("user_id", raw.alias("raw")).groupBy("user_id").agg((A.guarded_max(F.col("raw")) + 1).alias("next"))


@query("dir_rollup", """
WITH f AS (SELECT string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/') AS p, CAST(length(html) AS BIGINT) AS size FROM pages),
x AS (SELECT array_to_string(p[1:i], '/') AS prefix, size FROM (SELECT p, size, unnest(range(0, len(p))) AS i FROM f))
SELECT prefix, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM x GROUP BY 1""")
def dir_rollup(spark, sf):
    files = table(spark, sf, "pages").select(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "").alias("path"), F.length("html").cast("long").alias("size"))
    return A.prefix_rollup(files)


@query("reassemble_pages", """SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY hint NULLS LAST, turn) AS page
FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN NULL ELSE -turn END AS hint FROM conversations) GROUP BY 1""")
def reassemble_pages(spark, sf):
    c = table(spark, sf, "conversations").withColumn("hint", F.when(F.col("turn") % 3 != 0, -F.col("turn"))).withColumn("text", F.coalesce("text", F.lit("")))
    return A.reassemble(c, "conv_id", "hint", "turn", "text")


@query("nested_token_count", "SELECT conv_id, CAST(sum(CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) + CAST(ceil(length(coalesce(role, '')) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def nested_token_count(spark, sf):
    from brindle.functions.text import approx_tokens

    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum((approx_tokens(F.col("text")) + approx_tokens(F.col("role"))).cast("long")).alias("tokens"))


# Windows and top-k.


@query("keep_recent_n", """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 20 AND ts >= TIMESTAMP '2024-01-10'""")
def keep_recent_n(spark, sf):
    return W.newest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id", "user_id")


@query("distinct_on_latest", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def distinct_on_latest(spark, sf):
    return W.latest(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


_SIGNAL_SQL = RECORDS_SQL + """,
scored AS (SELECT *, round(0.6::DOUBLE * greatest(comments, 0) / greatest(1, max(comments) OVER (PARTITION BY repository)) + 0.4::DOUBLE * greatest(reactions, 0) / greatest(1, max(reactions) OVER (PARTITION BY repository)), 9) AS signal FROM records)"""


@query("signal_score", f"WITH {_SIGNAL_SQL} SELECT id, signal FROM scored")
def signal_score(spark, sf):
    return W.signal(records(spark, sf).select("id", "repository", "comments", "reactions")).select("id", "signal")


@query("signal_top_n", f"""WITH {_SIGNAL_SQL} SELECT id, repository, signal, CAST(rn AS INTEGER) AS rn FROM (SELECT id, repository, signal, row_number() OVER (PARTITION BY repository ORDER BY signal DESC, published DESC NULLS LAST, id) AS rn FROM scored) WHERE rn <= 15""")
def signal_top_n(spark, sf):
    scored = W.signal(records(spark, sf).select("id", "repository", "comments", "reactions", "published"))
    return W.newest(scored, ["repository"], [F.desc("signal"), F.desc_nulls_last("published"), F.asc("id")], 15, "rn").select("id", "repository", "signal", "rn")


@query("token_budget_stop", """
WITH t AS (SELECT doc_id, source, CAST(ceil(coalesce(n_chars, 0) / 4.0) AS BIGINT) AS tokens FROM documents),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM t)
SELECT doc_id, source, CAST(used AS BIGINT) AS used FROM c WHERE used < 4000""")
def token_budget_stop(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.ceil(F.coalesce("n_chars", F.lit(0)) / F.lit(4)).alias("tokens"))
    return W.budget_prefix(d, ["source"], [F.asc("doc_id")], "tokens", 4000).select("doc_id", "source", "used")


@query("token_budget_skip", """
WITH RECURSIVE t AS (SELECT doc_id, source, CAST(ceil(coalesce(n_chars, 0) / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
walk AS (
  SELECT source, r, doc_id, CASE WHEN tokens < 4000 THEN tokens ELSE 0 END AS used, tokens < 4000 AS kept FROM t WHERE r = 1
  UNION ALL
  SELECT t.source, t.r, t.doc_id, CASE WHEN w.used + t.tokens < 4000 THEN w.used + t.tokens ELSE w.used END, w.used + t.tokens < 4000 FROM walk w JOIN t ON t.source = w.source AND t.r = w.r + 1)
SELECT doc_id, source, CAST(used AS BIGINT) AS used FROM walk WHERE kept""")
def token_budget_skip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.ceil(F.coalesce("n_chars", F.lit(0)) / F.lit(4)).cast("long").alias("tokens"))
    return W.budget_skip(d, "source", "doc_id", "tokens", 4000)


def _shared_walk(rows: str, k: int, budget: int, most: int) -> str:
    """SQL: a walk over t (key, place, ord, doc_id, tokens), a row at a time, with what is used and how many rows of the source are kept."""
    return f"""
WITH RECURSIVE {rows},
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place, ord, doc_id) AS r FROM t),
walk AS (
  SELECT key, r, place, doc_id, CASE WHEN tokens < {budget} THEN tokens ELSE 0 END AS used, CASE WHEN tokens < {budget} THEN 1 ELSE 0 END AS held, tokens < {budget} AS kept FROM n WHERE r = 1
  UNION ALL
  SELECT n.key, n.r, n.place, n.doc_id, w.used + CASE WHEN w.used + n.tokens < {budget} AND (n.place <> w.place OR w.held < {k}) THEN n.tokens ELSE 0 END,
    CASE WHEN n.place <> w.place THEN 0 ELSE w.held END + CASE WHEN w.used + n.tokens < {budget} AND (n.place <> w.place OR w.held < {k}) THEN 1 ELSE 0 END,
    w.used + n.tokens < {budget} AND (n.place <> w.place OR w.held < {k})
  FROM walk w JOIN n ON n.key = w.key AND n.r = w.r + 1),
kept AS (SELECT key, place, doc_id, used, row_number() OVER (PARTITION BY key ORDER BY r) AS i FROM walk WHERE kept)
SELECT key, place, doc_id, CAST(used AS BIGINT) AS used FROM kept WHERE i <= {most}"""


@query("budget_over_sources", _shared_walk("t AS (SELECT coalesce(lang, '') AS key, coalesce(source, '') AS place, doc_id AS ord, doc_id, CAST(ceil(coalesce(n_chars, 0) / 4.0) AS BIGINT) AS tokens FROM documents)", 3, 9000, 25))
def budget_over_sources(spark, sf):
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = table(spark, sf, "documents").select(text("lang").alias("key"), text("source").alias("place"), "doc_id", F.ceil(F.coalesce("n_chars", F.lit(0)) / F.lit(4)).cast("long").alias("tokens"))
    return W.shared_budget(d, "key", "place", "doc_id", "tokens", 3, 9000, most=25)


@query("history_budget", """
WITH t AS (SELECT conv_id, turn, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM conversations),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM t)
SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM c WHERE used < 200""")
def history_budget(spark, sf):
    from brindle.functions.text import approx_tokens

    c = table(spark, sf, "conversations").select("conv_id", "turn", approx_tokens(F.col("text")).cast("long").alias("tokens"))
    return W.budget_prefix(c, ["conv_id"], [F.desc("turn")], "tokens", 200).select("conv_id", "turn", "used")


@query("budget_split", """WITH g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT source, CAST(10007 // n + CASE WHEN i < 10007 % n THEN 1 ELSE 0 END AS BIGINT) AS budget FROM g""")
def budget_split(spark, sf):
    return W.split_budget(table(spark, sf, "documents").select("source").distinct(), "source", 10007)


@query("consecutive_distance", """
WITH s AS (SELECT vec_id, label, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS after FROM embeddings)
SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(after AS DOUBLE[])), 6) AS distance FROM s WHERE after IS NOT NULL""")
def consecutive_distance(spark, sf):
    from brindle.functions.vectors import cosine

    w = Window.partitionBy("label").orderBy("vec_id")
    s = table(spark, sf, "embeddings").withColumn("after", F.lead("embedding").over(w)).filter("after is not null")
    return s.select("vec_id", F.round(1 - cosine(F.col("embedding"), F.col("after")), 6).alias("distance"))


@query("smallest_gap", """WITH g AS (SELECT user_id, date_diff('second', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, min(gap) AS gap FROM g GROUP BY 1""")
def smallest_gap(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    e = table(spark, sf, "events").select("user_id", (second("ts") - F.lag(second("ts")).over(w)).alias("gap"))
    return e.groupBy("user_id").agg(F.min("gap").alias("gap"))


def cron_schedules(spark, sf):
    """event_id, expression, after: a schedule for each event, of its numbers."""
    e = F.col("event_id")
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    kinds = (
        text("*/", 1 + e % 45, " * * * *"), text(e % 60, " ", e % 24, " * * *"), text(e % 60, ",", (e * 7) % 60, " 9-17/", 1 + e % 3, " * * mon-fri"), text("0 ", e % 24, " ", 1 + e % 31, " * ", e % 8),
        text(e % 60, " 3 ", 1 + e % 28, " ", 1 + e % 12, " *"), text("0 0 29 feb ?"), text(e % 60, " * ", 1 + e % 31, " */", 1 + e % 5, " *"), text("60 * * * *"),
    )
    expression = kinds[-1]
    for i, k in enumerate(kinds[:-1]):
        expression = F.when(e % len(kinds) == i, k).otherwise(expression)
    return table(spark, sf, "events").select("event_id", expression.alias("expression"), F.col("ts").cast("timestamp_ntz").alias("after"))


@query("cron_gaps")
def cron_gaps(spark, sf):
    """The smallest gap between the next 64 ticks of each schedule, in seconds, and the first of them; null where a schedule can't be read."""
    from brindle.functions import cron

    due = cron_schedules(spark, sf).withColumn("schedule", cron.fields(F.col("expression"))).withColumn("due", cron.ticks(F.col("schedule"), F.col("after")))
    return due.select("event_id", cron.smallest_gap(F.col("due")).alias("gap"), F.date_format(cron.next_run(F.col("due")), "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query("effective_tokens", """
WITH t AS (SELECT conv_id, turn, role, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM conversations),
p AS (SELECT conv_id, max(turn) AS point FROM t WHERE role = 'assistant' AND tokens < 100 GROUP BY 1)
SELECT conv_id, coalesce(any_value(point), -1) AS point, CAST(coalesce(sum(tokens) FILTER (turn > coalesce(point, -1)), 0) AS BIGINT) AS tokens FROM t LEFT JOIN p USING (conv_id) GROUP BY 1""")
def effective_tokens(spark, sf):
    from brindle.functions.text import approx_tokens

    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", approx_tokens(F.col("text")).cast("long").alias("tokens"))
    return W.since_last_point(t, "conv_id", "turn", "tokens", (F.col("role") == "assistant") & (F.col("tokens") < 100))


@query("first_n_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 2")
def first_n_turns(spark, sf):
    return W.newest(table(spark, sf, "conversations"), ["conv_id"], [F.asc("turn")], 2).select("conv_id", "turn", "role")


@query("nth_in_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 3")
def nth_in_group(spark, sf):
    return W.nth(table(spark, sf, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("position_in_parent", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS INTEGER) AS position FROM lineitem")
def position_in_parent(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("position"))


@query("oldest_n_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def oldest_n_per_group(spark, sf):
    return W.newest(table(spark, sf, "orders"), ["o_custkey"], [F.asc_nulls_last("o_orderdate"), F.asc("o_orderkey")], 5).select("o_custkey", "o_orderkey")


@query("representative_topk", f"WITH {RECORDS_SQL} SELECT id, comments, reactions FROM records ORDER BY comments DESC, reactions DESC, published DESC NULLS LAST, id LIMIT 10")
def representative_topk(spark, sf):
    return records(spark, sf).orderBy(F.desc("comments"), F.desc("reactions"), F.desc_nulls_last("published"), "id").limit(10).select("id", "comments", "reactions")


@query("page_has_more", """WITH p AS (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 26 OFFSET 50)
SELECT event_id, (SELECT count(*) FROM p) > 25 AS has_more FROM (SELECT * FROM p ORDER BY ts DESC, event_id DESC LIMIT 25)""")
def page_has_more(spark, sf):
    return W.page(table(spark, sf, "events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 25, 50).select("event_id", "has_more")


@query("page_with_total", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def page_with_total(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'O'")
    page = o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(20).select("o_orderkey")
    return page.crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))
