"""Aggregation: the whitelisted metric-by-dimension engine, time buckets, distinct counts with nulls, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("count", "median", "sum")
DIMENSIONS = ("repository", "source_type", "label", "month", "state")
ORDERS = ("value_desc", "value_asc", "period_asc")

#: How a bucket's name is written, by unit.
BUCKETS = {"minute": "yyyy-MM-dd HH:mm:00", "hour": "yyyy-MM-dd HH:00:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}
STEPS = {"minute": "1 minute", "hour": "1 hour", "day": "1 day"}


def dimension_of(rows: DataFrame, dimension: str) -> DataFrame:
    """Adds ``dimension``; a row counts once for each of its labels, and not at all without any."""
    if dimension == "label":
        return rows.withColumn("dimension", F.explode("labels"))
    if dimension == "month":
        return rows.withColumn("dimension", F.date_format(F.date_trunc("month", F.coalesce("published", "created")), "yyyy-MM"))
    if dimension == "state":
        return rows.withColumn("dimension", F.coalesce("state", F.lit("unknown")))
    if dimension in DIMENSIONS:
        return rows.withColumn("dimension", F.col(dimension))
    raise ValueError(f"dimension must be one of {DIMENSIONS}")


def metric_of(metric: str, column: str = "comments") -> Column:
    if metric == "count":
        return F.count("*").cast("double")
    if metric == "median":
        return F.percentile(column, 0.5).cast("double")
    if metric == "sum":
        return F.coalesce(F.sum(column), F.lit(0)).cast("double")
    raise ValueError(f"metric must be one of {METRICS}")


def aggregate(rows: DataFrame, metric: str, dimension: str, order: str = "value_desc", limit: int | None = None) -> DataFrame:
    """dimension, value, total_groups (before the limit) and capped, ordered with the dimension as tie-break."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    grouped = dimension_of(rows, dimension).groupBy("dimension").agg(metric_of(metric).alias("value"))
    keys = {"value_desc": [F.desc("value"), F.asc("dimension")], "value_asc": [F.asc("value"), F.asc("dimension")], "period_asc": [F.asc("dimension")]}[order]
    if limit is None:
        return grouped
    # the groups are counted in a job-free scalar subquery of the same aggregate
    total = grouped.agg(F.count("*").alias("total_groups"))
    top = grouped.orderBy(*keys).limit(limit)
    return top.crossJoin(F.broadcast(total)).withColumn("capped", F.col("total_groups") > limit)


def bucket_of(ts: Column, unit: str) -> Column:
    if unit not in BUCKETS:
        raise ValueError(f"unit must be one of {tuple(BUCKETS)}")
    return F.date_format(ts, BUCKETS[unit])


def bucketed_totals(events: DataFrame, unit: str, *keys: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Count and sum of value per bucket (and keys), from ``start`` on and before ``end``."""
    if start:
        events = events.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        events = events.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return events.groupBy(bucket_of(F.col("ts"), unit).alias("bucket"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def zero_filled(counts: DataFrame, unit: str, start: str, end: str) -> DataFrame:
    """(bucket, n) on a spine without gaps from ``start`` to ``end``, both inclusive."""
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(f"INTERVAL {STEPS[unit]}"))).alias("ts"))
    spine = spine.select(bucket_of(F.col("ts"), unit).alias("bucket"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def distinct_plus_nulls(column: str) -> Column:
    """Distinct values, and one for each null."""
    return F.count_distinct(column) + F.count_if(F.col(column).isNull())


def dedup_sum(rows: DataFrame, key: str, amount: str, group: str) -> DataFrame:
    """Sum per group with each (key, amount) counted once; rows with a null key all count."""
    some = rows.filter(F.col(key).isNotNull()).select(group, key, amount).distinct()
    none = rows.filter(F.col(key).isNull()).select(group, key, amount)
    return some.unionByName(none).groupBy(group).agg(F.sum(amount).alias("total"))


def count_for_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows per id for every id asked for, 0 where there are none."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return ids.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def prefix_rollup(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Files and bytes below every folder, however deep; the root is the empty prefix."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.select(F.explode(prefixes).alias("prefix"), size).groupBy("prefix").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def reassemble(chunks: DataFrame, key: str, hint: str, index: str, text: str, joiner: str = "\n") -> DataFrame:
    """The chunks of each key in order of hint (nulls last), then index, joined. A key's chunks are one text."""
    order = F.array_sort(F.collect_list(F.struct(F.col(hint).isNull().alias("last"), F.col(hint).alias("hint"), F.col(index).alias("index"), F.col(text).alias("text"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(order, lambda c: c["text"]), joiner).alias("page"))


def next_ordinal(rows: DataFrame, key: str, ordinal: str, first: int = 0) -> DataFrame:
    return rows.groupBy(key).agg((F.coalesce(F.max(ordinal), F.lit(first - 1)) + 1).alias("next"))


def guarded_max(column: Column) -> Column:
    """The largest of those values that are whole numbers."""
    return F.max(F.when(column.rlike("^[0-9]+$"), column.try_cast("long")))
