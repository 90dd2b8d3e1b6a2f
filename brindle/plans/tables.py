"""The driver's tables, and the views on them that queries share (with the same views in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.files import table

#: What documents look like as tracked records: state, labels, counters and dates follow from id and length.
RECORDS_SQL = """records AS (
  SELECT doc_id AS id, source AS repository, lang AS source_type, text AS body, n_chars % 17 AS comments, n_chars % 5 AS reactions,
    CASE n_chars % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' END AS state,
    CASE WHEN doc_id % 7 = 0 THEN [] ELSE ['kind' || (doc_id % 3), lang] END AS labels,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) END AS published,
    DATE '2024-01-01' + CAST(doc_id % 200 AS INTEGER) AS created
  FROM documents)"""

#: Part-supplier co-occurrence as an undirected graph: nodes p<key> and s<key>.
EDGES_SQL = """edges AS (
  SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    day = lambda m: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % m).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("repository"), F.col("lang").alias("source_type"), F.col("text").alias("body"),
        (F.col("n_chars") % 17).alias("comments"), (F.col("n_chars") % 5).alias("reactions"),
        F.when(F.col("n_chars") % 3 == 0, "open").when(F.col("n_chars") % 3 == 1, "closed").alias("state"),
        F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("kind"), (F.col("doc_id") % 3).cast("string")), "lang")).alias("labels"),
        F.when(F.col("doc_id") % 3 != 0, day(365)).alias("published"), day(200).alias("created"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return line.select("l_partkey", "l_suppkey").distinct().select(node("p", "l_partkey").alias("src"), node("s", "l_suppkey").alias("dst"))
