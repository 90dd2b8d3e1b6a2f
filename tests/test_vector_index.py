"""The vector index against exact search: recall, filters that leave few rows, hot lists, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import retrieval, vector_index
from brindle.plans.registry import QUERIES
from brindle.plans.retrieval import _queries, _vectors

SF = "/root/testdata/sf0.01"


def test_recall_on_the_tables(spark):
    got = QUERIES["index_search"](spark, SF)
    exact = retrieval.nearest(_vectors(spark, SF), _queries(spark, SF), 10)
    assert vector_index.recall(got.filter("kind = 'all'"), exact) >= 0.9
    few = retrieval.nearest(_vectors(spark, SF).filter("vec_id % 25 = 3"), _queries(spark, SF), 10)
    hits = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())
    found = got.filter("kind = 'few'")
    assert found.groupBy("query_id").count().filter("count <> 10").count() == 0
    assert vector_index.recall(found, few) >= 0.9 and hits(found.filter("rank = 1 and score > 0.999")) == hits(few.filter("rank = 1 and score > 0.999"))


def made(spark, n=1500):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    rows = [(i, (centers[i % 12] + 0.4 * rng.normal(size=16)).tolist(), i % 50) for i in range(n)] + [(n + i, centers[0].tolist(), 7) for i in range(700)]  # a hot list of copies
    rows += [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0, 2.0], 1), (9004, [float("nan")] * 16, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3), centers


def test_lists_filters_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 300)
    rows, centers = made(spark)
    path = f"file://{tmp_path}/index"
    n = vector_index.build_index(rows, path)
    lists = spark.read.parquet(f"{path}/lists")
    assert n == 47 and lists.count() == 2200 and lists.filter("vec_id > 9000").isEmpty()
    asked = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)] + [(50, [1.0, 2.0]), (51, None), (52, [0.0] * 16)], "query_id long, query array<double>")
    exact = retrieval.nearest(rows.filter("vec_id < 9000"), asked, 10)
    got = vector_index.search_index(spark, path, asked, 10, probes=6)
    assert vector_index.recall(got, exact) >= 0.9 and sorted(r[0] for r in got.select("query_id").distinct().collect()) == list(range(12))
    first = [r["vec_id"] for r in got.filter("query_id = 0").orderBy("rank").collect()]
    assert first == list(range(1500, 1510))  # of equal rows, those of the smallest ids
    # a filter that leaves 30 rows, of which one list holds fewer than ten
    some = vector_index.search_index(spark, path, asked, 10, probes=1, where=F.col("label") == 11)
    assert {r["count"] for r in some.groupBy("query_id").count().collect()} == {10}
    short = vector_index.search_index(spark, path, asked, 40, probes=1, where=F.col("label") == 11)
    want = retrieval.nearest(rows.filter("label = 11 and vec_id < 9000"), asked, 40)
    order = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())
    assert order(short) == order(want) and want.filter("query_id = 3").count() == 30


def test_only_the_lists_that_are_asked_for_are_read(spark, tmp_path):
    rows, centers = made(spark, 600)
    path = f"file://{tmp_path}/index"
    vector_index.build_index(rows, path, n_lists=12)
    plan = spark.read.parquet(f"{path}/lists").filter(F.col("list").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan or "PartitionFilters: [(list" in plan
    with pytest.raises(ValueError):
        vector_index.build_index(rows.filter("vec_id > 9000 and embedding is null"), f"{path}-none")
