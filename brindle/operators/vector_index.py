"""An index of vectors that is built once and searched often: inverted lists on disk, and the exact way where they yield too few.

Lists are the cells of unit centroids, which spherical k-means finds in a bounded sample; every row is put into the list of its
nearest centroid. The index is a Parquet table with a folder for each list, so a search reads the folders that some
question needs and no others. Both sides of a list meet in blocks, so a list of a third of all rows is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators.retrieval import nearest
from brindle.sources.shared import cut

#: Rows that centroids are fitted on, lists at most, and rounds of k-means.
SAMPLE, MAX_LISTS, FIT_ROUNDS = 20_000, 4096, 12


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def fit_centroids(sample: np.ndarray, n_lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of rows of unit length; a list that runs empty begins anew at the row that fits worst."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), n_lists, replace=False)]
    for _ in range(FIT_ROUNDS):
        near = sample @ centroids.T
        owner = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        empty = np.flatnonzero(np.bincount(owner, minlength=n_lists) == 0)
        sums[empty] = sample[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        centroids = unit(sums)
    return centroids


def _lists_of(centroids: np.ndarray, column: str, n: int):
    """An Arrow function of vectors: their ``n`` nearest lists."""

    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if len(batch):
                score = unit(np.asarray(batch.flatten(), dtype=float).reshape(len(batch), -1)) @ centroids.T
                best = np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.ravel()))
            else:
                yield pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(near, "array<int>")(F.col(column).cast("array<double>"))


def build_index(rows: DataFrame, path: str, n_lists: int | None = None, sample: int = SAMPLE) -> int:
    """Write an index of rows (vec_id, embedding and columns to filter by) below ``path``; the number of lists.

    Centroids are fitted on ``sample`` rows, those whose ids hash smallest; all rows are indexed, but for vectors that are null,
    zero, not finite or of another length than most. Without a number of lists there are about as many as the square root of the rows.
    """
    spark = rows.sparkSession
    common = rows.filter(V.finite(F.col("embedding"))).groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        raise ValueError("there is no vector to index")
    good = rows.filter(V.finite(F.col("embedding"), common["width"]))
    picked = good.select(F.col("embedding").cast("array<double>").alias("e"), F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).toArrow()
    matrix = unit(np.asarray(picked["e"].combine_chunks().flatten(), dtype=float).reshape(picked.num_rows, -1))
    n_lists = min(n_lists or max(1, round(math.sqrt(common["count"]))), MAX_LISTS, len(matrix))
    centroids = fit_centroids(matrix, n_lists)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    good.withColumn("list", F.get(_lists_of(centroids, "embedding", 1), F.lit(0))).write.partitionBy("list").parquet(f"{path}/lists")
    return n_lists


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 8, where: Column | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: rows near to each query (query_id, query) by cosine, ``k`` where the index has so many.

    A query reads its ``probes`` nearest lists. If a filter leaves fewer than ``k`` rows there, the query is compared with all rows that pass
    it, exactly. Queries of another length than the index's vectors find nothing.
    """
    table = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()  # at most MAX_LISTS
    centroids = np.asarray(table["centroid"].combine_chunks().flatten(), dtype=float).reshape(table.num_rows, -1)
    rows = spark.read.parquet(f"{path}/lists")
    rows = rows if where is None else rows.filter(where)
    asked = queries.filter(V.finite(F.col("query"), centroids.shape[1])).select("query_id", "query")
    probed = cut(asked.withColumn("lists", _lists_of(centroids, "query", min(probes, len(centroids)))).select("query_id", "query", F.explode("lists").alias("list")), "probes")
    needed = sorted(r["list"] for r in probed.select("list").distinct().collect())
    found = cut(nearest(rows.filter(F.col("list").isin(needed)), probed, k, cell="list"), "near")
    full = found.filter(F.col("rank") == k).select("query_id")
    few = cut(asked.join(full, "query_id", "left_anti"), "few")
    if few.isEmpty():
        return found
    return found.join(full, "query_id", "left_semi").unionByName(nearest(rows, few, k))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits (query_id, vec_id) that were found."""
    both = exact.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return both / max(exact.count(), 1)
