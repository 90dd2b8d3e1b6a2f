"""Exact nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks of bounded size; each pair of blocks is a tile of its
own (a query set against all rows, in blocks). In a tile both sides are quantised to int8, with
one scale a vector. The int8 product tile gives every inner product up to an error that is bounded
from the norms of the quantisation residuals; pairs whose upper bound does not reach the query's
k-th largest lower bound are dropped, the rest is computed again in double precision, and a heap a
query keeps the tile's k best. A last heap merges the tiles of a query.

Defined cases: vectors whose vec_id is null, and those that are null, empty, zero, of another length than most or hold null or
non-finite components take no part, as query or candidate; ties go to the smaller vec_id; rows that
repeat a vec_id are candidates each, but never of a query with the same vec_id; a query with
fewer candidates than k gets them all; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.vectors import dot_in_order, matrix, modal_width, usable

#: Vectors of one block, about; where there are too few blocks for all cores, candidates come in smaller ones, down to so many.
BLOCK, LEAST_BLOCK = 32768, 4096
#: Queries of a tile that are worked on at once.
ROWS = 256

_OUT = "query_id long, vec_id long, score double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, the norm of what the codes stand for, the norm of what they miss."""
    peak = np.abs(x).max(axis=1, keepdims=True)
    scale = np.where(peak > 0, peak / 127.0, 1.0)
    codes = np.rint(x / scale).astype(np.int8)
    stands = codes * scale
    return codes, scale[:, 0], np.linalg.norm(stands, axis=1), np.linalg.norm(x - stands, axis=1)


def tile_best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best candidates of every query in one tile; ties to the smaller id."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    ccode, cscale, cnorm, cmiss = quantise(c)
    cfloat = ccode.astype(np.float32).T.copy()
    out = []
    for at in range(0, len(qid), ROWS):
        ids, part = qid[at : at + ROWS], q[at : at + ROWS]
        code, scale, norm, miss = quantise(part)
        # products of int8 codes are whole numbers below 2**24, exact in float32 up to a width of 1024
        exact = np.float32 if c.shape[1] <= 1024 else np.float64
        near = (code.astype(exact) @ cfloat.astype(exact, copy=False)).astype(np.float64) * scale[:, None] * cscale
        error = norm[:, None] * cmiss + miss[:, None] * (cnorm + cmiss)
        error += 1e-9 * (norm[:, None] + miss[:, None]) * (cnorm + cmiss)  # rounding of the bounds themselves
        own = ids[:, None] == cid
        low = np.where(own, -np.inf, near - error)
        high = np.where(own, -np.inf, near + error)
        if low.shape[1] > k:
            floor = -np.partition(-low, k - 1, axis=1)[:, k - 1 : k]
            rows, cols = np.nonzero((high >= floor) & ~own)
        else:
            rows, cols = np.nonzero(~own)
        scores = dot_in_order(part[rows], c[cols])
        starts = np.searchsorted(rows, np.arange(len(ids) + 1))
        for i, query in enumerate(ids):
            a, b = starts[i], starts[i + 1]
            best = heapq.nsmallest(k, zip((-scores[a:b]).tolist(), cid[cols[a:b]].tolist()))
            out += [(int(query), vec, -score) for score, vec in best]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of every query row with all other rows."""
    width = modal_width(vectors)
    rows = vectors.filter(usable(width) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("x"), is_query.alias("is_query"))
    queries = rows.filter("is_query")
    sizes = rows.agg(F.count("*").alias("all"), F.count_if("is_query").alias("queries")).first()
    n_c, n_q = max(1, -(-sizes["all"] // block)), max(1, -(-sizes["queries"] // block))
    n_c = max(n_c, min(vectors.sparkSession.sparkContext.defaultParallelism, sizes["all"] // LEAST_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "x"), F.lit(n)).cast("int")
    tiles = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "x", deal(n_q).alias("q_block"), tiles(n_c).alias("c_block"))
    right = rows.select(F.col("vec_id").alias("cand_id"), F.col("x").alias("cand"), deal(n_c).alias("c_block"), tiles(n_q).alias("q_block"))

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        found = []
        if q.num_rows and c.num_rows:
            found = tile_best(q["vec_id"].to_numpy(), matrix(q["x"], width), c["cand_id"].to_numpy(), matrix(c["cand"], width), k)
        ids, vec, score = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, vec, score in zip(*(batch[n].to_pylist() for n in ("query_id", "vec_id", "score"))):
                heap = heaps.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
        rows = [(query, rank, -vec, score) for query, heap in heaps.items() for rank, (score, vec) in enumerate(sorted(heap, reverse=True), 1)]
        columns = list(zip(*rows)) if rows else [()] * 4
        types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "rank", "vec_id", "score"])

    found = left.groupBy("q_block", "c_block").cogroup(right.groupBy("q_block", "c_block")).applyInArrow(tile, _OUT)
    # a group is some hundred queries: its heaps are all that a task holds, however many tiles there are
    some = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-sizes["queries"] // ROWS))))
    return found.groupBy(some.alias("some")).applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
