"""Vector search, keyword search, rank fusion and its evaluation.

Queries are compared with all rows in blocks of both; only the best rows of a tile reach the next stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.functions.text import words
from brindle.sources.shared import cut

#: Queries and rows of a tile, the scores of it that a task holds at a time, and the hits that it returns.
QUERY_BLOCK, ROW_BLOCK, SCORES, HITS = 4096, 16384, 1 << 20, 1 << 20
#: Short points that are looked for in every text at a time.
POINT_BLOCK = 1024
#: Search terms whose set travels with the plan; more are joined.
MAX_TERMS = 20_000


def nearest(rows: DataFrame, queries: DataFrame, k: int, measure: str = "cosine", within: list[str] | None = None, cell: str | None = None) -> DataFrame:
    """query_id, vec_id, score, rank (from 1): the k best rows of every query, exactly; per ``within`` group if given.

    ``rows`` has vec_id and embedding, ``queries`` query_id and query. measure is cosine (larger is
    nearer) or l2 (squared, smaller is nearer), rounded to 6 places; ties go to the smaller vec_id. Both sides are dealt into blocks;
    a pair of blocks is a tile that returns its k best, ``SCORES`` scores at a time; with many groups it has fewer queries, so that
    they find about ``HITS`` rows at most. A query is compared with the rows of its own length, so tiles are
    of one length; vectors with null or non-finite components take no part, nor do zero vectors by cosine. With ``cell``, an int column of
    both frames, a query (a row for each of its cells) meets only the rows of its cells.
    """
    within, cells = within or [], [cell] if cell else []
    fine = lambda c: V.finite(F.col(c)) if measure == "cosine" else V.finite(F.col(c)) | (F.size(c) > 0) & F.forall(c, lambda v: v == 0)
    own = lambda df, c: F.col(c) if dict(df.dtypes)[c] == "array<float>" else F.col(c).cast("array<double>").alias(c)
    left = queries.filter(F.coalesce(fine("query"), F.lit(False))).select("query_id", *cells, own(queries, "query"), F.size("query").alias("width"))
    widths = left.groupBy("width").agg(F.count("*").alias("n"))  # a row for each length
    right = rows.filter(F.coalesce(fine("embedding"), F.lit(False))).select("vec_id", *within, *cells, own(rows, "embedding"), F.size("embedding").alias("width")).join(F.broadcast(widths.select("width")), "width", "left_semi")
    sizes = lambda df, *by: df.groupBy(*cells, *by).agg(F.count("*").alias("_n")).groupBy(*cells).agg(F.sum("_n").alias("_n"), F.count("*").alias("_groups"))
    most = lambda df, *by: [n or 0 for n in sizes(df, *by).agg(F.max("_n"), F.max("_groups")).first()]  # noqa: E731  rows of the largest cell, or all, and groups
    (asked, _), (there, groups) = most(left), most(right, *within)
    hits = min(k * groups, ROW_BLOCK)  # of a query in a tile
    n_q, n_r = max(1, -(-asked // QUERY_BLOCK), -(-asked * hits // HITS)), max(1, -(-there // ROW_BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select("*", deal("query_id", n_q).alias("q"), every(n_r).alias("r"))
    right = right.select("*", deal("vec_id", n_r).alias("r"), every(n_q).alias("q"))
    parted = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in within)
    ids = {"query_id": dict(queries.dtypes)["query_id"], "vec_id": dict(rows.dtypes)["vec_id"]}
    schema = f"query_id {ids['query_id']}, vec_id {ids['vec_id']}, {parted + ', ' if within else ''}score double"

    def tile(q: pa.Table, r: pa.Table) -> pa.Table:
        if not (q.num_rows and r.num_rows):
            return pa.table({f.name: pa.array([], f.type) for f in [q.schema.field("query_id"), r.schema.field("vec_id"), *(r.schema.field(c) for c in within), pa.field("score", pa.float64())]})
        a, b = (np.asarray(t[c].combine_chunks().flatten(), dtype=float).reshape(t.num_rows, -1) for t, c in ((q, "query"), (r, "embedding")))
        if measure == "cosine":
            a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        squares = (b * b).sum(axis=1)
        vec = r["vec_id"].to_numpy()
        parts = {}
        for i, g in enumerate(zip(*(r[c].to_pylist() for c in within)) if within else [()] * len(vec)):
            parts.setdefault(g, []).append(i)
        parts = [np.array(members) for members in parts.values()]
        step, steps = max(1, SCORES // len(b)), []
        for begin in range(0, len(a), step):
            some = a[begin : begin + step]
            far = -(some @ b.T) if measure == "cosine" else (some * some).sum(axis=1)[:, None] - 2 * some @ b.T + squares
            np.round(far, 6, out=far)
            every = []
            for members in parts:
                own = far[:, members] if len(parts) > 1 else far
                limit = np.partition(own, k - 1, axis=1)[:, k - 1] if len(members) > k else np.full(len(own), np.inf)
                for i, (row, most) in enumerate(zip(own, limit)):
                    near = np.flatnonzero(row <= most)
                    near = near[np.lexsort((vec[members[near]], row[near]))[:k]]
                    every.append((np.full(len(near), begin + i), members[near], row[near]))
            steps.append([np.concatenate(x) for x in zip(*every)])
        at_q, at_r, value = (np.concatenate(x) for x in zip(*steps))
        found = r.select(["vec_id", *within]).take(pa.array(at_r, pa.int64()))
        return found.add_column(0, "query_id", q["query_id"].take(pa.array(at_q, pa.int64()))).append_column("score", pa.array(-value if measure == "cosine" else value))

    scored = left.groupBy("width", *cells, "q", "r").cogroup(right.groupBy("width", *cells, "q", "r")).applyInArrow(tile, schema)
    order = F.desc("score") if measure == "cosine" else F.asc("score")
    w = Window.partitionBy("query_id", *within).orderBy(order, "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def above(hits: DataFrame, threshold: float) -> DataFrame:
    """Drops hits below a similarity, after the k best are chosen: fewer than k may stay."""
    return hits.filter(F.col("score") >= threshold)


def fuse(lists: list[DataFrame], key: list[str], constant: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked frames (key columns and a rank from 0): key, score; ties by first list, rank, key."""
    parts = [hits.select(*key, F.lit(i).alias("_list"), F.col("rank").alias("_rank")) for i, hits in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy(*key).agg(F.round(F.sum(1.0 / (constant + F.col("_rank"))), 9).alias("score"), F.min(F.struct("_list", "_rank")).alias("_first"))
    if limit is not None:
        fused = fused.orderBy(F.desc("score"), "_first", *key).limit(limit)
    return fused.drop("_first")


def best_hit(hits: DataFrame, record: str, n: int) -> DataFrame:
    """The best hit per record (highest score, then lowest rank), then the ``n`` best records."""
    top = hits.groupBy(record).agg(F.min(F.struct((-F.col("score")).alias("negative"), "rank")).alias("_t"))
    return top.select(record, (-F.col("_t.negative")).alias("score"), F.col("_t.rank").alias("rank")).orderBy(F.desc("score"), record).limit(n)


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank: keyword search by BM25 over lower-case words.

    Each text is cut into words once; of those only the queries' terms go on, with the number of all, so that postings alone
    are shuffled. Terms are a set in the plan up to ``MAX_TERMS`` of them, and a join beyond.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))
    wanted = terms.select("term").distinct()
    tokens = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("ws"))
    listed = [r["term"] for r in wanted.limit(MAX_TERMS + 1).collect()]
    if len(listed) <= MAX_TERMS:
        tokens = cut(tokens.select("doc_id", F.size("ws").alias("size"), F.filter("ws", lambda w: w.isin(listed)).alias("ws")), "terms")
        every = tokens.select("doc_id", "size", F.explode("ws").alias("term"))
    else:
        tokens = tokens.select("doc_id", F.size("ws").alias("size"), "ws")
        every = tokens.select("doc_id", "size", F.explode("ws").alias("term")).join(wanted, "term", "left_semi")
    stats = tokens.agg(F.count("*").alias("n_docs"), F.avg("size").alias("mean")).first()
    postings = every.groupBy("term", "doc_id", "size").agg(F.count("*").alias("tf"))
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    scored = postings.join(frequency, "term").join(terms, "term")
    idf = F.log(1 + (F.lit(stats["n_docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.lit(stats["mean"] or 1.0)))
    total = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return total.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def points_found(docs: DataFrame, points: DataFrame, run: int = 3) -> DataFrame:
    """item_id, doc_id: texts that hold a point, case and white space aside. docs has doc_id and t, points item_id and point, both collapsed.

    A point's first and last word may lie within words of a text; those between can't, so a text that holds
    it shares its first inner run of ``run`` words. Points with fewer inner words are looked for in every text, a block of them at a time.
    """
    ws = F.split("point", " ")
    anchored = points.filter(F.size(ws) >= run + 2).select("item_id", "point", F.xxhash64(F.slice(ws, 2, run)).alias("h"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (run - 1), F.lit(1)))
    runs = docs.select("doc_id", F.split("t", " ").alias("ws")).filter(F.size("ws") >= run).select("doc_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("ws", i, F.lit(run)))))).alias("h"))
    pairs = runs.join(anchored.select("item_id", "h"), "h").select("item_id", "doc_id").distinct()
    found = pairs.join(docs, "doc_id").join(anchored.select("item_id", "point"), "item_id").filter(F.col("t").contains(F.col("point"))).select("item_id", "doc_id")
    short = points.filter(F.size(ws) < run + 2).select("item_id", "point")
    blocks = max(1, -(-short.count() // POINT_BLOCK))
    for block in range(blocks):
        few = short.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        found = found.unionByName(docs.join(F.broadcast(few), F.col("t").contains(F.col("point"))).select("item_id", "doc_id"))
    return found


def seeds(nodes: DataFrame, question: DataFrame, k: int = 10) -> DataFrame:
    """node, weight: the k nodes nearest to a question's vector by cosine, those without a vector left out; weights below 0 count as 0."""
    named = nodes.filter("embedding is not null").select(F.col("node").alias("vec_id"), "embedding")
    near = nearest(named, question, k)
    return near.select(F.col("vec_id").alias("node"), F.greatest("score", F.lit(0.0)).alias("weight"))


def per_source(hits: DataFrame, k: int, over: int = 1) -> DataFrame:
    """Of ranked hits (source, rank) the first of every source: k split evenly over the sources, one at least, times ``over``."""
    n = hits.agg(F.count_distinct("source").alias("n")).first()["n"]
    return hits.filter(F.col("rank") <= max(1, k // max(n, 1)) * over)


def ceiling(hits: DataFrame, chunks: int, n_sources: int) -> DataFrame:
    """The first hits, at least one a source: max(chunks, n_sources) of them."""
    return hits.orderBy("rank").limit(max(chunks, n_sources))


def run_stages(hits: DataFrame, stages: list[Callable[[DataFrame, dict], DataFrame]], context: dict) -> DataFrame:
    """Post-retrieval stages, functions of (hits, context), one after the other."""
    return reduce(lambda found, stage: stage(found, context), stages, hits)


def lexical_score(query: Column, text: Column, title: Column | None = None) -> Column:
    """Share of the query's words found in the text, and a quarter of the share found in the title."""
    q = F.array_distinct(words(query))
    share = lambda c: F.size(F.array_intersect(q, words(c))) / F.greatest(F.size(q), F.lit(1))
    return share(text) if title is None else share(text) + F.lit(0.25) * share(title)


def recall_at(expected: Column, retrieved: Column, k: int) -> Column:
    """0.0 if nothing is expected."""
    hits = F.size(F.array_intersect(expected, F.slice(retrieved, 1, k)))
    n = F.size(F.array_distinct(expected))
    return F.when(n > 0, hits / n).otherwise(F.lit(0.0))


def ndcg_at(expected: Column, retrieved: Column, k: int) -> Column:
    """Binary gains; a repeated hit counts once, where it comes first."""
    top = F.array_distinct(F.slice(retrieved, 1, k))
    gain = F.aggregate(F.transform(top, lambda x, i: F.when(F.array_contains(expected, x), 1 / F.log2(i + 2)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    n = F.least(F.size(F.array_distinct(expected)), F.lit(k))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, gain / ideal).otherwise(F.lit(0.0))


def citation_precision(expected: Column, cited: Column) -> Column:
    n = F.size(F.array_distinct(cited))
    return F.when(n > 0, F.size(F.array_intersect(cited, expected)) / n).otherwise(F.lit(0.0))


def prescreen(hits: DataFrame, keep: Column, max_keep: int) -> DataFrame:
    """The first ``max_keep`` hits in order of rank that a predicate lets through; one that can't decide (null) keeps its hit."""
    return hits.filter(F.coalesce(keep, F.lit(True))).orderBy("rank").limit(max_keep)


def rerank(hits: DataFrame, score: Column | None, n: int) -> DataFrame:
    """The ``n`` first by a score, or in the given order without one."""
    return hits.orderBy(*([F.desc_nulls_last(score)] if score is not None else []), "rank").limit(n)


# Strategies: functions of (corpus, questions, k) to query_id, doc_id, score, rank. A corpus has vectors (doc_id, embedding) and
# texts (doc_id, text); questions have query_id, query (a vector) and text.


def classic(corpus: dict[str, DataFrame], questions: DataFrame, k: int) -> DataFrame:
    """The nearest vectors."""
    rows = corpus["vectors"].select(F.col("doc_id").alias("vec_id"), "embedding")
    return nearest(rows, questions.select("query_id", "query"), k).select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")


def keyword(corpus: dict[str, DataFrame], questions: DataFrame, k: int) -> DataFrame:
    """The best texts by their words."""
    return bm25(corpus["texts"], questions.select("query_id", F.col("text").alias("query")), k).select("query_id", "doc_id", "score", "rank")


def hybrid(corpus: dict[str, DataFrame], questions: DataFrame, k: int) -> DataFrame:
    """Both, by reciprocal rank fusion; ties go to the smaller doc_id."""
    lists = [hits.withColumn("rank", F.col("rank") - 1) for hits in (classic(corpus, questions, k), keyword(corpus, questions, k))]
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fuse(lists, ["query_id", "doc_id"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


RETRIEVERS: dict[str, Callable[[dict[str, DataFrame], DataFrame, int], DataFrame]] = {"classic": classic, "default": classic, "keyword": keyword, "hybrid": hybrid}


def register(name: str, retriever: Callable[[dict[str, DataFrame], DataFrame, int], DataFrame]) -> None:
    RETRIEVERS[name] = retriever


def retrieve(name: str, corpus: dict[str, DataFrame], questions: DataFrame, k: int) -> DataFrame:
    """Search by the named strategy; an unknown name is the classic one."""
    return RETRIEVERS.get(name, classic)(corpus, questions, k)
