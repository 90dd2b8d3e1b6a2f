"""Retrieval over entity graphs, for many questions at once.

A run is a question in a source that has a graph. Its seeds are the nodes whose names lie nearest to the question; it sees a
bounded neighbourhood of them, on which personalised PageRank spreads the seeds' weight; the chunks whose nodes hold most of it, hubs
counting less, are its result. Neighbourhoods are found by joins over all runs together, and since they are
bounded (500 nodes, 2,000 edges: limits of the feature), each is ranked in one call, so a search has as many
shuffles for a million questions as for one. Sources without a graph are searched by vectors, under one budget.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import approx_tokens
from brindle.operators.graph import both_ways
from brindle.operators.retrieval import nearest, register
from brindle.operators.windows import newest, shared_budget
from brindle.sources.shared import cut

# Seeds of a run, steps from them, what a neighbourhood holds at most, PageRank's damping, rounds and tolerance a node.
SEEDS, HOPS, MAX_NODES, MAX_EDGES = 10, 1, 500, 2000
DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
#: Chunks that vector search brings of a source at least, from which the budget chooses.
OVER_FETCH = 20

RUN = ["query_id", "source_id"]


def neighbourhoods(edges: DataFrame, seeds: DataFrame, hops: int = HOPS, max_nodes: int = MAX_NODES) -> DataFrame:
    """query_id, source_id, node: all nodes within ``hops`` of a run's seeds, each step's in order of name, up to ``max_nodes``.

    No run can take more of a node's neighbours than the first ``max_nodes``, so these alone are joined: a hub's edges are
    cut before they meet the runs.
    """
    near = newest(both_ways(edges.select("src", "dst", "source_id")).distinct(), ["source_id", "src"], [F.asc("dst")], max_nodes)
    visited = frontier = cut(seeds.select(*RUN, "node").distinct(), "visited")
    for _ in range(hops):
        met = near.join(frontier.withColumnRenamed("node", "src"), ["source_id", "src"]).select(*RUN, F.col("dst").alias("node")).distinct().join(visited, [*RUN, "node"], "left_anti")
        room = visited.groupBy(*RUN).agg((F.lit(max_nodes) - F.count("*")).alias("room"))
        ranked = newest(met, RUN, [F.asc("node")], max_nodes, "_n").join(room, RUN)
        frontier = cut(ranked.filter(F.col("_n") <= F.col("room")).select(*RUN, "node"), "frontier")
        visited = visited.unionByName(frontier)
    return visited


def induced_edges(edges: DataFrame, visited: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """query_id, source_id, src, dst, weight: edges between two visited nodes of a run, the first ``max_edges`` by their ends.

    Every edge is looked up from that of its ends which has fewer edges. So no node brings more than about the square root
    of twice the number of edges, however many it has.
    """
    ends = edges.select("source_id", F.explode(F.array("src", "dst")).alias("node"))
    degree = ends.groupBy("source_id", "node").agg(F.count("*").alias("degree"))
    known = edges
    for end in ("src", "dst"):
        known = known.join(degree.select("source_id", F.col("node").alias(end), F.col("degree").alias(f"_{end}")), ["source_id", end])
    from_src = F.col("_src") <= F.col("_dst")
    known = known.select("source_id", "src", "dst", "weight", F.when(from_src, F.col("src")).otherwise(F.col("dst")).alias("node"), F.when(from_src, F.col("dst")).otherwise(F.col("src")).alias("_other"))
    met = known.join(visited, ["source_id", "node"]).drop("node").withColumnRenamed("_other", "node").join(visited, [*RUN, "node"], "left_semi")
    return newest(met.select(*RUN, "src", "dst", "weight"), RUN, [F.asc("src"), F.asc("dst"), F.asc("weight")], max_edges)


def pagerank(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Scores of nodes 0 to n - 1 on an undirected weighted graph, by power iteration from equal scores.

    Mass returns to the seeds in proportion to ``start`` (evenly, if that is all zero), as does that of nodes
    without edges. Ends when scores move by less than the tolerance a node. Parallel edges add up.
    """
    back = src != dst
    a, b, w = np.append(src, dst[back]), np.append(dst, src[back]), np.append(weight, weight[back])
    total = np.bincount(a, w, n)
    share = w / total[a]
    home = start / start.sum() if start.sum() > 0 else np.full(n, 1 / n)
    score = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        before = score
        score = DAMPING * (np.bincount(b, before[a] * share, n) + before[total == 0].sum() * home) + (1 - DAMPING) * home
        if np.abs(score - before).sum() < n * TOLERANCE:
            break
    return score


def ranked_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, source_id, node, mass. nodes have query_id, source_id, node, seed and doc_freq; edges as of ``induced_edges``.

    A node's mass is its PageRank over ln(2 + doc_freq): one that many chunks name counts less.
    """
    kinds = dict(nodes.dtypes)
    schema = f"query_id {kinds['query_id']}, source_id {kinds['source_id']}, node {kinds['node']}, mass double"

    def rank(own: pa.Table, links: pa.Table) -> pa.Table:
        own = own.sort_by("node")
        if own.num_rows:
            place = {v: i for i, v in enumerate(own["node"].to_pylist())}
            src, dst = (np.array([place[v] for v in links[c].to_pylist()], np.int64) for c in ("src", "dst"))
            score = pagerank(len(place), src, dst, links["weight"].to_numpy(), own["seed"].to_numpy()) / np.log(2 + own["doc_freq"].to_numpy())
        else:
            score = np.zeros(0)
        return own.select(["query_id", "source_id", "node"]).append_column("mass", pa.array(score))

    weight = F.col("weight").cast("double")
    links = edges.withColumn("weight", F.when(weight != 0, weight).otherwise(1.0))
    nodes, links = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (nodes, links))  # both may come from one frame
    return nodes.groupBy(*RUN).cogroup(links.groupBy(*RUN)).applyInArrow(rank, schema)


def _tokens(name: str, text: str) -> Column:
    return approx_tokens(F.concat(F.coalesce(F.col(name), F.lit("")), F.lit("\n"), F.col(text))).cast("long")


def _budget(tokens: int) -> int:
    return max(int(tokens * 0.9), 100)


def graph_chunks(graph: dict[str, DataFrame], questions: DataFrame, top_k: int, candidates: int, tokens: int) -> DataFrame:
    """query_id, source_id, chunk, score, rank: the chunks of each run, ``top_k`` at most, as long as they stay below the budget."""
    named = graph["nodes"].select(F.struct("source_id", "node").alias("vec_id"), "source_id", "embedding")
    near = nearest(_numbered(named), questions.select("query_id", "query"), SEEDS, within=["source_id"])
    ids = _numbered(named).select("vec_id", F.col("key.node").alias("node"))
    seeds = cut(near.join(ids, "vec_id").select(*RUN, "node", F.greatest("score", F.lit(0.0)).alias("seed")), "seeds")
    edges, links = graph["edges"], graph["links"].select("source_id", "node", "chunk").distinct()
    visited = cut(neighbourhoods(edges, seeds), "neighbourhoods")
    named_by = links.groupBy("source_id", "node").agg(F.count("*").alias("doc_freq"))
    nodes = visited.join(seeds, [*RUN, "node"], "left").join(named_by, ["source_id", "node"], "left").select(*RUN, "node", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.coalesce("doc_freq", F.lit(0)).alias("doc_freq"))
    mass = ranked_nodes(nodes, induced_edges(edges, visited))
    scored = mass.join(links, ["source_id", "node"]).groupBy(*RUN, "chunk").agg(F.round(F.sum("mass"), 12).alias("score"))
    best = newest(scored, RUN, [F.desc("score"), F.asc("chunk")], candidates, "_place")
    texts = graph["chunks"].filter("text <> ''").select("source_id", "chunk", _tokens("name", "text").alias("_tokens"))
    w = Window.partitionBy(*RUN).orderBy("_place")
    met = best.join(texts, ["source_id", "chunk"]).select("*", F.sum("_tokens").over(w).alias("_used"), F.row_number().over(w).alias("rank"))
    return met.filter((F.col("_used") < _budget(tokens)) & (F.col("rank") <= top_k)).select(*RUN, "chunk", "score", "rank")


def _numbered(named: DataFrame) -> DataFrame:
    """Nodes under a number of their own, as ids that vector search can sort: it follows source and name."""
    return named.withColumn("key", F.col("vec_id")).withColumn("vec_id", F.concat_ws("\u0000", F.col("key.source_id").cast("string"), F.col("key.node").cast("string")))


def vector_chunks(vectors: DataFrame, chunks: DataFrame, questions: DataFrame, sources: DataFrame, k: int, base: int, tokens: int) -> DataFrame:
    """query_id, source_id, chunk, score, rank: vector search of the sources in order of their place, under one budget."""
    n = max(sources.count(), 1)
    own = max(1, base // n)
    rows = vectors.join(sources, "source_id").select(F.col("chunk").alias("vec_id"), "source_id", "embedding")
    found = nearest(rows, questions.select("query_id", "query"), max(own, OVER_FETCH), within=["source_id"]).withColumnRenamed("vec_id", "chunk").withColumnRenamed("rank", "nth")
    texts = chunks.select("source_id", "chunk", _tokens("name", "text").alias("_tokens"))
    met = cut(found.join(texts, ["source_id", "chunk"]).join(sources, "source_id").select(*RUN, "chunk", "score", "place", "nth", "_tokens"), "hits")
    kept = shared_budget(met, "query_id", "place", "nth", "_tokens", own, _budget(tokens), max(k, n)).drop("used")
    w = Window.partitionBy("query_id").orderBy("place", "nth")
    return met.join(kept, ["query_id", "place", "nth"]).select(*RUN, "chunk", "score", F.row_number().over(w).alias("rank"))


def graph_search(graph: dict[str, DataFrame], questions: DataFrame, k: int, tokens: int = 50_000) -> DataFrame:
    """query_id, source_id, chunk, score, rank (from 1): what all sources yield for each question, in order of their place.

    ``graph`` has sources (source_id, place), nodes (source_id, node, embedding), edges (source_id, src, dst, weight), links
    (source_id, node, chunk), chunks (source_id, chunk, name, text) and vectors (source_id, chunk, embedding); questions have
    query_id and query, a vector. ``k`` is split over the sources, one chunk at least for each; every source with
    a graph has the budget for itself; the others share one, at the place of the first of them. Weights that are null or 0 count
    as 1; chunks without text are passed over; a source whose nodes are all without a vector yields nothing.
    """
    sources = graph["sources"].select("source_id", "place")
    with_graph = graph["nodes"].select("source_id").distinct()
    graphed, others = cut(sources.join(with_graph, "source_id", "left_semi"), "sources"), cut(sources.join(with_graph, "source_id", "left_anti"), "sources")
    own = {name: graph[name].join(graphed.select("source_id"), "source_id", "left_semi") for name in ("nodes", "edges", "links")}
    found = graph_chunks({**own, "chunks": graph["chunks"]}, questions, max(1, k // max(sources.count(), 1)), max(1, 2 * k, k + 5), tokens).join(graphed, "source_id")
    first = others.agg(F.min("place")).first()[0]
    if first is not None:
        found = found.unionByName(vector_chunks(graph["vectors"], graph["chunks"], questions, others, k, k, tokens).withColumn("place", F.lit(first).cast(dict(sources.dtypes)["place"])))
    w = Window.partitionBy("query_id").orderBy("place", "rank")
    return found.select(*RUN, "chunk", "score", F.row_number().over(w).alias("rank"))


def graphrag(corpus: dict[str, DataFrame], questions: DataFrame, k: int) -> DataFrame:
    """The strategy of this name: query_id, doc_id, score, rank; ``corpus`` as of ``graph_search``."""
    return graph_search(corpus, questions, k).select("query_id", F.col("chunk").alias("doc_id"), "score", "rank")


register("graphrag", graphrag)
