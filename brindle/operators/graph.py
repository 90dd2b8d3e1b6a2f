"""Entity graphs: degrees, neighbourhoods, personalised PageRank, ranking by mass."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.shared import cut

#: Edges of a partition of a graph that an iteration reads again and again.
FLOW_ROWS = 100_000
#: Ranks that are sent to every edge; more are joined.
SENT_ROWS = 1_000_000


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree; a loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end; a loop once."""
    columns = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns)
    return edges.select("src", "dst", *columns).unionByName(back)


def one_hop(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Neighbours of the frontier's nodes: an equi join from either end."""
    return both_ways(edges.select("src", "dst")).join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, max_nodes: int = 500) -> DataFrame:
    """Nodes within ``hops`` (1 or 2) of the seeds, the first ``max_nodes`` by hop, then name (the limit is the feature)."""
    hops = min(max(hops, 1), 2)
    found = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        more = one_hop(edges, found.select("node")).withColumn("hop", F.lit(hop))
        found = found.unionByName(more).groupBy("node").agg(F.min("hop").alias("hop"))
    return found.orderBy("hop", "node").limit(max_nodes)


def induced(edges: DataFrame, nodes: DataFrame, max_edges: int = 2000) -> DataFrame:
    """The first ``max_edges`` edges, in order of their ends, both of which are among ``nodes`` (the limit is the feature)."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return edges.orderBy("src", "dst").limit(max_edges)


def overview(edges: DataFrame, n: int) -> DataFrame:
    """Edges among the ``n`` nodes of highest degree (1 to 250)."""
    n = min(max(n, 1), 250)
    top = degrees(edges).orderBy(F.desc("degree"), "node").limit(n).select("node")
    for end in ("src", "dst"):
        edges = edges.join(F.broadcast(top.select(F.col("node").alias(end))), end, "left_semi")
    return edges.select("src", "dst")


def rank_by_mass(links: DataFrame, mass: DataFrame, n: int) -> DataFrame:
    """The ``n`` chunks whose linked nodes hold most mass."""
    return links.join(mass, "node").groupBy("chunk").agg(F.round(F.sum("mass"), 6).alias("score")).orderBy(F.desc("score"), "chunk").limit(n)


def reach(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """node: all that are within ``hops`` of the start's nodes. A hop meets the edges with the nodes that the hop before has found alone."""
    found = last = cut(start.select("node").distinct(), "reached")
    for _ in range(hops):
        last = cut(one_hop(edges, last).join(found, "node", "left_anti"), "reached")
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int | None = None, cut_every: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """node, score on the undirected weighted graph; seeds (node, weight) that sum to nothing count alike. edges are read several times.

    Mass of nodes without an edge goes back to the seeds. Ranks are cut every round, so that none is computed twice; every ``cut_every``
    rounds the iteration ends if all scores together differ by less than ``tolerance`` from their limit, however many nodes there are.
    ``iterations`` are that many rounds at most, each a plain step. Without them there are as many as it takes, and a step goes on along the
    last one's way (Chebyshev's semi-iteration: the steps of an undirected graph have real eigenvalues up to ``damping``), so that a third
    of the rounds does. Nodes that no path joins to a seed keep 0; their edges take part in no round.
    """
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).filter("node is not null").distinct(), "nodes")
    weight = F.greatest("weight", F.lit(0.0))
    within = seeds.join(nodes, "node", "left_semi")
    sums = within.agg(F.sum(weight).alias("s"), F.count("*").alias("n")).first()
    # a plain step leaves ``damping`` of the error, which is 2 at most
    rounds = iterations if iterations is not None else 1 + math.ceil(math.log(tolerance * (1 - damping) / 2) / math.log(damping)) if damping else 1
    if not sums["n"]:
        own, start = edges, nodes.withColumn("seed", F.lit(1.0) / F.lit(max(nodes.count(), 1)))
    else:
        reached = cut(reach(edges, within, rounds), "reached")
        own = edges
        for end in ("src", "dst"):
            own = own.join(reached.select(F.col("node").alias(end)), end, "left_semi")
        part = weight / sums["s"] if sums["s"] else F.lit(1.0 / sums["n"])
        start = reached.join(seeds.select("node", part.alias("seed")), "node", "left").fillna(0.0, ["seed"])
    own = cut(own.select("src", "dst", "weight"), "own")
    flow = both_ways(own).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    total = flow.groupBy("src").agg(F.sum("weight").alias("total"))
    flow = flow.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    flow = cut(flow.repartition(max(1, own.count() // FLOW_ROWS), "dst"), "flow")  # what a node gets meets in one task, before any shuffle
    rank = cut(start.select("node", "seed", F.col("seed").alias("score"), F.lit(0.0).alias("before"), F.col("seed").alias("plain")), "start")
    sending = F.broadcast if rank.count() <= SENT_ROWS else lambda df: df
    stretch = 1.0
    for i in range(rounds):
        sent = flow.join(sending(rank.select("node", "score")), F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        plain = F.lit(1 - damping) * F.col("seed") + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        after = rank.join(sent, F.col("node") == F.col("dst"), "left").select("node", "seed", plain.alias("plain"), "score", "before")
        ahead = F.col("before") + F.lit(stretch) * (F.col("plain") - F.col("before")) if stretch != 1.0 else F.col("plain")
        rank = cut(after.select("node", "seed", ahead.alias("score"), F.col("score").alias("before"), "plain"), "ranks")
        if (i + 1) % cut_every == 0:
            moved = rank.agg(F.sum(F.abs(F.col("plain") - F.col("before")))).first()[0] or 0.0
            if moved * damping < tolerance * (1 - damping):
                break
        if iterations is None:
            stretch = 1 / (1 - damping**2 * stretch / 4) if i else 2 / (2 - damping**2)
    else:
        if iterations is None and not rank.agg(F.sum(F.abs(F.col("plain") - F.col("before")))).first()[0] * damping < tolerance * (1 - damping):
            raise ValueError("ranks do not converge: weights must be positive")
    return nodes.join(rank.select("node", F.col("plain").alias("score")), "node", "left").fillna(0.0, ["score"])


def damp_hubs(scores: DataFrame, doc_freq: DataFrame) -> DataFrame:
    """node, score: the mass of a node that many documents name counts less, by 1 / ln(2 + doc_freq)."""
    named = scores.join(doc_freq.select("node", "doc_freq"), "node", "left")
    return named.select("node", (F.col("score") / F.log(F.lit(2.0) + F.coalesce("doc_freq", F.lit(0)))).alias("score"))


def merge_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """All edges after an insert, and the degree of both ends with it: (edges, degrees)."""
    columns = ["source_id", "src", "dst", "weight"]
    whole = edges.select(*columns).unionByName(more.select(*columns))
    ends = whole.select("source_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    return whole, ends.groupBy("source_id", "node").agg(F.count("*").alias("degree"))


def link_chunks(links: DataFrame, more: DataFrame) -> DataFrame:
    """Links of nodes to chunks after an insert: a link that is there already stays as it is."""
    keys = ["source_id", "node", "chunk"]
    return links.select(*keys).unionByName(more.select(*keys)).dropDuplicates(keys)


def pending(chunks: DataFrame, progress: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` chunks, in order, that no run has completed (the cap is the feature)."""
    done = progress.filter("status = 'completed'").select("source_id", "chunk").distinct()
    return chunks.select("source_id", "chunk").join(done, ["source_id", "chunk"], "left_anti").orderBy("source_id", "chunk").limit(cap)


def segments(sources: DataFrame, with_graph: DataFrame) -> DataFrame:
    """source_id, place, has_graph, segment: neighbouring sources without a graph are one batch, each with one is its own."""
    flag = with_graph.select("source_id").distinct().withColumn("_g", F.lit(True))
    known = sources.join(flag, "source_id", "left").withColumn("has_graph", F.coalesce("_g", F.lit(False))).drop("_g")
    order = Window.orderBy("place")  # the sources of one question are few
    fresh = F.col("has_graph") | F.coalesce(F.lag("has_graph").over(order), F.lit(True))
    return known.withColumn("_fresh", fresh.cast("int")).withColumn("segment", F.sum("_fresh").over(order) - 1).drop("_fresh")


def normalize_entities(entities: DataFrame) -> DataFrame:
    """Nameless entities go; the key is the name trimmed, in lower case; a weight that is no number is 1."""
    name = F.lower(F.trim("name"))
    return entities.filter(F.trim("name") != "").select(name.alias("normalized_name"), F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)).alias("weight")).distinct()
