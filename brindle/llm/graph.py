"""Connected components by alternating large and small stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from brindle.llm.common import cut


#: Parts that the links of a hub are dealt into, how many times the links in all a hub's are at least one of, and the links
#: up to which no id can be more than a task holds with ease.
SALTS, HUBS, FEW_LINKS = 32, 5000, 1_000_000


def _with_least(both: DataFrame, n_links: int) -> DataFrame:
    """id, up and m, the smallest of an id and its neighbours, for each of its links.

    An id of more than a ``HUBS``-th of all links is a hub; there are at most two times ``HUBS`` such, so they are broadcast,
    and a hub's links meet its m in parts. Up to ``FEW_LINKS`` there is no need to.
    """
    most = n_links // HUBS
    least = both.groupBy("id").agg(F.min("up").alias("m"), F.count("*").alias("c")).select("id", F.least("id", "m").alias("m"), "c")
    if n_links <= FEW_LINKS:
        return both.join(least.select("id", "m"), "id")
    hubs = least.filter(F.col("c") > most).select("id", F.lit(True).alias("hub"))
    part = F.when(F.col("hub"), F.pmod(F.xxhash64("up"), F.lit(SALTS)).cast("int")).otherwise(0)
    links = both.join(F.broadcast(hubs), "id", "left").withColumn("part", part).drop("hub")
    parts = F.when(F.col("c") > most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return links.join(least.select("id", "m", F.explode(parts).alias("part")), ["id", "part"]).drop("part")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b, of any ordered type): the smallest id that links reach.

    Each round hangs every id on its smallest neighbour so far and cuts the lineage in the shared
    folder; aggregates combine before the shuffle and a hub's links are dealt into parts. Loops (a = b) and
    repeated edges change nothing; no edges give an empty result.
    """
    links, before = _cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("up")).distinct())
    while before[0]:
        both = links.unionByName(links.select(F.col("up").alias("id"), F.col("id").alias("up")))
        large = _with_least(both, before[0]).filter("up > id").select(F.col("up").alias("id"), F.col("m").alias("up")).filter("id > up").distinct()
        lower = large.groupBy("id").agg(F.min("up").alias("m"))
        small = large.join(lower, "id").filter("up > m").select(F.col("up").alias("id"), F.col("m").alias("up"))
        links, after = _cut(small.unionByName(lower.withColumnRenamed("m", "up")).distinct())
        if after == before:
            break
        before = after
    labels = links.select("id", F.col("up").alias("component"))
    return labels.unionByName(links.select(F.col("up").alias("id"), F.col("up").alias("component")).distinct())


def _cut(links: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The links, written and read back; how many there are, and a digest of them, observed while writing."""
    seen = Observation()
    frame = cut(links.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("id", "up")).alias("x")), "links")
    return frame, (seen.get["n"], seen.get["x"] or 0)
