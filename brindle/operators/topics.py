"""Deterministic spherical k-means with labels, and feature comparison matrices."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.sources.shared import cut

# Words that never name a topic.
STOPWORDS = (
    "about", "after", "again", "also", "and", "are", "been", "before", "being", "but", "can", "could", "does", "for", "from", "have", "into", "its", "more", "not", "our", "should",
    "that", "the", "their", "there", "these", "this", "through", "with", "would",
)


def cluster_count(n: int, most: int = 12) -> int:
    """min(n, most, max(2, sqrt(n / 2) rounded half to even))."""
    return min(n, most, max(2, round(math.sqrt(n / 2))))


def clusters(vectors: DataFrame, k: int | None = None, most: int = 12, iterations: int = 50, digits: int = 9) -> DataFrame:
    """vec_id, cluster: spherical k-means from farthest points, deterministic.

    Vectors that can't be normalised take no part. The centroids (k of them, at most ``most``) are all
    that the driver holds; assignment and means run on the cluster.
    """
    unit = cut(vectors.select("vec_id", V.normalize(F.col("embedding")).alias("x")).filter("x is not null"), "unit")
    n = unit.count()
    if not n:
        return unit.select("vec_id", F.lit(0).alias("cluster"))
    k = min(n, k or cluster_count(n, most))
    literal = lambda c: F.array(*(F.lit(float(v)) for v in c))
    seeds = [unit.orderBy("vec_id").select("x").first()[0]]
    while len(seeds) < k:
        far = reduce(F.greatest, (V.dot(F.col("x"), literal(c)) for c in seeds), F.lit(-2.0))
        seeds.append(unit.select("x", F.round(far, 12).alias("near"), "vec_id").orderBy("near", "vec_id").first()["x"])
    centres = [list(map(float, s)) for s in seeds]

    def assigned() -> DataFrame:
        scores = F.array(*(F.round(V.dot(F.col("x"), literal(c)), digits) for c in centres))
        return unit.select("vec_id", "x", (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("cluster"))

    for _ in range(iterations):
        means = assigned().select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("v"))
        found: dict[int, np.ndarray] = {}
        for row in means.collect():  # k centroids, of the width of a vector each
            found.setdefault(row["cluster"], np.zeros(len(centres[0])))[row["i"]] = row["v"]
        after = [(found[c] / np.linalg.norm(found[c])).tolist() if c in found and np.linalg.norm(found[c]) > 0 else centres[c] for c in range(len(centres))]
        moved = max(np.abs(np.array(a) - np.array(b)).max() for a, b in zip(after, centres))
        centres = after
        if moved < 10.0**-digits:
            break
    return assigned().select("vec_id", "cluster")


def labels(titles: DataFrame, n: int = 5) -> DataFrame:
    """cluster, label: its ``n`` most frequent title words, ties in order; quotes, hyphens and underscores around a word go."""
    word = F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[a-z0-9][a-z0-9_'-]*|[一-鿿]{2,}"), F.lit(0)))
    bare = titles.select("cluster", word.alias("raw")).select("cluster", F.regexp_replace("raw", r"['_-]+$", "").alias("word"))
    counts = bare.filter(~F.col("word").isin(*STOPWORDS) & (F.col("word") != "") & ~F.col("word").rlike("^[0-9]+$")).groupBy("cluster", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return top.groupBy("cluster").agg(F.array_join(F.transform(listed, lambda x: x["word"]), " / ").alias("label"))


def snapshot_id(clusters_: DataFrame, version: str = "v1", digits: int = 12) -> DataFrame:
    """One row, snapshot_id: sha256 over the version and each cluster's sorted members and rounded centroid, in order.

    clusters_ has cluster, members (array of ids) and centroid; clusters are few.
    """
    line = F.to_json(F.struct("cluster", F.sort_array("members").alias("members"), F.transform("centroid", lambda v: F.round(v.cast("double"), digits)).alias("centroid")))
    listed = F.array_sort(F.collect_list(F.struct("cluster", line.alias("line"))))
    return clusters_.agg(F.sha2(F.concat_ws("\n", F.lit(version), F.transform(listed, lambda x: x["line"])), 256).alias("snapshot_id"))


def feature_class(text: Column, terms: list[str], official: Column, positive: list[str], negative: list[str], around: int = 60) -> Column:
    """positive, negative or null: a term as a whole word, with a negative cue near it or a positive one anywhere."""
    text = F.lower(text)
    either = "|".join(r"\Q" + t.lower() + r"\E" for t in terms)
    term = rf"(?<![A-Za-z0-9_])(?:{either})(?![A-Za-z0-9_])"
    bad = "|".join(r"\Q" + c + r"\E" for c in negative)
    near = text.rlike(rf"(?s){term}.{{0,{around}}}?(?:{bad})|(?:{bad}).{{0,{around}}}?{term}")
    good = reduce(lambda a, b: a | b, (text.contains(c) for c in positive))
    return F.when(~text.rlike(term), None).when(near, "negative").when(official | good, "positive")


def comparison_matrix(rows: DataFrame, dimensions: dict[str, list[str]], positive: list[str], negative: list[str]) -> DataFrame:
    """dimension, repository, status, first_date, signals, evidence: what records say on each dimension.

    rows has id, repository, source_type, text and day. Evidence for and against makes a cell
    unknown, as does none. One pass over the rows classifies all dimensions.
    """
    official = F.col("source_type").isin("documentation", "release")
    cells = F.array(*(F.struct(F.lit(d).alias("dimension"), feature_class(F.col("text"), terms, official, positive, negative).alias("found")) for d, terms in dimensions.items()))
    seen = rows.select("id", "repository", "source_type", "day", F.explode(cells).alias("c")).select("id", "repository", "source_type", "day", "c.dimension", "c.found")
    is_ = lambda kind: F.col("found") == kind
    grouped = seen.groupBy("dimension", "repository").agg(
        F.count_if(is_("positive")).alias("p"), F.count_if(is_("negative")).alias("n"), F.min(F.when(is_("positive"), F.col("day"))).alias("first_p"), F.min(F.when(is_("negative"), F.col("day"))).alias("first_n"),
        F.count_if(is_("positive") & ~official).alias("sig_p"), F.count_if(is_("negative") & ~official).alias("sig_n"),
    )
    status = F.when((F.col("p") > 0) & (F.col("n") > 0), "unknown").when(F.col("p") > 0, "supported").when(F.col("n") > 0, "not_supported").otherwise("unknown")
    pick = lambda a, b: F.when(status == "supported", F.col(a)).when(status == "not_supported", F.col(b))
    return grouped.select(
        "dimension", "repository", status.alias("status"), F.coalesce(pick("first_p", "first_n"), F.least("first_p", "first_n")).alias("first_date"),
        F.coalesce(pick("sig_p", "sig_n"), F.col("sig_p") + F.col("sig_n")).alias("signals"), (F.col("p") + F.col("n")).alias("evidence"),
    )
