"""Question routing and claim confidence by rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers of each intent, in order of priority.
MARKERS = {
    "relational": ("相关", "关系", "关联", "related", "relationship"),
    "comparative": ("比较", "对比", "差异", "compare", "versus", " vs "),
    "aggregate": ("多少", "数量", "统计", "how many", "number of", "count", "median", "sum"),
    "temporal": ("何时", "什么时候", "最近", "时间", "when", "recent", "latest", "most recent"),
}
STRATEGIES = {"factual": "hybrid_rerank", "temporal": "hybrid_rerank", "comparative": "split_hybrid", "aggregate": "sql_plus_hybrid", "relational": "graphrag"}


def intent(question: Column) -> Column:
    """The first intent one of whose markers the question holds, else factual."""
    q = F.lower(F.coalesce(question, F.lit("")))
    has = lambda markers: reduce(lambda a, b: a | b, (q.contains(m) for m in markers))
    return reduce(lambda acc, x: acc.when(has(x[1]), x[0]), list(MARKERS.items())[1:], F.when(has(MARKERS["relational"]), "relational")).otherwise("factual")


def strategy(intent_: Column, certainty: Column, threshold: float = 0.65) -> Column:
    """The intent's retrieval strategy; hybrid where the certainty is below the threshold."""
    chosen = reduce(lambda acc, x: acc.when(intent_ == x[0], x[1]), list(STRATEGIES.items())[1:], F.when(intent_ == "factual", STRATEGIES["factual"]))
    return F.when(certainty < threshold, "hybrid").otherwise(chosen)


# What names a metric and a dimension in a question, in order of priority.
METRIC_WORDS = {"median_comments": ("median", "中位"), "sum_reactions": ("reaction", "点赞")}
DIMENSION_WORDS = {"source_type": ("source", "来源", "类型"), "label": ("label", "标签"), "month": ("month", "月", "趋势"), "state": ("state", "状态")}


def aggregate_spec(question: Column) -> Column:
    """(metric, dimension) that a question asks for; count by repository if it names none."""
    q = F.lower(F.coalesce(question, F.lit("")))
    named = lambda words: reduce(lambda a, b: a | b, map(q.contains, words))
    first = lambda table, default: F.coalesce(*(F.when(named(words), name) for name, words in table.items()), F.lit(default))
    return F.struct(first(METRIC_WORDS, "count").alias("metric"), first(DIMENSION_WORDS, "repository").alias("dimension"))


def confidence(sources: Column, high: int = 3) -> Column:
    """high, medium or low by the number of sources that differ in more than case and outer space."""
    n = F.size(F.array_distinct(F.transform(sources, lambda x: F.lower(F.trim(x)))))
    return F.when(n >= high, "high").when(n >= 1, "medium").otherwise("low")
