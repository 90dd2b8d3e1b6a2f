"""Per-group ranking, budgets and paging."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.shared import cut


#: Rows of a group that a round folds: below Spark's limit for finding them before the shuffle (windowGroupLimitThreshold, 1000).
ROUND = 900


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "_rank") -> DataFrame:
    """The first ``n`` rows of every group; Spark drops the others before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
    return kept.drop(rank) if rank == "_rank" else kept


def nth(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == n).drop("_rank")


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the largest ``by`` of every group, as an aggregate that combines before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*by)).alias("_top"))
    return top.select(*keys, *(F.col(f"_top.{c}").alias(c) for c in others))


def trailing(rows: DataFrame, ts: str, now: str, hours: int) -> DataFrame:
    """Rows of the ``hours`` before ``now``."""
    end = F.lit(now).cast("timestamp_ntz")
    return rows.filter((F.col(ts) >= end - F.expr(f"INTERVAL {hours} HOUR")) & (F.col(ts) < end))


def signal(rows: DataFrame, digits: int = 9) -> DataFrame:
    """Adds ``signal``: comments and reactions against the most of the repository, weighted 0.6 and 0.4."""
    top = rows.groupBy("repository").agg(F.max("comments").alias("_c"), F.max("reactions").alias("_r"))
    part = lambda c, m: F.greatest(F.col(c), F.lit(0)) / F.greatest(F.lit(1), F.col(m))
    share = F.lit(0.6) * F.greatest(F.col("comments"), F.lit(0)) / F.greatest(F.lit(1), F.col("_c")) + F.lit(0.4) * F.greatest(F.col("reactions"), F.lit(0)) / F.greatest(F.lit(1), F.col("_r"))
    return rows.join(top, "repository").withColumn("signal", F.round(share, digits)).drop("_c", "_r")


def budget_prefix(rows: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows of each group in order, as long as the running cost stays below the budget.

    Where costs are whole and at least 1 no group keeps more rows than the budget: such rows beyond go before the
    shuffle, and a task's share of a group is bounded. Rows without a cost or of cost 0 stay in.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    free = rows.filter(F.coalesce(cost, F.lit(0)) < 1)
    paid = rows.filter(F.col(cost) >= 1).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= budget).drop("_n")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return paid.unionByName(free).withColumn("used", F.sum(cost).over(running)).filter(F.col("used") < budget)


def budget_skip(rows: DataFrame, key: str, order: str, cost: str, budget: int, chunk: int = ROUND) -> DataFrame:
    """order, key, used: rows of each group in order; one that does not fit is skipped and the next may fit.

    Costs are whole and at least 1. Groups are folded in rounds, see ``_in_rounds``.
    """
    return _in_rounds(rows, key, None, order, cost, 0, budget, chunk).select(order, key, "used")


def shared_budget(rows: DataFrame, key: str, place: str, order: str, cost: str, k: int, budget: int, most: int | None = None, chunk: int = ROUND) -> DataFrame:
    """key, place, order, used: one budget of each group over its sources, taken in order of ``place``.

    A source's rows are taken in order, up to ``k`` of them; one that does not fit is skipped and the next may fit. What the
    sources before have used is gone, so the last ones may get nothing. ``most`` keeps the first rows of a group, over all its
    sources. Costs are whole. Groups are folded in rounds, see ``_in_rounds``; none has to fit into a task.
    """
    found = _in_rounds(rows, key, place, order, cost, k, budget, chunk).select(key, place, order, "used")
    return found if most is None else newest(found, [key], [F.asc(place), F.asc(order), F.asc("used")], most)


def _in_rounds(rows: DataFrame, key: str, place: str | None, order: str, cost: str, k: int, budget: int, chunk: int) -> DataFrame:
    """The kept rows of each group with the budget used up to them.

    A round folds the first ``chunk`` rows of every group, which Spark finds before the shuffle. What goes on is what the fold has used and how
    many rows of its last source it has kept. Rows that no longer fit and rows of a source that has its ``k`` then go,
    so what is left for the next round are later rows that may still be kept. So no task holds more of a group
    than a chunk, however large it is, and there are about as many rounds as a group has chunks of rows that could fit.
    """
    source = [place] if place else []
    carried = (T.StructField("_row", T.LongType()), T.StructField("used", T.LongType()), T.StructField("_held", T.LongType()), T.StructField("kept", T.BooleanType()), T.StructField("more", T.BooleanType()))
    schema = T.StructType([*(rows.schema[c] for c in (key, *source, order)), *carried])

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rank")
        used, held, at = (table[c][0].as_py() for c in ("_base", "_held", "_place"))
        keep, sums = [], []
        for i, (c, p) in enumerate(zip(table["_cost"].to_pylist(), table[place or key].to_pylist())):
            if p != at and place:
                at, held = p, 0
            if used + c < budget and (held < k or not place):
                used, held = used + c, held + 1
                keep.append(i)
                sums.append(used)
        picked = table.take(pa.array([*keep, table.num_rows - 1])).select([key, *source, order, "_row"])
        n = len(keep)
        columns = {"used": pa.array([*sums, used], pa.int64()), "_held": pa.array([0] * n + [held], pa.int64()), "kept": pa.array([True] * n + [False]), "more": pa.array([False] * n + [table.num_rows == chunk])}
        for name, values in columns.items():
            picked = picked.append_column(name, values)
        return picked

    of_place = F.col(place) if place else F.lit(0)
    fits = rows.select(key, *source, order, F.col(cost).cast("long").alias("_cost")).filter(F.col("_cost") < budget)
    left = cut(fits.select("*", F.monotonically_increasing_id().alias("_row"), F.lit(0).cast("long").alias("_base"), F.lit(0).cast("long").alias("_held"), F.lit(None).cast(dict(rows.dtypes)[place] if place else "int").alias("_place")), "budget")
    w = Window.partitionBy(key).orderBy(*source, order, "_row")
    position = F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate((*source, order, "_row"))))
    rounds = []
    while True:
        ranked = left.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= chunk)
        folded = cut(ranked.groupBy(key).applyInArrow(fold, schema), "budget")
        rounds.append(folded.filter("kept").select(key, *source, order, "used"))
        state = folded.filter("more").select(F.col(key).alias("_key"), position.alias("_last"), of_place.alias("_at"), F.col("used").alias("_used"), F.col("_held").alias("_kept"))
        if state.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        later = left.drop("_held", "_place").join(state, F.col(key).eqNullSafe(F.col("_key"))).filter((position > F.col("_last")) & (F.col("_used") + F.col("_cost") < budget))
        if place:
            later = later.filter(~(of_place.eqNullSafe(F.col("_at")) & (F.col("_kept") >= k)))
        left = cut(later.select(key, *source, order, "_cost", "_row", F.col("_used").alias("_base"), F.col("_kept").alias("_held"), (F.col("_at") if place else F.lit(None).cast("int")).alias("_place")), "budget")


def dispatch(hits: DataFrame, known: tuple[str, ...], budget: int, otherwise: str = "classic") -> DataFrame:
    """query_id, retriever, doc, used: what each retriever found, merged under one token budget.

    hits has query_id, source, retriever, rank, doc and tokens. Sources go to the group of their retriever (an unknown one
    to ``otherwise``), groups in order of their first source. Each gets an even share of the budget, the first what
    is left over, and skips what does not fit; groups are then appended up to nine tenths of the budget (100 at
    least). The hits of a query, the best of every source, are what one call holds.
    """
    schema = T.StructType([hits.schema["query_id"], T.StructField("retriever", T.StringType()), hits.schema["doc"], T.StructField("used", T.LongType())])
    cap = max(int(budget * 0.9), 100)

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("source", "rank", "retriever", "doc", "tokens"))))
        groups: dict[str, list] = {}
        for _, _, retriever, doc, tokens in rows:
            groups.setdefault(retriever, []).append((doc, tokens))
        out, used = [], 0
        for place, (retriever, found) in enumerate(groups.items()):
            share, own = budget // len(groups) + (place < budget % len(groups)), 0
            for doc, tokens in found:
                if own + tokens >= share:
                    continue
                own += tokens
                if used + tokens < cap:
                    used += tokens
                    out.append((retriever, doc, used))
        query = table["query_id"].take(pa.array([0] * len(out), pa.int64()))
        return pa.table({"query_id": query, "retriever": pa.array([r for r, _, _ in out], pa.string()), "doc": pa.array([d for _, d, _ in out], table["doc"].type), "used": pa.array([u for _, _, u in out], pa.int64())})

    named = hits.select("query_id", "source", F.when(F.col("retriever").isin(*known), F.col("retriever")).otherwise(otherwise).alias("retriever"), "rank", "doc", F.col("tokens").cast("long").alias("tokens"))
    return named.groupBy("query_id").applyInArrow(fold, schema)


def split_budget(groups: DataFrame, key: str, budget: int) -> DataFrame:
    """An even split of a budget; the first groups get what is left over. Groups are few (one a source)."""
    listed = groups.agg(F.array_sort(F.collect_set(key)).alias("g"))
    spread = listed.select(F.posexplode("g").alias("i", key), F.size("g").alias("n"))
    return spread.select(key, (F.floor(F.lit(budget) / F.col("n")) + F.when(F.col("i") < F.lit(budget) % F.col("n"), 1).otherwise(0)).cast("long").alias("budget"))


def since_last_point(rows: DataFrame, key: str, order: str, amount: str, usable: Column) -> DataFrame:
    """Per key the last usable point (-1 without one) and the amount after it."""
    points = rows.filter(usable).groupBy(key).agg(F.max(order).alias("point"))
    joined = rows.join(points, key, "left").withColumn("point", F.coalesce("point", F.lit(-1)))
    return joined.groupBy(key).agg(F.any_value("point").alias("point"), F.coalesce(F.sum(F.when(F.col(order) > F.col("point"), F.col(amount))), F.lit(0)).alias(amount))


def page(rows: DataFrame, order: list[Column], size: int, offset: int) -> DataFrame:
    """One page, with has_more: one row more is read than is returned."""
    more = rows.orderBy(*order).offset(offset).limit(size + 1)
    w = Window.orderBy(*order)
    numbered = more.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return numbered.filter(F.col("_n") <= size).drop("_n")


def sorted_page(rows: DataFrame, columns: dict[str, str], by: str, descending: bool, key: str, size: int, offset: int) -> DataFrame:
    """One page in the order of one of the named columns, either way; ``key`` breaks ties."""
    if by not in columns:
        raise ValueError(f"sort by one of {tuple(columns)}")
    first = F.desc(columns[by]) if descending else F.asc(columns[by])
    return rows.orderBy(first, key).offset(offset).limit(size)
