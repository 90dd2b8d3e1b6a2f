"""Sharding by a minimax contiguous partition: documents, kept in order, cut into shards whose largest is as small as can be.

Law ``bytes``. Documents with equal texts form an atomic group, ordered by its smallest doc_id; groups are cut into at
most ``n_shards`` stretches. The capacity, which is the size of the largest stretch, is the smallest that a greedy
filling can keep to, found by binary search. A group that exceeds it has a shard of its own: so a group of a third of
all rows, which no law on whole groups can split, leaves the other shards near equal, and the largest shard is no larger for it. Each check needs the place of the last group that still fits, that is,
prefix sums of the group sizes; there may be as many groups as documents, so they stay in Spark: the search works on at most
``BLOCKS`` prefix sums, of blocks of groups, which tell capacities that surely suffice from those that surely do not. Only blocks
in which a cut may fall are opened into finer ones for the next round, until each cut is at a group's end (two or
three rounds up to 10^10 groups).

All on DataFrames: groups by hash with map-side combination, prefix sums by range partitions and windows within them, shards
by a join of documents with their group (skewed groups are left to adaptive execution), slots by range partitions again,
whose keys go on to doc_id and row, so that a group of any size is spread. Texts are read once, for their sizes and hashes.

Defined cases: a null text has no bytes, size 1, and is equal to the empty text; equal texts are those of equal SHA-256; a document is
a row (repeated rows have slots of their own); groups of null doc_ids alone come first; with fewer groups than shards the last shards stay empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import cut

N_SHARDS = 16
#: Prefix sums that the search works on in one round.
BLOCKS = 4096


class Known(NamedTuple):
    """Prefix sums of group sizes that are known, which of the stretches between them hold further ones, and the largest groups."""

    ends: list[int]  # ascending, from 0 to the total
    inner: list[bool]  # inner[i]: groups end between ends[i - 1] and ends[i]
    large: list[tuple[int, int]]  # where the n_shards + 1 largest groups begin and end, ascending


def _fill(known: Known, capacity: int, n_shards: int, hopeful: bool) -> list[int]:
    """Where greedy shards end. Hopeful: as if a group ended wherever one may; else only where one is known to."""
    above = [(a, b) for a, b in known.large if b - a > capacity]
    at, cuts = 0, []
    for _ in range(n_shards):
        ahead = next(((a, b) for a, b in above if b > at), None)
        if ahead and ahead[0] <= at:
            at = ahead[1]  # a group of its own
        else:
            bound = min(at + capacity, ahead[0]) if ahead else at + capacity
            i = bisect_right(known.ends, bound) - 1
            at = max(at, bound if hopeful and i + 1 < len(known.ends) and known.inner[i + 1] else known.ends[i])
        cuts.append(at)
    return cuts


def _least(low: int, high: int, fits) -> int:
    """The smallest capacity that fits, of those from low to high, where high does."""
    while low < high:
        middle = (low + high) // 2
        if fits(middle):
            high = middle
        else:
            low = middle + 1
    return low


def _search(known: Known, n_shards: int) -> tuple[int, int, list[tuple[int, int]]]:
    """A capacity that none below can do, one that does, and for each cut the stretch of prefix sums where it may be."""
    total = known.ends[-1]
    sure = _least(1, total, lambda c: _fill(known, c, n_shards, False)[-1] >= total)
    may = _least(1, sure, lambda c: _fill(known, c, n_shards, True)[-1] >= total)
    return may, sure, list(zip(_fill(known, may, n_shards, False), _fill(known, sure, n_shards, True)))


def _prefix_sums(groups: DataFrame) -> DataFrame:
    """The groups with ``end``, the size of all groups up to them in order of (first, key)."""
    dealt = cut(groups.repartitionByRange("first", "key").withColumn("part", F.spark_partition_id()), "sharding-groups")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = dealt.groupBy("part").agg(F.sum("bytes").alias("bytes")).select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("first", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(F.broadcast(parts), "part").withColumn("end", F.col("before") + F.sum("bytes").over(within)).drop("before", "part")


def _blocks(groups: DataFrame, stretches: list[tuple[int, int]], width: int) -> dict[int, bool]:
    """Of the groups that end within the stretches: prefix sums at the ends of blocks of about ``width``, and whether a block holds more than one."""
    anywhere, stretch = F.lit(False), F.lit(0)
    for a, b in stretches:
        anywhere = anywhere | (F.col("end") > a) & (F.col("end") <= b)
        stretch = stretch + (F.col("end") > a).cast("int")
    block = F.call_function("div", F.col("end"), F.lit(width).cast("long"))
    return {r["end"]: r["n"] > 1 for r in groups.filter(anywhere).groupBy(stretch.alias("stretch"), block.alias("block")).agg(F.max("end").alias("end"), F.count("*").alias("n")).collect()}


def minimax_cuts(groups: DataFrame, n_shards: int = N_SHARDS, n_blocks: int = BLOCKS) -> list[int]:
    """Prefix sums (column ``end``; sizes ``bytes``) at which the shards end, of the smallest capacity that greedy filling keeps to."""
    total = groups.agg(F.max("end")).first()[0]
    if not total:
        return [0] * n_shards
    large = sorted((r["end"] - r["bytes"], r["end"]) for r in groups.orderBy(F.desc("bytes"), "end").limit(n_shards + 1).collect())
    held = {0: False, total: True} | {e: True for pair in large for e in pair}
    stretches, width = [(0, total)], total
    while True:
        width = max(1, min(width // 2, sum(b - a for a, b in stretches) // n_blocks))
        held = {e: inner for e, inner in held.items() if not any(a < e <= b for a, b in stretches)} | _blocks(groups, stretches, width)
        for a, b in large:  # a block that a large group begins or ends in is cut there
            i = min((e for e in held if e >= a), default=None)
            held |= {a: held[i]} if a not in held and i is not None else {}
            held |= {b: False}
        ends = sorted(held)
        known = Known(ends, [held[e] for e in ends], large)
        may, sure, cuts = _search(known, n_shards)
        open_ = [(ends[i - 1], ends[i]) for i in range(1, len(ends)) if held[ends[i]] and any(low < ends[i] and ends[i - 1] < high for low, high in cuts)]
        if not open_:
            return _fill(known, sure, n_shards, False)
        stretches = _joined(open_)


def _joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in stretches:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless in a shard), grown_shard (null under this law)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (_bytes(F.col("text")) + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")), "sharding-rows"
    )
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    groups = cut(_prefix_sums(groups), "sharding-ends")
    cuts = minimax_cuts(groups, n_shards, n_blocks)
    placed = groups.select("key", "end", sum(((F.col("end") > c).cast("int") for c in cuts[:-1]), F.lit(0)).alias("shard"))

    # slots: in order of group, doc_id and row, by ranges
    ranged = rows.join(placed, "key").repartitionByRange("end", "doc_id", "row").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged, "sharding-placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition and shard
    parts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part", "shard").orderBy("end", "doc_id", "row")
    slots = ranged.join(F.broadcast(parts), ["shard", "part"]).withColumn("slot", F.col("before") + F.row_number().over(within) - 1)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
