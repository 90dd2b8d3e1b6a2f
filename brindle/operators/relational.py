"""Joins, set operations and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_on(left: DataFrame, right: DataFrame, key: str, condition: Column) -> DataFrame:
    """Left join whose condition on the right side stands in ON: left rows without a match survive."""
    return left.join(right.filter(condition), key, "left")


def lateral_first(left: DataFrame, right: DataFrame, key: str, order: list[str], take: list[str]) -> DataFrame:
    """For each left row the ``take`` columns of the right row that is largest by ``order``."""
    top = right.groupBy(key).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("_top"))
    return left.join(top, key, "left").select(*left.columns, *(F.col(f"_top.{c}").alias(c) for c in take))


def first_by_priority(parts: list[DataFrame], key: str, take: list[str]) -> DataFrame:
    """Of several candidate frames the row of the first that has one, per key."""
    tagged = [p.select(key, F.lit(i).alias("_priority"), *take) for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, tagged)
    top = every.groupBy(key).agg(F.min(F.struct("_priority", *take)).alias("_top"))
    return top.select(key, F.col("_top._priority").alias("priority"), *(F.col(f"_top.{c}").alias(c) for c in take))


def either_key(left: DataFrame, ids: str, right: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    """Rows of ``right`` any of whose ``keys`` is in the array ``ids`` of a left row: an equi join per key instead of an OR."""
    rest = [c for c in left.columns if c != ids]
    wanted = left.select(*rest, F.explode(F.array_distinct(ids)).alias("_id"))
    found = [wanted.join(right.select(F.col(k).alias("_id"), *(F.col(t).alias(f"_r_{t}") for t in take)), "_id") for k in keys]
    return reduce(DataFrame.unionByName, (f.drop("_id") for f in found)).distinct().select(*rest, *(F.col(f"_r_{t}").alias(t) for t in take))


def hydrate(ranked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of ranked ids, with their rank; ids without a row drop out."""
    return ranked.join(rows, key)


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key and change (added or removed) between two sets."""
    added = after.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    removed = before.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def dedupe_by(rows: DataFrame, value: Column, order: list[str], take: list[str]) -> DataFrame:
    """One row per value, the first by ``order``."""
    top = rows.groupBy(value.alias("_value")).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("_top"))
    return top.select(*(F.col(f"_top.{c}").alias(c) for c in take))


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """key, content_hash, active and changed after a merge by content hash.

    A row is inserted, or updated where its hash differs or it was inactive; others stay.
    Both sides have key and content_hash, the target also active; keys are unique on each side.
    """
    t = target.select(key, F.col("content_hash").alias("_old"), F.col("active").alias("_active"))
    s = source.select(key, F.col("content_hash").alias("_new"))
    both = t.join(s, key, "full")
    seen = F.col("_new").isNotNull()
    changed = seen & (F.col("_old").isNull() | (F.col("_old") != F.col("_new")) | ~F.coalesce("_active", F.lit(False)))
    return both.select(key, F.coalesce("_new", "_old").alias("content_hash"), (seen | F.coalesce("_active", F.lit(False))).alias("active"), changed.alias("changed"), seen.alias("seen"))


def confirm_missing(state: DataFrame, seen: DataFrame, key: str, after: int = 2) -> DataFrame:
    """Counts a confirmation for each active row that was not seen; deactivates after so many. Seen rows start again at 0."""
    flag = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    joined = state.join(flag, key, "left")
    missing = F.when(F.col("_seen"), 0).when(F.col("active"), F.col("missing") + 1).otherwise(F.col("missing"))
    return joined.select(key, missing.alias("missing"), (F.col("active") & (missing < after)).alias("active"))


def merge_nodes(mentions: DataFrame) -> DataFrame:
    """One graph node per (source_id, normalized_name): mentions counted, first type, descriptions that differ in order of place.

    Equal descriptions meet before they are listed, so a node of many mentions is as large as what they say.
    """
    keys = ["source_id", "normalized_name"]
    typed = F.min(F.when(F.col("type").isNotNull(), F.struct("place", "type")))
    first = mentions.groupBy(*keys, "description").agg(F.count("*").alias("n"), F.min("place").alias("place"), typed.alias("t"))
    said = F.array_sort(F.collect_list(F.when(F.col("description") != "", F.struct("place", "description"))))
    merged = first.groupBy(*keys).agg(F.sum("n").alias("doc_freq"), F.min("t").alias("t"), F.array_join(F.transform(said, lambda x: x["description"]), " ").alias("description"))
    return merged.select(*keys, "doc_freq", F.col("t.type").alias("type"), "description")


def replace_by_path(index: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """A chunk index after whole paths were read again: all their old chunks go, the new ones come."""
    return index.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh.select(*index.columns))


def delete_by_path(index: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """A chunk index without the chunks of some paths (or sources, whatever ``keys`` name)."""
    return index.join(gone.select(*keys).distinct(), keys, "left_anti")


def upsert_by_key(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the source, and those of the target whose key it has not; keys are unique on each side."""
    return source.select(*target.columns).unionByName(target.join(source.select(*keys), keys, "left_anti"))


def mark_seen(rows: DataFrame, seen: DataFrame, key: str, at: str) -> DataFrame:
    """Rows with ``seen_at`` set to ``at`` where they were seen."""
    flag = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    return rows.join(flag, key, "left").withColumn("seen_at", F.when(F.col("_seen"), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("seen_at"))).drop("_seen")


def changed_first(changed: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Per key the row that an update changed, else the one that is there, with ``changed``."""
    both = changed.withColumn("changed", F.lit(True)).unionByName(existing.withColumn("changed", F.lit(False)))
    rest = [c for c in both.columns if c not in (key, "changed")]
    top = both.groupBy(key).agg(F.max_by(F.struct(*rest), "changed").alias("_top"), F.max("changed").alias("changed"))
    return top.select(key, *(F.col(f"_top.{c}").alias(c) for c in rest), "changed")


def owns_all(rows: DataFrame, asked: DataFrame, key: str, owner: Column) -> DataFrame:
    """One row, ok: true if every id that is asked for is a row of the owner."""
    mine = rows.filter(owner).select(key).distinct().withColumn("_mine", F.lit(1))
    return asked.select(key).distinct().join(mine, key, "left").agg((F.count("_mine") == F.count("*")).alias("ok"))


def owned_by(rows: DataFrame, owners: DataFrame, key: str, user: str) -> DataFrame:
    """Rows whose parent (``key`` in ``owners``) is the user's, looked up again on each read."""
    return rows.join(owners.filter(F.col("user_id") == user).select(key), key, "left_semi")


def with_label(rows: DataFrame, labels: DataFrame, key: str, wanted: bool) -> DataFrame:
    """Rows with the label of a dimension where it is grouped by, else with none; rows without one stay."""
    return rows.join(labels.select(key, "label"), key, "left") if wanted else rows.withColumn("label", F.lit(None).cast("string"))


def with_progress(sources: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """Sources with a state: none without progress, else failed, processing or done by its status."""
    state = F.when(F.col("status").isNull(), "none").when(F.col("status") == "failed", "failed").when(F.col("done") < F.col("total"), "processing").otherwise("done")
    return sources.join(progress.select(key, "status", "done", "total"), key, "left").withColumn("state", state).drop("status", "done", "total")


def fixture_filter(rows: DataFrame, repositories: list[str], sources: list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of the repositories and source types, whatever the case; with a bound on the day, rows without one go."""
    for column, names in (("repository", repositories), ("source_type", sources)):
        if names:
            rows = rows.filter(F.lower(column).isin(*(n.lower() for n in names)))
    for bound, keep in ((since, lambda b: F.col("day") >= b), (until, lambda b: F.col("day") <= b)):
        if bound:
            rows = rows.filter(keep(F.lit(bound).cast("date")))
    return rows


def report(rows: DataFrame, section: list[str], order: str, line: str) -> DataFrame:
    """The section columns and report: a Markdown heading of them, and a list of its lines in order. A section is one text, so as small as a reader wants it."""
    listed = F.array_sort(F.collect_list(F.struct(order, line)))
    lines = F.transform(listed, lambda x: F.concat(F.lit("- "), x[line]))
    title = F.concat_ws(" ", F.lit("##"), *(F.col(c).cast("string") for c in section))
    return rows.groupBy(*section).agg(F.array_join(lines, "\n").alias("_lines")).select(*section, F.concat(title, F.lit("\n"), F.col("_lines")).alias("report"))


def report_claims(claims: DataFrame, section: str, key: str, kind: str, cited: str) -> DataFrame:
    """section, key, kind, first: claims split by kind, one that cites nothing is a risk; ``first`` marks the first claim of each source.

    Sources meet by a hash, so a section however large is dealt to many tasks.
    """
    tagged = claims.select(section, key, F.when(F.col(cited).isNull(), "risk").otherwise(F.col(kind)).alias(kind), F.xxhash64(cited).alias("_h"), F.col(cited).isNull().alias("_none"))
    heads = tagged.filter("not _none").groupBy(section, "_h").agg(F.min(key).alias(key)).select(section, key, F.lit(True).alias("first"))
    return tagged.join(heads, [section, key], "left").select(section, key, kind, F.coalesce("first", F.lit(False)).alias("first"))


def keep_or_reset(progress: DataFrame, attempt: DataFrame, key: str) -> DataFrame:
    """Progress of the same attempt (null equals null) is kept, that of another starts again at 0."""
    joined = progress.join(attempt.withColumnRenamed("attempt", "_attempt"), key, "left")
    return joined.select(key, F.when(F.col("attempt").eqNullSafe(F.col("_attempt")), F.col("done")).otherwise(0).alias("done"))
