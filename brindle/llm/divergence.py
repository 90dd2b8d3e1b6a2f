"""Source divergence audit: how far the word frequencies of each source of a language lie from those of the others.

Terms are runs of letters and of characters beyond ASCII, A to Z lower-cased. A language keeps the V terms that
at least three of its documents hold. A term that occurs ``count`` times in a group of N kept occurrences has
p = 1 + floor(10^9 (count + 1) / (N + V)); two groups differ by floor((p - q)^2 / q) at a term. All of it is whole numbers.

By sorting and streaming, in two scans of runs. Tasks count terms of the documents that they read, first
combined over blocks of documents, so that the rows of a term grow with the blocks, not with the documents.
Rows are dealt by (lang, term, source) and sorted by (lang, term, source, document): a run-length scan adds up
document frequencies and counts, its state being one run. What is left is dealt by (lang, term); a second scan
keeps the runs of three documents or more. Runs of the kept terms, once more in order, give partial sums for the
pairs of sources in which a term occurs. Terms that a source lacks have one and the same p there, so what they
add follows from how many terms of a source have each count:

    value(A, B) = V f(A0, B0) + sum over A's terms [f(a, B0) - f(A0, B0)] + sum over B's terms [f(A0, b) - f(A0, B0)]
                + sum over common terms [f(a, b) - f(a, B0) - f(A0, b) + f(A0, B0)]

with a, b the p of a term and A0, B0 that of a term with count 0. Scans hold one run of rows of a term: at most
the sources of its language, which the result has squared anyway.

Defined cases: null text, lang or source are ''; a document is a row (a repeated row counts again, whatever its
doc_id); a group without terms, and a language without kept terms (pairs of value 0), are there; an empty
table gives no rows; other columns are ignored, whatever their names. Counts are exact up to 9 * 10^15 occurrences a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import cut, runs, slices, split_words

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Rows of counts that a task combines before it sends them.
COMBINED_ROWS = 700_000
#: Pairs of entries that a task works on at once.
PAIRS_AT_ONCE = 1 << 20

#: Letters to lower case, bytes of characters beyond ASCII as they are, all others to a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_HELD = pa.schema([("group", pa.int64()), ("term", pa.string()), ("document", pa.int64()), ("n_docs", pa.int64()), ("count", pa.int64())])
_COUNTS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("document", pa.int64()), ("n_docs", pa.int64()), ("count", pa.int64())])


def _letters(texts: pa.Array) -> pa.Array:
    """The texts with all that belongs to no term made a space."""
    array = texts.cast(pa.large_string())
    data = array.buffers()[2]
    return pa.Array.from_buffers(pa.large_string(), len(array), [None, array.buffers()[1], pa.py_buffer((data.to_pybytes() if data else b"").translate(_LETTERS))], offset=array.offset)


def _count_slice(batch: pa.RecordBatch, groups: dict[tuple[str, str], int]) -> pa.Table:
    """group (a number for lang and source), term, smallest document, documents and occurrences of a slice."""
    codes, offsets, terms = split_words(_letters(batch["text"]))
    owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    group = np.array([groups.setdefault(g, len(groups)) for g in zip(batch["lang"].to_pylist(), batch["source"].to_pylist())], np.int64)
    width = max(len(terms), 1)
    held, times = np.unique(owner * width + codes, return_counts=True)
    owner, code = held // width, held % width
    key = group[owner] * width + code if len(owner) else owner
    order = np.lexsort((owner, key))
    key, owner, times = key[order], owner[order], times[order]
    starts = np.flatnonzero(runs(key)) if len(key) else np.zeros(0, np.int64)
    columns = [key[starts] // width, terms.cast(pa.string()).take(pa.array(key[starts] % width)), batch["doc_id"].take(pa.array(owner[starts])), np.diff(np.append(starts, len(key))), np.add.reduceat(times, starts) if len(starts) else starts]
    return pa.table(columns, schema=_HELD)


def _combined(tables: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(tables).group_by(["group", "term"]).aggregate([("document", "min"), ("n_docs", "sum"), ("count", "sum")])
    return got.select(["group", "term", "document_min", "n_docs_sum", "count_sum"]).rename_columns(_HELD.names).cast(_HELD)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    groups: dict[tuple[str, str], int] = {}

    def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
        for b in table.to_batches(max_chunksize=50_000):
            yield pa.RecordBatch.from_arrays([langs.take(b["group"]), b["term"], sources.take(b["group"]), *(b[c] for c in ("document", "n_docs", "count"))], schema=_COUNTS)

    for whole in batches:
        for batch in slices(whole, "text"):
            held.append(_count_slice(batch, groups))
            if sum(t.num_rows for t in held) > COMBINED_ROWS:
                held = [_combined(held)]
                pa.default_memory_pool().release_unused()
                if held[0].num_rows > COMBINED_ROWS // 2:
                    yield from sent(held.pop())
                    groups = {}
    if held:
        yield from sent(_combined(held))


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    """Whether the last row of a and the first of b belong to one run."""
    return all(a[k][len(a) - 1] == b[k][0] for k in keys)


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in batches of whole runs, with where runs of equal keys begin; a run that goes on is held back."""
    held: list[pa.RecordBatch] = []

    def given() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield batch, np.flatnonzero(_begins(batch, keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        begins = np.flatnonzero(_begins(batch, keys))
        if held and not _same(held[-1], batch, keys):
            yield from given()
            held = []
        last = int(begins[-1])
        if last:
            held.append(batch.slice(0, last))
            yield from given()
            held = []
        held.append(batch.slice(last))
    if held:
        yield from given()


def _begins(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    first = np.ones(batch.num_rows, dtype=bool)
    if batch.num_rows > 1:
        first[1:] = False
        for k in keys:
            first[1:] |= pc.not_equal(batch[k].slice(1), batch[k].slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return first


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (lang, term, source), sorted by document: their documents and occurrences."""
    for batch, starts in _whole_runs(batches, ["lang", "term", "source"]):
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays([*(batch[k].take(at) for k in ("lang", "term", "source")), *(pa.array(np.add.reduceat(batch[k].to_numpy(), starts)) for k in ("n_docs", "count"))], names=["lang", "term", "source", "n_docs", "count"])


def _keep_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (lang, term) that hold three documents or more: each source's count, the language's, and 1 at one row of a run."""
    for batch, starts in _whole_runs(batches, ["lang", "term"]):
        lengths = np.diff(np.append(starts, batch.num_rows))
        kept = np.repeat(np.add.reduceat(batch["n_docs"].to_numpy(), starts) >= LEAST_DOCUMENTS, lengths)
        first = np.zeros(batch.num_rows, np.int32)
        first[starts] = 1
        total = np.repeat(np.add.reduceat(batch["count"].to_numpy(), starts), lengths)
        out = pa.RecordBatch.from_arrays([batch["lang"], batch["term"], batch["source"], batch["count"], pa.array(total), pa.array(first)], names=["lang", "term", "source", "count", "total", "first"])
        yield out.filter(pa.array(kept))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _common_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (lang, term): for pairs of sources that hold the term, what it adds beyond each source's own share; summed a batch."""
    for batch, starts in _whole_runs(batches, ["lang", "term"]):
        lengths = np.diff(np.append(starts, batch.num_rows))
        p, p0 = batch["p"].to_numpy(), batch["p0"].to_numpy()
        langs, sources = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
        lang, source = langs.indices.to_numpy().astype(np.int64), sources.indices.to_numpy().astype(np.int64)
        n = len(sources.dictionary)
        begin, size = np.repeat(starts, lengths), np.repeat(lengths, lengths)  # of each row's run
        reach = np.cumsum(size)
        at = 0
        while at < batch.num_rows:  # rows whose runs make about PAIRS_AT_ONCE pairs
            stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            a = np.repeat(np.arange(at, stop), size[at:stop])
            b = np.repeat(begin[at:stop] - (np.cumsum(size[at:stop]) - size[at:stop]), size[at:stop]) + np.arange(len(a))
            a, b = a[a != b], b[a != b]
            value = _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b])
            key, where = np.unique((lang[a] * n + source[a]) * n + source[b], return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, where, value)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // (n * n))), sources.dictionary.take(pa.array(key // n % n)), sources.dictionary.take(pa.array(key % n)), pa.array(sums)], names=["lang", "source", "item", "value"])
            at = stop


def _p(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (n + v)), in three steps of a thousand, so that no product leaves 64 bits."""
    whole, rest, among = F.lit(0).cast("long"), count + 1, n + v
    for _ in range(3):
        whole, rest = whole * 1000 + _div(rest * 1000, among), (rest * 1000) % among
    return whole + 1


def _difference(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def kept_counts(docs: DataFrame) -> DataFrame:
    """lang, term, source, count there, total in the language, first (1 at one row of each term) of all kept terms."""
    whole = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text"), whole("lang"), whole("source")).mapInArrow(_count_terms, "lang string, term string, source string, document long, n_docs long, count long")
    by_source = counted.repartition("lang", "term", "source").sortWithinPartitions("lang", "term", "source", "document").mapInArrow(_add_up, "lang string, term string, source string, n_docs long, count long")
    return by_source.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_keep_terms, "lang string, term string, source string, count long, total long, first int")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: the other sources of a language by divergence, and a source's strongest terms."""
    entries = cut(kept_counts(docs), "divergence-terms")
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    langs = entries.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("count").alias("n_lang"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("long")
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"), F.coalesce("n_lang", zero).alias("n_lang"))
    p0 = F.when(F.col("v") > 0, _p(zero, F.col("n"), F.col("v")))
    groups = cut(groups.withColumn("p0", p0), "divergence-groups")

    scored = entries.join(groups, ["lang", "source"]).select("lang", "term", "source", "count", _p(F.col("count"), F.col("n"), F.col("v")).alias("p"), "p0", _p(F.col("total"), F.col("n_lang"), F.col("v")).alias("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = scored.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _difference(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP_TERMS)

    common = scored.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_common_terms, "lang string, source string, item string, value long")
    # terms of a source that the other one lacks: by how many terms have each p
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    shares = scored.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms")).join(other, "lang").filter(F.col("source") != F.col("item"))
    p, p0, q0, h = (F.col(c) for c in ("p", "p0", "q0", "terms"))
    both = F.array(
        F.struct(F.col("source").alias("source"), F.col("item").alias("item"), (h * (_difference(p, q0) - _difference(p0, q0))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (h * (_difference(q0, p) - _difference(q0, p0))).alias("value")),
    )
    shares = shares.select("lang", F.inline(both))
    base = groups.join(other, "lang").filter(F.col("source") != F.col("item")).select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _difference(F.col("p0"), F.col("q0"))).otherwise(zero).alias("value"))
    pairs = base.unionByName(shares).unionByName(common).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return pairs.unionByName(terms)
