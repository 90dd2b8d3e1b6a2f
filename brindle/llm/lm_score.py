"""Stupid-backoff language-model scores, computed relationally.

score(w | context) = count(context w) / count(context) where count(context w) >= ``cutoff``,
else ``backoff`` times the score under the context without its first word; at last count(w) / N.
Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; n-grams do not cross documents.

``lm_scores`` keeps relations in blocks. Each shard of whole documents explodes into its distinct
n-grams with their counts (the map-side combine), one block for each hash bucket. A bucket sums the counts of all
shards - one partition of the corpus-wide count table - and the join gives each shard's n-grams their counts back
(a bit for those that occur once in the corpus, a number for the others); the counts meet the
shard's documents again, every token of a document looks its n-grams up, and the logarithms are
summed per document. Nothing passes through the driver and a frequent n-gram travels once a shard.

``lm_scores_by_rows`` is the same with a row for every n-gram and joins of Spark. Since log scores add up, an n-gram
that occurs ``cutoff`` times is worth a constant more than its backoff, and a document's score is the sum
over its n-grams of what the joined tables give. It shuffles a row for every n-gram of every document, so it costs far more disk.

Defined cases: a null or empty text has no words, a sum of 0.0 and a null mean; a repeated row
counts and is returned as often as it occurs; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bucket_slices, cut, mix, planes, positions, rolling, runs, shard_count, sharded, split_words, unplanes, word_hashes

#: Key under which a shard sends its number of words.
TOTAL = np.uint64(0)
#: Text of one shard, in bytes.
SHARD_BYTES = 5 << 20


def _ngrams(texts: pa.Array, order: int, shift: int):
    """Offsets, and for each n the n-gram keys by start, with where they lie within a document."""
    codes, offsets, words = split_words(texts)
    hashes = mix(word_hashes(words))[codes] if len(codes) else np.zeros(0, np.uint64)
    place, owner = positions(offsets)
    left = offsets[1:][owner] - np.arange(len(codes))
    grams = []
    for n in range(1, order + 1):
        if len(hashes) < n:
            grams.append((np.zeros(0, np.uint64), np.zeros(0, bool)))
            continue
        key = ((mix(rolling(hashes, n) + np.uint64(n)) >> np.uint64(shift)) | np.uint64(1)) << np.uint64(shift)  # never TOTAL
        grams.append((key, (left >= n)[: len(key)]))
    return offsets, place, owner, grams


def _keys(grams, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a shard, sorted, and their counts."""
    keys = np.concatenate([k[ok] for k, ok in grams])
    keys.sort()
    first = np.flatnonzero(runs(keys)) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    return np.concatenate([[TOTAL], keys[first]]), np.concatenate([[n_words], counts]).astype(np.int64)


def _pack(keys: np.ndarray, bucket: int, n_buckets: int, shift: int) -> bytes:
    """Sorted keys of a bucket as the gaps between them: four bytes each, and what is above compressed."""
    low = np.uint64(-(-(bucket << 32) // n_buckets) << 32)
    gaps = np.diff((keys - low) >> np.uint64(shift), prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(gaps[:, :4].T).tobytes() + zlib.compress(np.ascontiguousarray(gaps[:, 4:].T).tobytes(), 1)


def _unpack(data: bytes, n: int) -> np.ndarray:
    """Keys from the beginning of their bucket."""
    gaps = np.frombuffer(data[: 4 * n] + zlib.decompress(data[4 * n :]), np.uint8).reshape(8, n).T
    return np.cumsum(np.ascontiguousarray(gaps).view("<u8").ravel(), dtype=np.uint64)


def lm_scores(docs: DataFrame, order: int = 3, cutoff: int = 2, backoff: float = 0.4, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, log10_score (sum over its words), mean_log10."""
    n_shards = shard_count(docs, shard_bytes)
    n_buckets = max(1, n_shards * order // 2)
    shift = max(0, 17 - int(math.log2(n_buckets)))  # 47 bits of a key within its bucket
    texts = sharded(docs, n_shards)

    def emit(key: tuple, table: pa.Table) -> pa.Table:
        offsets, _, _, grams = _ngrams(table["text"], order, shift)
        keys, counts = _keys(grams, int(offsets[-1]))
        rows = bucket_slices(keys, n_buckets)
        return pa.table({
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()), "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()), "n": pa.array([b - a for _, a, b in rows], pa.int32()),
            "grams": pa.array([_pack(keys[a:b], bucket, n_buckets, shift) for bucket, a, b in rows], pa.binary()), "counts": pa.array([planes(counts[a:b]) for _, a, b in rows], pa.binary()),
        })

    def count(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_unpack(x, n) for x, n in zip(table["grams"].to_pylist(), table["n"].to_pylist())]
        keys = np.concatenate(parts)
        counts = np.concatenate([unplanes(x, np.int64) for x in table["counts"].to_pylist()])
        order_ = np.argsort(keys)
        first = np.flatnonzero(runs(keys[order_]))
        sums = np.add.reduceat(counts[order_], first)
        total = np.empty(len(keys), dtype=np.int64)
        total[order_] = np.repeat(sums, np.diff(np.append(first, len(keys))))
        stops = np.cumsum([len(p) for p in parts])
        own = [total[b - len(p) : b] for p, b in zip(parts, stops)]
        return pa.table({
            "shard": table["shard"].cast(pa.int32()), "bucket": pa.array([key[0].as_py()] * len(parts), pa.int32()), "many": pa.array([np.packbits(t > 1).tobytes() for t in own], pa.binary()),
            "totals": pa.array([planes(t[t > 1]) for t in own], pa.binary()),
        })

    def score(key: tuple, docs_: pa.Table, answers: pa.Table) -> pa.Table:
        offsets, place, owner, grams = _ngrams(docs_["text"], order, shift)
        keys, _ = _keys(grams, int(offsets[-1]))
        by_bucket = {b: (m, t) for b, m, t in zip(*(answers[c].to_pylist() for c in ("bucket", "many", "totals")))}
        totals = np.ones(len(keys), dtype=np.int64)
        for bucket, a, b in bucket_slices(keys, n_buckets):
            many, some = by_bucket[bucket]
            totals[a:b][np.unpackbits(np.frombuffer(many, np.uint8), count=b - a).astype(bool)] = unplanes(some, np.int64)
        counts = [totals[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] for k, _ in grams]
        n_all = int(totals[0]) if keys[0] == TOTAL else 1
        value = counts[0] / max(n_all, 1)
        for n in range(2, order + 1):
            if not len(counts[n - 1]):
                continue
            at = np.flatnonzero(place >= n - 1)
            seen = counts[n - 1][at - n + 1]
            value[at] = np.where(seen >= cutoff, seen / counts[n - 2][at - n + 1], backoff * value[at])
        sums = np.bincount(owner, weights=np.log10(value), minlength=docs_.num_rows)
        n_words = np.diff(offsets)
        mean = np.divide(sums, n_words, out=np.zeros(len(sums)), where=n_words > 0)
        return pa.table({
            "doc_id": docs_["doc_id"].cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "log10_score": pa.array(sums, pa.float64()),
            "mean_log10": pa.array(mean, pa.float64(), mask=n_words == 0),
        })

    listed = texts.groupBy("shard").applyInArrow(emit, "bucket int, shard int, n int, grams binary, counts binary")
    answers = listed.groupBy("bucket").applyInArrow(count, "shard int, bucket int, many binary, totals binary")
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(score, "doc_id long, n_words long, log10_score double, mean_log10 double")


def lm_scores_by_rows(docs: DataFrame, order: int = 3, cutoff: int = 2, backoff: float = 0.4) -> DataFrame:
    """The same scores from tables of a row an n-gram, exploded, counted and joined by Spark."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = cut(docs.select("doc_id", words.alias("ws")).withColumn("row", F.monotonically_increasing_id()), "rows")
    n_all = rows.agg(F.sum(F.size("ws"))).first()[0] or 1
    cost = math.log10(backoff)

    def grams(n: int) -> DataFrame:
        """row, gram, head, tail and how often: the n-grams of every document, with those without the last and the first word."""
        at = F.filter(F.transform("ws", lambda w, i: i + 1), lambda i: i <= F.size("ws") - (n - 1))
        run = lambda i, k, m: F.xxhash64(F.slice("ws", i + k, F.lit(m)), F.lit(m))
        one = F.explode(F.transform(at, lambda i: F.struct(run(i, 0, n).alias("gram"), run(i, 0, n - 1).alias("head"), run(i, 1, n - 1).alias("tail"))))
        return rows.select("row", one.alias("g")).groupBy("row", "g").agg(F.count("*").alias("times")).select("row", "g.*", "times")

    lists = [grams(n) for n in range(1, order + 1)]
    counts = [x.groupBy("gram").agg(F.sum("times").alias("c"), F.any_value("head").alias("head"), F.any_value("tail").alias("tail")) for x in lists]
    worth = cut(counts[0].select("gram", "c", F.log10(F.col("c") / n_all).alias("own"), F.log10(F.col("c") / n_all).alias("gain")), "worth")
    parts = [lists[0].join(worth, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("gain")).alias("s"))]
    for n in range(2, order + 1):
        frequent = counts[n - 1].filter(F.col("c") >= cutoff)
        heads, tails = worth.select(F.col("gram").alias("head"), F.col("c").alias("c_head")), worth.select(F.col("gram").alias("tail"), F.col("own").alias("own_tail"))
        own = F.log10(F.col("c") / F.col("c_head"))
        worth = cut(frequent.join(heads, "head").join(tails, "tail").select("gram", "c", own.alias("own"), (own - F.col("own_tail") - F.lit(cost)).alias("gain")), "worth")
        parts.append(lists[n - 1].join(worth, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("gain")).alias("s")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("s").alias("s"))
    # what a document's words cost where no longer n-gram is frequent
    backed = reduce(lambda a, b: a + b, (F.greatest(F.size("ws") - k, F.lit(0)) for k in range(1, order)), F.lit(0)) * cost
    out = rows.select("row", "doc_id", F.size("ws").cast("long").alias("n_words"), backed.alias("backed")).join(sums, "row", "left")
    total = F.coalesce("s", F.lit(0.0)) + F.col("backed")
    return out.select("doc_id", "n_words", total.alias("log10_score"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log10"))
