"""Substring deduplication by difference-cover anchors.

A window of ``window`` consecutive words is removed where its word sequence also starts earlier
(smaller doc_id, or same document, earlier start). Anchors are runs of ``window - period + 1``
words, hashed only where their place in the document, modulo the period, lies in a difference
cover. For any two places some shift below the period takes both into the cover, so two equal
windows share an aligned anchor. Windows around an anchor that occurs once are never looked at;
the others are extended to whole windows, hashed (96 bits) and the earliest of each is found.

The work is done in three passes over shards of whole documents (one shuffle of the text, which
Spark reuses); between the passes only hashes travel, dealt into buckets by their top bits and
combined per shard beforehand, so a passage of a third of all documents sends one hash a shard.

Defined cases: a null or empty text has no words and keeps none; documents shorter than the window
keep every word; rows that repeat a doc_id count as documents of their own, ordered by text; a null
doc_id comes before all others; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.llm.common import SECOND, SHARD_BYTES, bucket_slices, mix, planes, positions, rolling, runs, shard_count, sharded, split_words, unplanes, word_hashes

#: Difference covers: period -> places. Fixed values of the planar difference sets.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: 8-byte keys that one bucket holds at about this number, and bytes of a word with what parts it from the next.
BUCKET_KEYS, WORD_BYTES = 1_000_000, 6

_REPLY = "shard int, kind int, bucket int, bits binary"


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor width for a window: the longest period that leaves a third of it as anchor."""
    period = max((p for p in COVERS if 3 * (window - p + 1) >= window), default=0)
    if not period:
        return 1, (0,), window
    return period, COVERS[period], window - period + 1


class Shard:
    """The words of one shard's documents, in the order of doc_id."""

    def __init__(self, table: pa.Table, window: int):
        ids = table["doc_id"].combine_chunks() if isinstance(table["doc_id"], pa.ChunkedArray) else table["doc_id"]
        lowest = np.iinfo(np.int64).min
        texts = pc.fill_null(table["text"].combine_chunks(), "")
        keys = pa.table({"id": pc.fill_null(ids.cast(pa.int64()), lowest), "text": texts})
        order = pc.sort_indices(keys, [("id", "ascending"), ("text", "ascending")])
        self.order = order
        self.ids, self.sort_ids = ids.take(order), keys["id"].take(order).to_numpy()
        self.codes, self.offsets, self.words = split_words(texts.take(order))
        self.place, self.owner = positions(self.offsets)
        self.hashes = mix(word_hashes(self.words))[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        self.window = window
        self.n = len(self.codes)

    def starts(self, width: int) -> np.ndarray:
        """True where ``width`` words of one document begin."""
        left = self.offsets[1:][self.owner] - np.arange(self.n)
        return (left >= width)[: max(self.n - width + 1, 0)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors begin, and their hashes."""
        period, cover, width = cover_for(self.window)
        inside = np.zeros(period, dtype=bool)
        inside[list(cover)] = True
        ok = self.starts(width)
        at = np.flatnonzero(ok & inside[self.place[: len(ok)] % period])
        return at, (rolling(self.hashes, width)[at] if len(at) else np.zeros(0, np.uint64))

    def windows(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor of the given starts."""
        period = cover_for(self.window)[0]
        ok = self.starts(self.window)
        seen = np.zeros(self.n + 1, dtype=np.int64)
        seen[repeated + 1] = 1
        seen = np.cumsum(seen)
        start = np.flatnonzero(ok)
        return start[seen[start + period] > seen[start]]


def _sorted(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the earlier place first among equals) and the beginnings of runs."""
    order = np.lexsort(keys[::-1])
    return order, runs(*(k[order] for k in keys))


def _pack_anchors(table: pa.Table, window: int):
    """A shard, its anchors' starts and hashes, the distinct hashes and which of them occur more than once."""
    shard = Shard(table, window)
    at, hashes = shard.anchors()
    keys = np.sort(hashes)
    first = np.flatnonzero(runs(keys)) if len(keys) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(keys))) > 1
    return shard, at, hashes, keys[first], many


def _flags(replies: pa.Table, kind: int, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bits that the buckets sent back, for this shard's sorted keys."""
    out = np.zeros(len(keys), dtype=bool)
    bits = {b: x for k, b, x in zip(*(replies[c].to_pylist() for c in ("kind", "bucket", "bits"))) if k == kind}
    for bucket, a, b in bucket_slices(keys, n_buckets):
        if bucket in bits:
            out[a:b] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=b - a).astype(bool)
    return out


def _candidates(docs: pa.Table, replies: pa.Table, window: int, n_buckets: int):
    """A shard's windows around repeated anchors: starts, and their distinct hashes with the first of each."""
    shard, at, hashes, keys, _ = _pack_anchors(docs, window)
    flags = _flags(replies, 1, keys, n_buckets)
    if len(at):
        at = at[flags[np.searchsorted(keys, hashes)]]
    start = shard.windows(at) if len(at) else np.zeros(0, np.int64)
    one = rolling(shard.hashes, window)[start] if len(start) else np.zeros(0, np.uint64)
    two = (rolling(shard.hashes, window, SECOND)[start] >> np.uint64(32)).astype(np.uint32) if len(start) else np.zeros(0, np.uint32)
    order, first = _sorted(one, two) if len(start) else (np.zeros(0, np.int64), np.zeros(0, bool))
    group = np.empty(len(start), dtype=np.int64)
    group[order] = np.cumsum(first) - 1
    return shard, start, group, one[order][first], two[order][first], order[first]


def windows_table(docs: DataFrame, window: int = 20, with_text: bool = False, shard_bytes: int = SHARD_BYTES, keep: tuple[str, ...] = (), bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the text left) and the columns in ``keep``.

    The kept words are joined by one space; ``kept`` is the text itself where nothing is removed.
    """
    n_shards = shard_count(docs, shard_bytes)
    period, cover, _ = cover_for(window)
    n_buckets = max(1, n_shards * shard_bytes * len(cover) // (WORD_BYTES * period * bucket_keys))
    texts = sharded(docs, n_shards, keep)

    def emit_anchors(key: tuple, table: pa.Table) -> pa.Table:
        _, _, _, keys, many = _pack_anchors(table, window)
        rows = bucket_slices(keys, n_buckets)
        return pa.table({
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()), "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "keys": pa.array([planes(keys[a:b]) for _, a, b in rows], pa.binary()),
            "many": pa.array([np.packbits(many[a:b]).tobytes() for _, a, b in rows], pa.binary()),
        })

    def find_repeated(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unplanes(x, np.uint64) for x in table["keys"].to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table["many"].to_pylist(), parts)]).astype(bool)
        keys = np.concatenate(parts)
        order = np.argsort(keys)
        group = np.cumsum(runs(keys[order])) - 1
        repeated = np.bincount(group, weights=1 + many[order]) > 1
        flag = np.empty(len(keys), dtype=bool)
        flag[order] = repeated[group]
        return _reply(table, key, parts, flag, 1)

    def emit_windows(key: tuple, docs_: pa.Table, replies: pa.Table) -> pa.Table:
        shard, start, _, one, two, first = _candidates(docs_, replies, window, n_buckets)
        ids = shard.sort_ids[shard.owner[start[first]]]
        rows = bucket_slices(one, n_buckets)
        return pa.table({
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()), "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "one": pa.array([planes(one[a:b]) for _, a, b in rows], pa.binary()), "two": pa.array([planes(two[a:b]) for _, a, b in rows], pa.binary()),
            "ids": pa.array([planes(ids[a:b]) for _, a, b in rows], pa.binary()),
        })

    def find_first(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unplanes(x, np.uint64) for x in table["one"].to_pylist()]
        one = np.concatenate(parts)
        two = np.concatenate([unplanes(x, np.uint32) for x in table["two"].to_pylist()])
        ids = np.concatenate([unplanes(x, np.int64) for x in table["ids"].to_pylist()])
        order = np.lexsort((ids, two, one))
        flag = np.empty(len(one), dtype=bool)
        flag[order] = ~runs(one[order], two[order])
        return _reply(table, key, parts, flag, 2)

    def decide(key: tuple, docs_: pa.Table, replies: pa.Table) -> pa.Table:
        shard, start, group, one, _, first = _candidates(docs_, replies, window, n_buckets)
        own = np.zeros(len(start), dtype=bool)
        own[first] = True
        elsewhere = _flags(replies, 2, one, n_buckets)
        gone = start[elsewhere[group] | ~own] if len(start) else start
        change = np.zeros(shard.n + 1, dtype=np.int64)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + window, -1)
        kept = np.cumsum(change)[: shard.n] == 0
        left = np.concatenate([[0], np.cumsum(kept)])[shard.offsets]
        words = shard.words.take(pa.array(shard.codes[kept]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words), " ")
        n_words = np.diff(shard.offsets)
        out = {
            "doc_id": shard.ids.cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_words - np.diff(left), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in joined.cast(pa.binary()).to_pylist()], pa.string()),
        }
        if with_text:
            out["kept"] = pc.if_else(pa.array(n_words == np.diff(left)), pc.fill_null(docs_["text"].combine_chunks().take(shard.order), ""), joined)
        for name in keep:
            out[name] = docs_[f"_keep_{name}"].take(shard.order)
        return pa.table(out)

    anchors = texts.groupBy("shard").applyInArrow(emit_anchors, "bucket int, shard int, keys binary, many binary")
    repeated = anchors.groupBy("bucket").applyInArrow(find_repeated, _REPLY)
    found = texts.groupBy("shard").cogroup(repeated.groupBy("shard")).applyInArrow(emit_windows, "bucket int, shard int, one binary, two binary, ids binary")
    earliest = found.groupBy("bucket").applyInArrow(find_first, _REPLY)
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    for name in keep:
        schema = schema.add(name, docs.schema[name].dataType)
    return texts.groupBy("shard").cogroup(repeated.unionByName(earliest).groupBy("shard")).applyInArrow(decide, schema)


def _reply(table: pa.Table, key, parts: list[np.ndarray], flag: np.ndarray, kind: int) -> pa.Table:
    """Each shard's flags, in the order of the keys it sent."""
    stops = np.cumsum([len(p) for p in parts])
    return pa.table({
        "shard": table["shard"].cast(pa.int32()), "kind": pa.array([kind] * len(parts), pa.int32()), "bucket": pa.array([key[0].as_py()] * len(parts), pa.int32()),
        "bits": pa.array([np.packbits(flag[b - len(p) : b]).tobytes() for p, b in zip(parts, stops)], pa.binary()),
    })


def dedup_substrings(docs: DataFrame, window: int = 20, with_text: bool = False, shard_bytes: int = SHARD_BYTES, keep: tuple[str, ...] = (), bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier.

    Returns one row per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one
    space, lowercase hex) and, with ``with_text``, kept; then the columns in ``keep``, unchanged. See
    the module for the defined cases.
    """
    return windows_table(docs, window, with_text, shard_bytes, keep, bucket_keys)
