"""Helpers the operators of this subpackage share: word splitting, hashing, shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.shared import cut, fresh_path, release  # noqa: F401

#: Odd multipliers of the two rolling hashes.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)

#: Text handled at once inside a task, in bytes.
SLICE_BYTES = 1 << 20
#: Text of one shard, in bytes: what one task of a sharded operator holds.
SHARD_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds at most about ``limit`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text.

    Returns the code of each word, in order; where each text's words begin (one more at the
    end); the distinct words. A null text has no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    filled = np.asarray(pc.binary_length(coded.dictionary), dtype=np.int64) > 0
    if not filled.all():
        keep = filled[codes]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, offsets, coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word: the sum of what its bytes and their places hash to."""
    array = words.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    lengths = np.diff(offsets)
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix((place * 256 + data + 1).astype(np.uint64)))])
    at = offsets - offsets[0]
    return mix(sums[at[1:]] - sums[at[:-1]] + lengths.astype(np.uint64) * MULTIPLIER)


def rolling(hashes: np.ndarray, width: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Polynomial hash of each run of ``width`` hashes, by doubling; run i starts at i."""
    out, have, block, size = None, 0, hashes, 1
    while True:
        if width & size:
            if out is None:
                out = block
            else:
                n = len(hashes) - have - size + 1
                out = out[: max(n, 0)] * pow_u64(multiplier, size) + block[have : have + max(n, 0)]
            have += size
        if have == width:
            return mix(out)
        n = max(len(block) - size, 0)
        block = block[:n] * pow_u64(multiplier, size) + block[size : size + n]
        size *= 2


def pow_u64(base: np.uint64, exponent: int) -> np.uint64:
    return np.uint64(pow(int(base), exponent, 1 << 64))


def positions(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its place in its text, and the index of that text."""
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return np.arange(offsets[-1]) - offsets[:-1][owner], owner


def runs(*keys: np.ndarray) -> np.ndarray:
    """For sorted key columns: true where a run of equal rows begins."""
    first = np.ones(len(keys[0]), dtype=bool)
    if len(first) > 1:
        first[1:] = False
        for key in keys:
            first[1:] |= key[1:] != key[:-1]
    return first


def sharded(docs: DataFrame, n_shards: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the shard that a document belongs to, and the columns in ``keep`` as _keep_ and their name."""
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int").alias("shard"), *(F.col(c).alias(f"_keep_{c}") for c in keep))


def shard_count(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards that hold about ``shard_bytes`` of text each; it grows with the input."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // shard_bytes))


def bucket_slices(keys: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of sorted 64-bit keys dealt by their top bits."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    starts = np.flatnonzero(runs(bucket)) if len(bucket) else np.zeros(0, dtype=np.int64)
    stops = np.append(starts[1:], len(bucket))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(starts, stops)]


def planes(array: np.ndarray) -> bytes:
    """An array's bytes, the first of every number, then the second and so on: sorted or small numbers compress."""
    return np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.dtype.itemsize).T.tobytes()


def unplanes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(dtype).ravel()
