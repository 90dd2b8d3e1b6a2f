"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A is a byte-level tokenizer that is given a space and the text, B a SentencePiece model that adds the space
itself. Every token gives an event, the byte offset where it ends. Events of A and of B are rows of one table,
dealt by document and sorted by offset; a sweep over them keeps the tokens since the last offset where
both ended. Such an offset closes a group; between two neighbouring end offsets one A and one B token overlap,
which is a link. Links are counted over the corpus, and each document sums the counts of its own.

What bounds memory and traffic: an event row holds a run of at most ``BLOCK`` events of one side of a document
(first offset, ids and lengths, compressed), so that a token costs about two bytes of shuffle; the sweep holds the
events that it works on (``SWEPT`` or one document's blocks up to their last common end) and the distinct links of
the open document. Link counts are combined before they are shuffled. The commonest id pairs (at most ``COMMON``
of them, chosen by their counts) are broadcast to the documents' links, the others are joined by a shuffle;
the best count of each B id has a row for each entry of B's vocabulary.

Tokens are looked up by the stretches between single spaces, where both tokenizers begin anew, and remembered
by each worker; documents with other spacing (runs of spaces, a space beside other white space) are encoded whole, as
are all documents if a tokenizer does not begin anew there.

Defined cases: a text that is null, empty, or whose joined A or B bytes are not those of space and text (it holds U+2581,
say) has no tokens: all numbers are 0 and groups_sha256 is ''. Every row of the table is a document of its own, so
repeated rows and equal or null doc_ids are each returned and counted; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut, planes, slices, unplanes
from brindle.llm.pieces import MARK, piece_model

#: Events of one side in a row, and events that a sweep works on at once.
BLOCK, SWEPT = 4096, 400_000
#: Id pairs that are broadcast.
COMMON = 1 << 20
#: Stretches that a worker remembers.
MEMO = 300_000
A, B, OPENING = 0, 1, -1

#: A space that is not followed by a character which is surely none of Unicode's spaces (these begin with the bytes named).
_ODD = re.compile(rb" (?:[\x00-\x20\xc2\xe1\xe2\xe3]|\Z)")


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself where it is one, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Side(NamedTuple):
    """A tokenizer's encoder of many texts, and the bytes of each of its tokens."""

    encode: object
    surface: list[bytes]
    apart: bool  # it begins anew at a single space


def _side_a(path: str) -> Side:
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before, byte = spec.get("pre_tokenizer") or {}, _byte_of_character()
    surface = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        surface[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    apart = not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return Side(lambda texts: [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], surface, apart)


def _side_b(path: str) -> Side:
    model = piece_model(path)
    return Side(lambda texts: model.processor.encode(texts, num_threads=1), [s if b else s.replace(MARK, b" ") for s, b in zip(model.surface, model.is_byte)], model.segmented)


class _Table:
    """Ids and token lengths of many stretches, one after another."""

    def __init__(self, side: Side):
        self.side, self.lengths = side, np.array([len(s) for s in side.surface], np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.counts, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: list[str], data: list[bytes]) -> np.ndarray:
        """Whether each text's tokens make up space and text."""
        found = self.side.encode(texts)
        counts = np.array([len(x) for x in found], np.int64)
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())))
        self.counts = np.append(self.counts, counts)
        surface = self.side.surface
        return np.array([b"".join([surface[i] for i in ids]) == b" " + d for ids, d in zip(found, data)], bool)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the stretches named, and how many each has."""
        counts = self.counts[at]
        ends = np.cumsum(counts)
        place = np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[place], counts


class Aligner:
    """Two tokenizers, and what this worker remembers of them."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = _Table(_side_a(a_path)), _Table(_side_b(b_path))
        self.apart = all(t.side.apart for t in self.sides)
        self.memo: dict[bytes, int] = {}
        self.good = np.zeros(0, bool)

    def _add(self, data: list[bytes]) -> None:
        texts = [d.decode("utf-8", "replace") for d in data]
        good = [t.add(texts, data) for t in self.sides]
        self.good = np.append(self.good, good[0] & good[1])

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Of each text whether it has tokens; for A and B the ids of all, and how many each text has."""
        if len(self.memo) > MEMO or len(self.sides[0].ids) > 16 * MEMO:
            self.memo, self.good = {}, self.good[:0]
            for t in self.sides:
                t.clear()
        parts: list[list[bytes]] = [[] if not d else [d] if not self.apart or _ODD.search(b" " + d) else d.split(b" ") for d in texts]
        memo = self.memo
        new = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in memo]
        if new:
            memo.update(zip(new, range(len(self.good), len(self.good) + len(new))))
            self._add(new)
        sizes = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter((memo[p] for p in chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        has = (sizes > 0) & (np.bincount(owner[~self.good[at]], minlength=len(texts)) == 0)
        keep = has[owner]
        at, owner = at[keep], owner[keep]
        out = []
        for table in self.sides:
            ids, counts = table.gather(at)
            out.append((ids, np.bincount(owner, counts, len(texts)).astype(np.int64)))
        return has, out


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker and pair of tokenizers."""
    return Aligner(a_path, b_path)


_CODEC = "zstd"


def _pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    return pa.compress(planes(ids.astype("<u4")) + planes(lengths.astype("<u4")), codec=_CODEC, asbytes=True)


def _unpack(block: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    data = pa.decompress(block, 8 * n, codec=_CODEC, asbytes=True)
    return unplanes(data[: 4 * n], np.uint32), unplanes(data[4 * n :], np.uint32)


_EVENTS = "row long, offset long, side int, doc_id long, n int, block binary"
_EVENTS_ARROW = pa.schema([("row", pa.int64()), ("offset", pa.int64()), ("side", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("block", pa.binary())])


def events(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """End events of both tokenizers: row (a number of the document), offset (first end of the block), side, n, block; and a row that opens each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = batch["row"].to_numpy()
                _, sides = both.tokens([t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()])
                n = len(rows)
                out: list[list] = [rows.tolist(), [-1] * n, [OPENING] * n, batch["doc_id"].to_pylist(), [0] * n, [b""] * n]
                for side, (ids, counts) in enumerate(sides):
                    lengths, ends = both.sides[side].lengths[ids], np.cumsum(counts)
                    for k in np.flatnonzero(counts):
                        offset = 0
                        for start in range(int(ends[k] - counts[k]), int(ends[k]), BLOCK):
                            stop = min(start + BLOCK, int(ends[k]))
                            for column, x in zip(out, (int(rows[k]), offset + int(lengths[start]), side, None, stop - start, _pack(ids[start:stop], lengths[start:stop]))):
                                column.append(x)
                            offset += int(lengths[start:stop].sum())
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _EVENTS_ARROW)], schema=_EVENTS_ARROW)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _EVENTS)


class _Open:
    """A document in the sweep: events not swept yet, and what the swept ones came to."""

    def __init__(self, row: int, doc_id: int | None):
        self.row, self.doc_id = row, doc_id
        self.ids: list[list[np.ndarray]] = [[], []]
        self.lengths: list[list[np.ndarray]] = [[], []]
        self.pending = self.n_groups = self.n_links = 0
        self.n = [0, 0]
        self.hash = hashlib.sha256()
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, side: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids[side].append(ids)
        self.lengths[side].append(lengths)
        self.n[side] += len(ids)
        self.pending += len(ids)

    def take(self, whole: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and ends of A and B up to their last common end; what lies behind stays."""
        got = []
        for side in (A, B):
            ids, lengths = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (self.ids[side], self.lengths[side]))
            got.append((ids, np.cumsum(lengths, dtype=np.int64), lengths))
        self.ids, self.lengths = [[], []], [[], []]
        if not whole:
            common = np.intersect1d(got[A][1], got[B][1], assume_unique=True)
            last = common[-1] if len(common) else 0
            for side in (A, B):
                ids, ends, lengths = got[side]
                k = int(np.searchsorted(ends, last, side="right"))
                self.ids[side], self.lengths[side] = [ids[k:]], [lengths[k:]]
                got[side] = ids[:k], ends[:k], lengths[:k]
        self.pending = sum(len(x) for side in self.ids for x in side)
        return [(ids, ends) for ids, ends, _ in got]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.links) == 1:
            return self.links[0]
        pairs, where = np.unique(np.concatenate([p for p, _ in self.links] or [np.zeros(0, np.int64)]), return_inverse=True)
        return pairs, np.bincount(where, np.concatenate([t for _, t in self.links] or [np.zeros(0)]), len(pairs)).astype(np.int64)


class _Decimal:
    """Ids as decimal digits, each with a separator behind it."""

    def __init__(self, size: int):
        texts = [str(i).encode() for i in range(size)]
        self.width = max(map(len, texts)) + 1
        self.table = np.frombuffer(b"".join(t.ljust(self.width, b"\0") for t in texts), np.uint8).reshape(size, self.width)
        self.length = np.array([len(t) for t in texts])

    def __call__(self, ids: np.ndarray, separators: np.ndarray) -> tuple[bytes, np.ndarray]:
        rows, n = self.table[ids], self.length[ids]
        rows[np.arange(len(ids)), n] = separators
        return rows[rows != 0].tobytes(), np.cumsum(n + 1)


def _sweep(docs: list[_Open], whole: list[bool], n_b: int, decimal: _Decimal) -> None:
    """Groups and links of the events at hand, those of all documents on one line, one document behind the other."""
    taken = [d.take(w) for d, w in zip(docs, whole)]
    size = np.array([t[A][1][-1] if len(t[A][1]) else 0 for t in taken], np.int64)
    base = np.cumsum(size) - size
    ids = [np.concatenate([t[s][0] for t in taken]).astype(np.int64) for s in (A, B)]
    ends = [np.concatenate([t[s][1] + b for t, b in zip(taken, base)]) for s in (A, B)]
    counts = [np.array([len(t[s][0]) for t in taken]) for s in (A, B)]
    if not len(ends[A]):
        return
    events_ = np.sort(np.concatenate(ends), kind="stable")  # two sorted runs: a merge
    events_ = events_[np.append(True, events_[1:] != events_[:-1])]
    at = [np.searchsorted(e, events_) for e in ends]  # the tokens that cover what lies before each end
    common = np.flatnonzero((ends[A][at[A]] == events_) & (ends[B][at[B]] == events_))
    owner = np.repeat(np.arange(len(docs)), np.diff(np.searchsorted(events_, np.append(0, base + size), side="right")))
    # links of each document
    width = np.int64(len(decimal.table)) * n_b
    found, times = np.unique(owner * width + ids[A][at[A]] * n_b + ids[B][at[B]], return_counts=True)
    cuts = np.searchsorted(found, np.arange(len(docs) + 1) * width)
    groups = np.bincount(owner[common], minlength=len(docs))
    links = np.bincount(owner, minlength=len(docs))
    # a group's A ids stand before its B ids
    upto = [at[s][common] + 1 for s in (A, B)]
    in_group = [np.repeat(np.arange(len(common)), np.diff(np.append(0, u))) for u in upto]
    place = [np.arange(len(ids[A])) + np.append(0, upto[B])[in_group[A]], np.arange(len(ids[B])) + upto[A][in_group[B]]]
    line, separators = np.zeros(len(ids[A]) + len(ids[B]), np.int64), np.full(len(ids[A]) + len(ids[B]), ord(","), np.uint8)
    for s, mark in ((A, "|"), (B, ";")):
        line[place[s]] = ids[s]
        separators[place[s][upto[s] - 1]] = ord(mark)
    text, stops = decimal(line, separators)
    stops = np.append(0, stops)[np.append(0, np.cumsum(counts[A] + counts[B]))]
    for k, doc in enumerate(docs):
        if stops[k + 1] > stops[k]:
            doc.hash.update((b";" if doc.n_groups else b"") + text[stops[k] : stops[k + 1] - 1])
            doc.n_groups += int(groups[k])
            doc.n_links += int(links[k])
            doc.links.append((found[cuts[k] : cuts[k + 1]] - k * width, times[cuts[k] : cuts[k + 1]]))


def _swept(sorted_events: DataFrame, n_a: int, n_b: int) -> DataFrame:
    small = n_a * n_b < 1 << 31
    kind = "int" if small else "long"
    schema = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<{kind}>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = _Decimal(max(n_a, n_b))
        docs: list[_Open] = []
        pending = 0

        def made(done: list[_Open]) -> pa.RecordBatch:
            links = [d.merged() for d in done]
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x[0]) for x in links])), pa.int32()), pa.array(np.concatenate([x[i] for x in links]), t)) for i, t in ((0, pa.int32() if small else pa.int64()), (1, pa.int32()))]
            numbers = [[d.row for d in done], [d.doc_id for d in done], [d.n[A] for d in done], [d.n[B] for d in done], [d.n_groups for d in done], [d.n_links for d in done]]
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array([d.hash.hexdigest() if d.n_groups else "" for d in done]), *lists], names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            for row, side, doc_id, n, block in zip(*(batch[c].to_pylist() for c in ("row", "side", "doc_id", "n", "block"))):
                if side == OPENING:
                    if pending >= SWEPT or len(docs) >= 10_000:
                        _sweep(docs, [True] * len(docs), n_b, decimal)
                        yield made(docs)
                        docs, pending = [], 0
                    docs.append(_Open(row, doc_id))
                    continue
                docs[-1].add(side, *_unpack(block, n))
                pending += n
                if docs[-1].pending >= 2 * SWEPT and docs[-1].n[B] * docs[-1].n[A]:  # a very long document goes piece by piece
                    _sweep(docs, [True] * (len(docs) - 1) + [False], n_b, decimal)
                    if len(docs) > 1:
                        yield made(docs[:-1])
                    docs = docs[-1:]
                    docs[0].links = [docs[0].merged()]
                    pending = docs[0].pending
        if docs:
            _sweep(docs, [True] * len(docs), n_b, decimal)
            yield made(docs)

    return sorted_events.mapInArrow(run, schema)


def sweep(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, its distinct links (pair: A id times B's size plus B id) and how often it has each (times)."""
    n_a, n_b = (len(s.surface) for s in (_side_a(a_path), _side_b(b_path)))
    dealt = events(docs, a_path, b_path).repartition("row").sortWithinPartitions("row", "offset", "side")
    return _swept(dealt, n_a, n_b)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    n_b = len(_side_b(b_path).surface)
    swept = cut(sweep(docs, a_path, b_path), "alignment-links")
    links = swept.select("row", F.inline(F.arrays_zip("pair", "times")))
    counts = cut(links.groupBy("pair").agg(F.sum("times").alias("count")), "alignment-pairs")
    most = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("count").alias("most"))  # a row for each B id
    counts = counts.join(F.broadcast(most), F.col("pair") % n_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    least = _least_common(counts)
    common, others = F.broadcast(counts.filter(F.col("count") >= least)), counts.filter(F.col("count") < least)
    sums = lambda met: met.select("row", (F.col("times") * F.col("count")).alias("count_sum"), (F.col("times") * F.col("best")).cast("long").alias("n_best"))
    both = sums(links.join(common, "pair")).unionByName(sums(links.join(common, "pair", "left_anti").join(others, "pair")))
    totals = both.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = F.lit(0).cast("long")
    numbers = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    return swept.select("row", *numbers, "groups_sha256").join(totals, "row", "left").select(*numbers, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def _least_common(counts: DataFrame) -> int:
    """The smallest power of two that at most COMMON id pairs reach with their counts."""
    power = F.length(F.bin("count")) - 1
    by_power = {r[0]: r[1] for r in counts.groupBy(power).count().collect()}  # some forty rows at most
    reached, least = 0, 63
    for k in sorted(by_power, reverse=True):
        reached += by_power[k]
        if reached > COMMON:
            break
        least = k
    return 1 << least if by_power else 1
