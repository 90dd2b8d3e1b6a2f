"""Offset-preserving SentencePiece encoding, and decoding.

A text is normalised by longest-prefix matching through the model's compiled character map (a
double-array trie; empty in identity models), each normalised byte remembering the source byte
that it came from. The normalised text falls into segments that no piece crosses (pieces hold the
space mark only at their beginning, and line breaks stand alone), whose ids the library gives and a
worker remembers; each piece is projected back to the span of original bytes that it stands for. Models
whose pieces may cross such segments are given whole texts. Digests are taken of what this yields.

Defined cases: a null or empty text has no tokens and decodes to the empty text; spans are byte
offsets into the UTF-8 of the original text, end exclusive (the dummy space at the beginning is the
empty span 0:0); repeated rows are returned as often as they occur; columns other than doc_id and
text are ignored. Of a character that becomes several byte pieces, the last has the span, the others are empty before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.common import slices

MARK = "▁".encode()
#: Segments that a worker remembers, and the bytes that such a one has at most.
MEMO_SEGMENTS, MEMO_SEGMENT_BYTES = 150_000, 64
#: Type numbers of the model file.
BYTE = 6


class CharMap:
    """A compiled character map: a double array of units, then replacement strings ended by a zero byte."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, dtype=np.uint32)
        self.strings = b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4")
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that begins at ``at``, and what it becomes."""
        units, found = self.units, None
        unit = int(units[0])
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            unit = int(units[node])
            if (unit & 0x800000FF) != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                value = int(units[node]) & 0x7FFFFFFF
                found = (k + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return found


class Normalizer:
    """Text bytes to normalised bytes and, for each of them and the end, the source byte."""

    def __init__(self, charmap: bytes, dummy_prefix: bool, remove_extra: bool, escape: bool):
        self.map = CharMap(charmap)
        self.dummy, self.remove, self.space = dummy_prefix, remove_extra, MARK if escape else b" "

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not len(self.map.units) and not self.remove:
            return self._unmapped(data)
        return self._mapped(data)

    def _unmapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """With an empty map every character becomes itself, and a space the space mark."""
        raw = np.frombuffer(data, np.uint8)
        place = np.arange(len(raw))
        begins = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, place, 0)) if len(raw) else place
        source = np.repeat(begins, np.where(raw == 32, len(self.space), 1)) if b" " in data and len(self.space) > 1 else begins
        prefix = self.space if data and self.dummy else b""
        return prefix + data.replace(b" ", self.space), np.concatenate([np.zeros(len(prefix), np.int64), source, [len(data)]])

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        chunks: list[tuple[bytes, int]] = []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if len(self.map.units) else None
            if hit is None:
                lead = data[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = (size, data[at : at + size])
            chunks.append((hit[1], at))
            at += hit[0]
        out, source = [], []
        if self.remove:
            start = 0
            while start < len(chunks) and chunks[start][0].strip(b" ") == b"":
                start += 1
            chunks = chunks[start:]
        begin = chunks[0][1] if chunks else len(data)
        if chunks and self.dummy:
            out.append(self.space)
            source += [begin] * len(self.space)
        spaced = self.remove
        for text, place in chunks:
            if spaced:
                text = text.lstrip(b" ")
            for byte in text:
                piece = self.space if byte == 32 else bytes([byte])
                out.append(piece)
                source += [place] * len(piece)
            if text:
                spaced = self.remove and text.endswith(b" ")
        joined = b"".join(out)
        end = len(data)
        while self.remove and joined.endswith(self.space):
            joined = joined[: -len(self.space)]
            end = source[len(joined)]
            source = source[: len(joined)]
        return joined, np.array([*source, end if joined else 0], dtype=np.int64)


class Encoded(NamedTuple):
    """A text's ids, as numbers and in decimal, the original bytes of each piece, and what the ids decode to."""

    ids: list[int]
    joined: bytes
    starts: np.ndarray
    ends: np.ndarray
    decoded: str


class PieceModel:
    """One model: normalising, encoding by remembered segments, spans, decoding."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            blob = file.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec = proto.normalizer_spec
        identity = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.encode() for p in proto.pieces]
        self.is_byte = [p.type == BYTE for p in proto.pieces]
        texts = [p.piece for p in proto.pieces if p.type != BYTE]
        crossing = any("▁" in t.lstrip("▁") for t in texts) or any(p.type == 4 for p in proto.pieces) or any("\n" in t for t in texts)
        self.mark = self.processor.piece_to_id("▁")
        # ids of a segment must not depend on what stands around it, nor on a second normalisation
        self.segmented = identity and not crossing and proto.trainer_spec.byte_fallback and self.processor.id_to_piece(self.mark) == "▁"
        self.memo: dict[bytes, tuple[bytes, bytes, bytes]] = {}
        self.newline = len(self.processor.encode("\n"))

    #: A segment is a run of space marks with the word after it; a line break stands alone.
    SEGMENT = re.compile(rb"\n|(?:\xe2\x96\x81)*(?:(?!\xe2\x96\x81)[^\n])+|(?:\xe2\x96\x81)+", re.S)
    #: The same where all marks are spaces.
    PLAIN = re.compile(rb"\n| *[^ \n]+| +")

    def ids_of(self, segment: bytes) -> list[int]:
        """Ids of a segment of normalised text."""
        text = segment.decode("utf-8", "replace")
        if text.startswith("▁"):
            text = text[1:].replace("▁", " ")
            return self.processor.encode(text) if text else [self.mark]
        # without a space mark: behind a line break, whose ids and mark are taken off again
        return self.processor.encode("\n" + text.replace("▁", " "))[self.newline :]

    def _segment(self, key: bytes) -> tuple[bytes, bytes, bytes]:
        """A segment's ids, the length of each piece in normalised bytes (both as 32-bit numbers), the ids in decimal."""
        ids = self.ids_of(key.replace(b" ", MARK))
        found = np.array(ids, "<u4").tobytes(), np.array([len(self.surface[i]) for i in ids], "<u4").tobytes(), ",".join(map(str, ids)).encode()
        if len(key) <= MEMO_SEGMENT_BYTES:
            if len(self.memo) >= MEMO_SEGMENTS:
                self.memo = {}
            self.memo[key] = found
        return found

    def _pieces(self, data: bytes, normal: bytes) -> tuple[list[int], bytes, np.ndarray]:
        """Ids, in decimal too, and the normalised bytes of each piece."""
        if self.segmented:
            keys = self.SEGMENT.findall(normal) if MARK in data else self.PLAIN.findall(normal.replace(MARK, b" "))
            get, make = self.memo.get, self._segment
            found = [get(k) or make(k) for k in keys]
            ids = np.frombuffer(b"".join([f[0] for f in found]), "<u4").tolist()
            return ids, b",".join([f[2] for f in found]), np.frombuffer(b"".join([f[1] for f in found]), "<u4")
        pieces = self.processor.encode(data.decode("utf-8", "replace"), return_type="proto").pieces
        ids = [p.id for p in pieces]
        sizes = [1 if self.is_byte[p.id] else len(p.piece.encode()) for p in pieces]
        return ids, ",".join(map(str, ids)).encode(), np.array(sizes, dtype=np.int64)

    def encoded(self, data: bytes) -> Encoded:
        """A whole text."""
        normal, source = self.normalizer(data)
        ids, joined, sizes = self._pieces(data, normal)
        cuts = np.minimum(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), len(source) - 1)
        places = source[cuts]
        return Encoded(ids, joined, places[:-1], places[1:], self.processor.decode(ids))

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


@cache
def piece_model(path: str) -> PieceModel:
    """One for each worker and model file."""
    return PieceModel(path)


def digests(one: Encoded) -> tuple[int, str, str, str]:
    """Number of ids; sha256 of the ids joined by commas, of the decoded text, of the spans (start, end of each in turn, little-endian 32-bit)."""
    spans = np.stack([one.starts, one.ends], axis=1).astype("<u4").tobytes()
    return len(one.ids), *(hashlib.sha256(x).hexdigest() for x in (one.joined, one.decoded.encode(), spans))


_FULL = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def _each(docs: DataFrame, model_path: str, schema: str, columns) -> DataFrame:
    """doc_id and what ``columns`` makes of every list of encoded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [model.encoded(t or b"") for t in batch["text"].cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *columns(texts)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, ids, starts and ends (original bytes of each piece), decoded."""
    numbers = lambda rows: pa.array(rows, pa.list_(pa.int32()))
    return _each(docs, model_path, _FULL, lambda t: [numbers([e.ids for e in t]), numbers([e.starts for e in t]), numbers([e.ends for e in t]), pa.array([e.decoded for e in t], pa.string())])


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """The same as digests: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256, spans_sha256."""

    def columns(texts: list[Encoded]) -> list[pa.Array]:
        rows = [digests(e) for e in texts]
        return [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3))]

    return _each(docs, model_path, _DIGESTS, columns)
