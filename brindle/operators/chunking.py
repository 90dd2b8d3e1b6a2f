"""Chunkers: a document becomes numbered pieces. Tokens are counted by a function; the default is ceil(length / 4).

Splitting a text is sequential work on one row, so the recursive, classic and semantic chunkers are small
Python helpers behind an Arrow-batched map; the others are column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import approx_token_split, approx_tokens, markdown_plain, rst_clean

_OUT = "doc_id long, part int, chunk string, tokens int"
#: Characters that a task gathers before it hands chunks on.
_OUT_BYTES = 1 << 20


def count_tokens(text: str) -> int:
    return -(-len(text) // 4)


def split_tokens(text: str, size: int) -> list[str]:
    step = 4 * max(1, size)
    return [text[i : i + step] for i in range(0, len(text), step)]


def merge_small(pieces: list[str], low: int, high: int, joiner: str = "") -> list[str]:
    """Neighbours join until a chunk has ``low`` tokens, as long as it stays within ``high``; a piece that is longer stays alone.

    Only lengths matter: on the running length of all pieces, the end of each chunk is found by bisection.
    """
    gap = len(joiner)
    reach = list(accumulate((len(p) + gap for p in pieces), initial=0))
    chunks, begin = [], 0
    while begin < len(pieces):
        zero = reach[begin] + gap
        enough = bisect_right(reach, zero + 4 * (low - 1))
        fitting = bisect_right(reach, zero + 4 * high) - 1
        end = min(max(begin + 1, min(enough, fitting)), len(pieces))
        chunks.append(joiner.join(pieces[begin:end]))
        begin = end
    return chunks


def recursive(text: str, low: int, high: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ")) -> list[str]:
    """By paragraph, then line, then sentence, then token windows, as far as pieces are too long."""

    def parts(whole: str, level: int) -> Iterator[str]:
        if count_tokens(whole) <= high:
            yield whole
        elif level == len(separators):
            yield from split_tokens(whole, high)
        else:
            for part in re.findall(rf"(?s).*?{re.escape(separators[level])}|.+$", whole):
                yield from parts(part, level + 1)

    return merge_small([p for p in parts(text, 0) if p.strip()], low, high)


def classic(text: str, low: int, high: int, header_lines: int = 3, repeat_header: bool = False) -> list[str]:
    """A text within the budget stays whole; a longer one becomes windows, of which the first, or each, begins with the text's first lines.

    These lines take from the budget of the windows that they stand on. They are body if they fill the budget alone, and stand on the
    first window only if they would leave less than a quarter of it for the body.
    """
    if count_tokens(text) <= high:
        return [text] if text.strip() else []
    lines = text.split("\n", header_lines)
    header, body = ("\n".join(lines[:-1]) + "\n", lines[-1]) if len(lines) > header_lines else ("", text)
    used = count_tokens(header)
    if used >= high:
        header, body, used = "", text, 0
    room = high - used
    begin = 4 * room
    step = begin if repeat_header and 4 * room >= high else 4 * high
    pieces = [body[:begin], *(body[i : i + step] for i in range(begin, len(body), step))]
    each = header if step == begin else ""
    return [(each if i else header) + p for i, p in enumerate(pieces) if p or header and not i]


def hashed_vector(sentence: str, size: int = 64) -> list[float]:
    """Offline stand-in for a sentence embedding: counts of hashed words."""
    import zlib

    out = [0.0] * size
    for word in re.findall(r"\w+", sentence.lower()):
        out[zlib.crc32(word.encode()) % size] += 1.0
    return out


def turns(vectors: np.ndarray, percentile: float) -> np.ndarray:
    """For each row the number of its passage: a new one begins where the step from the row before is among the largest."""
    length = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(length > 0, length, 1.0)[:, None]
    step = 1.0 - np.einsum("ij,ij->i", unit[1:], unit[:-1])
    large = (step >= np.percentile(step, percentile)) & (np.ptp(step) > 0)
    return np.append(0, np.cumsum(large))


def semantic(text: str, low: int, high: int, embed: Callable[[str], list[float]] = hashed_vector, percentile: float = 95.0) -> list[str]:
    """Passages of sentences that belong together, in windows of at most ``high`` tokens; a text of one sentence goes by ``recursive``."""
    sentences = [s for s in map(str.strip, re.split(r"(?<=[.!?])\s+", text)) if s]
    if len(sentences) < 2:
        return recursive(text, low, high)
    passage = turns(np.array([embed(s) for s in sentences], dtype=float), percentile)
    joined = (" ".join(s for _, s in members) for _, members in groupby(zip(passage, sentences), key=lambda x: x[0]))
    windows = [w for p in joined for w in split_tokens(p, high) if w.strip()]
    return merge_small(windows, low, high, " ")


CHUNKERS: dict[str, Callable[..., list[str]]] = {"recursive": recursive, "classic": classic, "semantic": semantic}


def register(name: str, chunker: Callable[..., list[str]]) -> None:
    """Add a chunker: a function of (text, low, high) to pieces."""
    CHUNKERS[name] = chunker


def chunk(docs: DataFrame, strategy: str, low: int = 50, high: int = 200) -> DataFrame:
    """doc_id, part (from 0), chunk, tokens. Chunks leave a task every ``_OUT_BYTES`` or so, however long its texts are."""
    split = CHUNKERS[strategy]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 4
        types = (pa.int64(), pa.int32(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "part", "chunk", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for part, piece in enumerate(split(text.as_py() or "", low, high)):
                    rows.append((doc_id.as_py(), part, piece, count_tokens(piece)))
                    size += len(piece)
                    if size > _OUT_BYTES:
                        yield frame(rows)
                        rows, size = [], 0
        yield frame(rows)

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)


def markdown(docs: DataFrame, high: int = 200) -> DataFrame:
    """Sections at headings, longer ones in token windows: doc_id, part, chunk."""
    sections = F.filter(F.split("text", r"(?m)^(?=#{1,6}\s)"), lambda s: F.trim(s) != "")
    pieces = F.flatten(F.transform(sections, lambda s: approx_token_split(s, high)))
    kept = F.filter(pieces, lambda p: F.trim(p) != "")
    return docs.select("doc_id", F.posexplode(kept).alias("part", "chunk"))


def record_chunks(docs: DataFrame, low: int = 50, high: int = 200) -> DataFrame:
    """doc_id, part, chunk: the sections of a Markdown record, each packed by paragraph, line and word, under its heading."""
    sections = markdown_sections(docs).select("doc_id", F.col("part").alias("section"), F.concat_ws("\n", F.nullif("header", F.lit("")), F.nullif("text", F.lit(""))).alias("text"))

    def packed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([recursive(t or "", low, high, ("\n\n", "\n", " ")) for t in batch.to_pylist()], pa.list_(pa.string()))

    pieces = sections.select("doc_id", "section", F.posexplode(F.arrow_udf(packed, "array<string>")("text")).alias("piece", "chunk"))
    part = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "piece")) - 1
    return pieces.select("doc_id", part.alias("part"), "chunk")


#: Characters that one token is charged for; a longer one stands for a run that the tokenizer could not part.
TOKEN_CHARS = 16


def windows_of(text: str, spans: list[tuple[int, int]], first: int, rest: int) -> list[tuple[str, int]]:
    """(piece, tokens) by token spans: pieces join to the text, and hold at most ``first`` tokens, later ones ``rest`` (both at least 1).

    A token of more than ``TOKEN_CHARS`` characters counts as many tokens as it has such runs, and is cut where it exceeds a budget alone.
    """
    ends = [b for _, b in spans[:-1]] + [len(text)] if spans else []
    out, begin, used, budget = [], 0, 0, max(1, first)
    at = 0
    for end in ends:
        while end > at:
            step = min(end - at, budget * TOKEN_CHARS)
            cost = max(1, -(-step // TOKEN_CHARS))
            if used and used + cost > budget:
                out.append((text[begin:at], used))
                begin, used, budget = at, 0, max(1, rest)
                continue
            at, used = at + step, used + cost
    return out + [(text[begin:], used)] * (begin < len(text))


#: Texts of a batch that are held as Python objects at a time.
TEXTS = 64


def tokenizer_windows(docs: DataFrame, tokenizer_path: str, first: int, rest: int) -> DataFrame:
    """doc_id, part, chunk, tokens: windows in units of a tokenizer whose file all executors have."""

    def cut_up(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        kind = pa.list_(pa.struct([("chunk", pa.string()), ("tokens", pa.int32())]))
        for batch in texts:
            done = [pa.array([], kind)]
            for begin in range(0, len(batch), TEXTS):
                rows = []
                for text in batch.slice(begin, TEXTS).to_pylist():
                    text = text or ""
                    pieces = windows_of(text, tokenizer.encode(text, add_special_tokens=False).offsets, first, rest)
                    rows.append([{"chunk": c, "tokens": n} for c, n in pieces])
                done.append(pa.array(rows, kind))
            yield pa.concat_arrays(done)

    pieces = docs.select("doc_id", F.posexplode(F.arrow_udf(cut_up, "array<struct<chunk:string,tokens:int>>")("text")).alias("part", "x"))
    return pieces.select("doc_id", "part", "x.chunk", "x.tokens")


def markdown_sections(docs: DataFrame) -> DataFrame:
    """doc_id, part, header, text: a section for every Markdown heading (outside of fenced code), and what stands before the first.

    The header is the heading without its marks (null before the first); images and link targets go, sections without
    header and text too.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return _sections(lines, F.regexp_extract("raw", r"^#+\s+(.*?)\s*$", 1), F.col("raw").rlike(r"^#+\s"), F.col("raw").rlike("^\\s*(```|~~~)"), markdown_plain)


def rst_sections(docs: DataFrame) -> DataFrame:
    """The same for reStructuredText: a line over a rule of one repeated mark, at least as long, is a heading."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    after = F.lead("raw").over(Window.partitionBy("doc_id").orderBy("line"))
    rule = r"^([!-/:-@\[-`{-~])\1+\s*$"
    marked = lines.withColumn("_next", after)
    heading = F.coalesce(F.col("_next").rlike(rule) & (F.length(F.trim("_next")) >= F.length(F.trim("raw"))) & (F.trim("raw") != "") & ~F.col("raw").rlike(rule), F.lit(False))
    before = F.lag(heading).over(Window.partitionBy("doc_id").orderBy("line"))
    kept = marked.withColumn("_head", heading).withColumn("_rule", F.coalesce(before, F.lit(False)) & F.col("raw").rlike(rule)).filter("not _rule")
    return _sections(kept, F.trim("raw"), F.col("_head"), F.lit(False), rst_clean)


def _sections(lines: DataFrame, title, heading, fence, clean) -> DataFrame:
    """Numbers the sections of each document by their headings, and joins the lines of each."""
    in_doc = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.sum(fence.cast("int")).over(in_doc) % 2 == 1
    marked = lines.withColumn("_is", heading & ~open_).withColumn("_title", F.when(F.col("_is"), title))
    marked = marked.withColumn("_n", F.sum(F.col("_is").cast("int")).over(in_doc))
    listed = F.array_sort(F.collect_list(F.when(~F.col("_is"), F.struct("line", "raw"))))
    body = F.trim(F.array_join(F.transform(listed, lambda x: x["raw"]), "\n"))
    grouped = marked.groupBy("doc_id", "_n").agg(F.max("_title").alias("header"), body.alias("text"))
    filled = grouped.filter((F.col("text") != "") | F.col("header").isNotNull()).withColumn("text", clean(F.col("text")))
    part = F.row_number().over(Window.partitionBy("doc_id").orderBy("_n")) - 1
    return filled.select("doc_id", part.alias("part"), "header", "text")


def parent_child(docs: DataFrame, parent: int = 200, child: int = 50) -> DataFrame:
    """Small pieces with the larger window that they lie in: doc_id, part, chunk, parent_text."""
    one = lambda p: F.transform(approx_token_split(p, min(child, parent)), lambda c: F.struct(c.alias("chunk"), p.alias("parent_text")))
    both = F.flatten(F.transform(approx_token_split(F.col("text"), parent), one))
    kept = F.filter(both, lambda x: F.trim(x["chunk"]) != "")
    return docs.select("doc_id", F.posexplode(kept).alias("part", "x")).select("doc_id", "part", "x.chunk", "x.parent_text")


def token_windows(docs: DataFrame, size: int) -> DataFrame:
    """Windows of a fixed number of approximate tokens: doc_id, part, chunk, tokens."""
    rows = docs.select("doc_id", F.posexplode(approx_token_split(F.col("text"), size)).alias("part", "chunk"))
    return rows.select("doc_id", "part", "chunk", approx_tokens(F.col("chunk")).alias("tokens"))
