"""WARC archives: writing, and reading by boundary-chain verification.

Writing is a DataFrame job: every row becomes one record, compressed on its own (one gzip member a
record, as is usual), and Spark's text writer lays the members down back to back: its line separator is
the member's last byte. Of rows with equal payloads the last is a response and the others are revisits
of it that leave the payload out.

Reading: a file is cut into byte ranges, tasks of their own, whatever its size. A task looks for
everything in its range that could begin a record (a gzip member with a record inside, or the magic in
an uncompressed file), follows it as far as it goes and emits the offset of the candidate and of its successor,
and where the chain from it leaves the range. Pointer jumping over these exits, from the file's
first byte, finds where the true chain enters each range; only candidates on that chain are records.
Magic inside of a payload is a candidate that no record leads to, and is rejected. Payloads are hashed as
they are read, a few KB at a time.

Defined cases: a null html is an empty payload; a null url is an empty target; line breaks in a url
become spaces; payloads below ``min_revisit`` bytes are never revisits; rows that repeat a page_id
and its payload are responses all, if the page_id is the largest of its payload; a null page_id
sorts before all others; headers and payloads are of any length; a chain that a damaged or cut record breaks ends
before it, and a round trip that loses a record so fails;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, fresh_path, slices

#: Bytes of a range: what one task scans, and the unit between whose borders pointers jump.
RANGE_BYTES = 8 << 20
#: Bytes that are read of a file at once.
READ_BYTES = 1 << 14
#: A payload's rows are dealt into so many parts, so that one that a third of all pages share is not one task's.
SALTS = 32

_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = re.compile(rb"\x1f\x8b\x08(?=[\x00-\x1f])")
_FOUND = "file string, block long, start long, next long, leaves long, size long, page_id long, kind string, refers_to long, payload_bytes long, payload_digest string"
_NAMES = [field.split()[0] for field in _FOUND.split(", ")]


def archive_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", min_revisit: int = 1000) -> DataFrame:
    """One column ``value``: the record of every row of ``pages`` (page_id, url, html)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"))
    rows = rows.withColumn("n", F.octet_length("html"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    keyed = rows.withColumn("key", F.sha2("html", 256)).withColumn("salt", salt)
    large = keyed.filter(F.col("n") >= min_revisit)
    last = large.groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("times")).filter("times > 1")
    last = last.select("key", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = large.join(last, ["key", "salt"], "left").drop("key", "salt").unionByName(rows.filter(F.col("n") < min_revisit).withColumn("last", F.lit(None).cast("long")))
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.sha1("html"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("last"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, block, F.lit("\r\n\r\n")).alias("value"))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", **options) -> None:
    """Write one record a row of ``pages`` to archives under ``path``, one a task; compression is gzip (a member a record) or none."""
    records = archive_records(pages, **options)
    if compression == "none":
        records.select(F.expr("left(value, length(value) - 1)").alias("value")).write.option("lineSep", "\n").text(path)
        return

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "value"):
                yield pa.RecordBatch.from_arrays([pa.array([_member(v.as_buffer().to_pybytes()) for v in batch["value"]], pa.binary())], names=["value"])

    packed = records.mapInArrow(members, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(f"{path}/gz")


def _member(record: bytes) -> bytes:
    """A gzip member without its last byte, which is 0: the size's highest, else that of an empty member that follows."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = pack.compress(record) + pack.flush()
    if data[-1]:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        data += pack.compress(b"") + pack.flush()
    return data[:-1]


def _header(head: bytes, name: bytes) -> bytes:
    found = re.search(rb"(?i)\r\n" + name + rb":[ \t]*([^\r\n]*)", head)
    return found[1].strip() if found else b""


def _number(urn: bytes) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?[0-9]+)>", urn)
    return int(found[1]) if found else None


class _Source:
    """Bytes of one record as they come: a buffer that is filled on demand and never holds a payload."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.buffer, self.passed = chunks, b"", 0

    def more(self) -> bool:
        chunk = next(self.chunks, b"")
        self.buffer += chunk
        return bool(chunk)

    def take(self, n: int) -> bytes:
        """The next bytes, at most ``n`` and at least one if there are any."""
        if not self.buffer:
            self.more()
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.passed += len(out)
        return out

    def line(self, most: int | None = None) -> bytes | None:
        """The bytes up to and with the next line break, of at most ``most``; None without one."""
        looked = 0
        while (at := self.buffer.find(b"\r\n", looked)) < 0:
            looked = max(len(self.buffer) - 1, 0)
            if (most is not None and len(self.buffer) > most) or not self.more():
                return None
        if most is not None and at + 2 > most:
            return None
        return self.take(at + 2)


def parse_record(source: _Source) -> tuple | None:
    """(page_id, kind, refers_to, payload_bytes, payload_digest) of the record that the bytes begin with, or None; read to its end."""
    head = source.line(16)
    if head is None or not _MAGIC.fullmatch(head):
        return None
    while (line := source.line()) != b"\r\n":
        if line is None or b":" not in line:
            return None
        head += line
    length = _header(head, b"Content-Length")
    if not length.isdigit():
        return None
    left, web, digest, size = int(length), b"", hashlib.sha1(), 0
    kind = _header(head, b"WARC-Type").decode("ascii", "replace").lower()
    if b"application/http" in _header(head, b"Content-Type").lower():
        while left and (line := source.line(left)) is not None:  # headers of the answer, up to its blank line
            left, web = left - len(line), web + line
            if line == b"\r\n":
                break
        if not web.endswith(b"\r\n\r\n") and web != b"\r\n":  # no blank line: all is payload
            digest.update(web)
            size, web = len(web), b""
    size += left
    while left:
        part = source.take(min(left, READ_BYTES))
        if not part:
            return None
        digest.update(part)
        left -= len(part)
    while len(source.buffer) < 4 and source.more():
        pass
    if source.take(4) != b"\r\n\r\n":
        return None
    stated = _header(b"\r\n" + web, b"Content-Length")
    found = size, digest.hexdigest()
    if kind == "revisit":  # says how long the payload is that it leaves out, and its digest
        found = int(stated) if stated.isdigit() else size, _header(head, b"WARC-Payload-Digest").decode("ascii", "replace").removeprefix("sha1:")
    return _number(_header(head, b"WARC-Record-ID")), kind, _number(_header(head, b"WARC-Refers-To")), *found


class Window:
    """A range of a file that is in memory; what lies behind it is read when it is asked for."""

    def __init__(self, file, size: int, begin: int, end: int):
        self.file, self.size, self.begin = file, size, begin
        self.data = file.read_at(end - begin, begin)

    def chunks(self, at: int) -> Iterator[bytes]:
        while at < self.size:
            near = at - self.begin
            data = self.data[near : near + READ_BYTES] if near < len(self.data) else self.file.read_at(min(READ_BYTES, self.size - at), at)
            if not data:
                return
            yield data
            at += len(data)


def _plain(window: Window, start: int) -> tuple[int, tuple] | None:
    """Successor and content of the uncompressed record that begins at ``start``."""
    source = _Source(window.chunks(start))
    found = parse_record(source)
    return found and (start + source.passed, found)


def _packed(window: Window, start: int) -> tuple[int, tuple] | None:
    """The same of a gzip member, which holds one record or nothing."""
    unpack, taken = zlib.decompressobj(31), 0

    def unpacked() -> Iterator[bytes]:
        nonlocal taken
        for data in window.chunks(start):
            pending = data
            while pending and not unpack.eof:
                out = unpack.decompress(pending, READ_BYTES)
                pending = unpack.unconsumed_tail
                if out:
                    yield out
            taken += len(data) - len(unpack.unused_data)
            if unpack.eof:
                return

    source = _Source(unpacked())
    try:
        if not source.more():
            return (start + taken, (None, "", None, 0, "")) if unpack.eof else None
        found = parse_record(source)
        if found is None or source.buffer or source.more():
            return None
    except zlib.error:
        return None
    return (start + taken, found) if unpack.eof else None


def candidates(file, size: int, begin: int, end: int, packed: bool) -> list[tuple]:
    """(start, next, leaves, page_id, kind, refers_to, payload_bytes, payload_digest) of whatever in a range could be a record.

    leaves is where the chain from the candidate arrives outside of the range, -1 if it breaks before.
    """
    magic, read, tail = (_MEMBER, _packed, 3) if packed else (_MAGIC, _plain, 9)
    window = Window(file, size, begin, min(end + tail, size))
    out, leaves = [], {}
    for start in [begin + m.start() for m in magic.finditer(window.data) if begin + m.start() < end][::-1]:
        found = read(window, start)
        if found:
            after, content = found
            leaves[start] = after if after >= end or after == size else leaves.get(after, -1)
            out.append((start, after, leaves[start], *content))
    return out[::-1]


def _open(path: str):
    """A file of the shared store, for reading at places; Hadoop's names of stores as those of Arrow."""
    from pyarrow.fs import FileSystem

    store, name = FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return store.open_input_file(name)


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record on the chain of its archive: file, start, page_id, kind, refers_to, payload_bytes, payload_digest.

    Files below ``path``/gz, or whose name ends in .gz, hold a gzip member for every record; others are not
    compressed. Ranges are read where they are scanned, from a store that Arrow can open.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, begin in zip(*(batch[c].to_pylist() for c in ("path", "length", "begin"))):
                with _open(name) as file:
                    packed = name.endswith(".gz") or "/gz/" in name
                    rows = [(name, begin // range_bytes, start, after, leaves, size, *rest) for start, after, leaves, *rest in candidates(file, size, begin, min(begin + range_bytes, size), packed)]
                columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
                types = [pa.string() if " string" in field else pa.int64() for field in _FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    ranges = cut(files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("begin")), "ranges")
    n = max(1, ranges.count())
    found = cut(ranges.repartition(n, "path", "begin").mapInArrow(scan, _FOUND), "candidates")

    # Pointer jumping: each round doubles the steps of ``jump`` and the ranges known to be entered.
    entered = cut(found.filter("start = 0").select("file", F.col("start").alias("at")), "entered")
    jump = found.filter("leaves >= 0 and leaves < size").select("file", "start", F.col("leaves").alias("to"))
    count = entered.count()
    while count:
        more = entered.join(jump.select("file", F.col("start").alias("at"), "to"), ["file", "at"]).select("file", F.col("to").alias("at"))
        entered = cut(entered.unionByName(more).distinct(), "entered")
        after = entered.count()
        if after == count:
            break
        count = after
        onward = jump.select("file", F.col("start").alias("to"), F.col("to").alias("then"))
        jump = cut(jump.join(onward, ["file", "to"], "left").select("file", "start", F.coalesce("then", "to").alias("to")).filter(F.col("start") != F.col("to")), "jump")

    def walk(table: pa.Table) -> pa.Table:
        at = table["at"][0].as_py()
        start, after = table["start"].to_pylist(), dict(zip(table["start"].to_pylist(), table["next"].to_pylist()))
        on = set()
        while at in after and at not in on:
            on.add(at)
            at = after[at]
        return table.filter(pa.array([s in on for s in start])).select(["file", "start"])

    entries = entered.select("file", F.floor(F.col("at") / range_bytes).alias("block"), "at")
    on_chain = found.select("file", "block", "start", "next").join(entries, ["file", "block"]).groupBy("file", "block").applyInArrow(walk, "file string, start long")
    kept = found.join(on_chain, ["file", "start"], "left_semi").filter("kind <> ''")
    return kept.select("file", "start", "page_id", "kind", "refers_to", "payload_bytes", "payload_digest")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to fresh archives in the shared folder and read them: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Fails unless as many records are read as rows were given.
    """
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    records = cut(read_archives(pages.sparkSession, path), "records")
    given, read = pages.count(), records.count()
    if given != read:
        raise ValueError(f"{given} pages were written, {read} records can be read: a chain ends before its archive does")
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
