from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from brindle.llm import warc

PAGES = "page_id long, url string, html string, size long, file string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "f") for i, u, h in rows], PAGES)


def expected(rows):
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = last.get(h)
        revisit = to is not None and to != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out)


def test_round_trip(spark):
    rng = random.Random(1)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    same = "é" * 600
    rows = [(i, f"http://e.org/{i}", "".join(rng.choice("abc <p>\r\n") for _ in range(rng.randrange(3000)))) for i in range(60)]
    rows += [(100, "u", fake * 3), (101, "u", "x" * 1500 + fake), (102, "a\r\nb", same), (103, None, same), (104, "u", same), (105, "u", "short"), (106, "u", "short"), (107, "u", None), (108, "u", ""), (109, "u", "WARC/1.1\r\n" * 400)]
    rows += [(110, "u", "y" * 999), (111, "u", "y" * 999), (112, "u", "y" * 1000), (113, "u", "y" * 1000)]
    got = warc.round_trip(pages(spark, rows))
    assert sorted(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected(rows)


def test_many_ranges(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "u", "".join(rng.choices("abcdefgh<>\r\n", k=37 * i % 900))) for i in range(300)]
    want = sorted(x[:3] for x in expected(rows))
    for compression, size in (("none", 64), ("none", 5000), ("gzip", 300), ("gzip", 8 << 20)):
        path = f"file://{tmp_path}/{compression}{size}"
        warc.write_archives(pages(spark, rows).coalesce(1), path, compression=compression)
        got = warc.read_archives(spark, path, size).select("page_id", "payload_bytes", "payload_digest").collect()
        assert sorted(map(tuple, got)) == want


def test_members_are_plain_gzip_with_a_record_each(spark, tmp_path):
    rows = [(i, "u", f"body {i} " * 50) for i in range(4)]
    warc.write_archives(pages(spark, rows).coalesce(1), f"file://{tmp_path}/a")
    (name,) = (tmp_path / "a" / "gz").glob("part-*")
    data, heads = name.read_bytes(), []
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 4
    while data:
        one = zlib.decompressobj(31)
        heads.append(one.decompress(data)[:10])
        data = one.unused_data
    assert heads == [b"WARC/1.1\r\n"] * 4


def test_broken_chain_ends_before_the_damage(spark, tmp_path):
    values = [r["value"] for r in warc.archive_records(pages(spark, [(i, "u", f"body {i}") for i in range(5)]).coalesce(1)).collect()]
    data = b"".join(v.encode() for v in values)
    third = data.index(b"body 3")
    (tmp_path / "a.warc").write_bytes(data[:third] + data[third + 1 :])
    (tmp_path / "b.warc").write_bytes(data[:-3])
    (tmp_path / "c.warc.gz").write_bytes(b"".join(gzip.compress(v.encode()) for v in values[:3]) + b"\x1f\x8b\x08\0rubbish")
    got = {r["file"].rsplit("/", 1)[1]: r["n"] for r in warc.read_archives(spark, f"file://{tmp_path}").groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert got == {"a.warc": 3, "b.warc": 4, "c.warc.gz": 3}


def test_very_large_payload(spark):
    rows = [(0, "u", "before"), (1, "u", "é0123456789" * 1_500_000), (2, "u", "after")]
    got = warc.round_trip(pages(spark, rows).coalesce(1)).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected(rows)


def test_repeated_and_null_ids_and_empty(spark):
    big = "q" * 1200
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.round_trip(pages(spark, [(1, "u", big), (2, "u", big), (2, "u", big), (None, "u", big)])).collect())
    assert got == [("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("None", "revisit", 2)]
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_long_url_keeps_later_records(spark):
    rows = [(i, "http://h/" + "u" * (200_000 if i == 2 else 5), f"page {i}") for i in range(6)]
    got = warc.round_trip(pages(spark, rows).coalesce(1)).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected(rows)


def test_lost_record_fails(spark, monkeypatch):
    whole = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a: whole(*a).filter("page_id <> 1"))
    with pytest.raises(ValueError, match="3 pages were written, 2 records"):
        warc.round_trip(pages(spark, [(i, "u", "x") for i in range(3)]))
