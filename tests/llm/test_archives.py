"""Packages of web archive records: formats, range reads and round trips."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.llm import warc


class Bytes:
    def __init__(self, raw: bytes):
        self.raw = raw

    def size(self) -> int:
        return len(self.raw)

    def read_at(self, n: int, at: int) -> bytes:
        return self.raw[at : at + n]


def test_directory_of_a_plain_package_with_a_comment():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"hello")
        z.writestr("dir/ö.bin", b"xyz", zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 is only a comment here, and long enough to look like an end"
    f = Bytes(out.getvalue())
    entries = warc.zip_entries(f)
    assert [e["name"] for e in entries] == ["a.txt", "dir/ö.bin"]
    at, n = warc.stored_member(f, entries, "a.txt")
    assert f.read_at(n, at) == b"hello"
    with pytest.raises(ValueError):
        warc.stored_member(f, entries, "dir/ö.bin")
    with pytest.raises(ValueError):
        warc.zip_entries(Bytes(b"not a package"))


def test_zip64_records_are_followed():
    name, data = b"m", b"payload"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, 7, 7)
    pad = b"\0" * 1000
    extra = struct.pack("<HHH", 9, 2, 5) + struct.pack("<HHQQQ", 1, 24, 7, 7, len(pad))
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(pad) + len(local) + len(data)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    where = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    f = Bytes(pad + local + data + entry + end64 + where + end)
    entries = warc.zip_entries(f)
    assert entries[0]["bytes"] == 7 and entries[0]["local_at"] == 1000
    start, n = warc.stored_member(f, entries, "m")
    assert f.read_at(n, start) == data


def test_round_trip_with_equal_null_and_empty_payloads(spark):
    rows = [(1, "http://a/x y\r\n", "same"), (2, None, "same"), (3, "", "same"), (4, "u", None), (5, "u", ""), (6, "u", "ü🙂" * 50_000), (None, "u", "same"), (7, "u", "other"), (3, "", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("x")).withColumn("payload", F.lit(1))
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df).collect()}
    assert got == {
        (1, "revisit", 3, 4), (2, "revisit", 3, 4), (3, "response", None, 4), (4, "revisit", 5, 0), (5, "response", None, 0), (6, "response", None, 300_000),
        (None, "response", None, 4), (7, "response", None, 5),
    }
    assert warc.round_trip(df).count() == len(rows)
    digest = {r.page_id: r.payload_digest for r in warc.round_trip(df).collect()}
    assert digest[1] == warc.payload_digest(b"same") and digest[4] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    few = warc.round_trip(df, min_bytes=5).filter("record_type = 'revisit'")
    assert few.count() == 0


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_damaged_payload_is_found():
    raw = warc.record_bytes("1", "u", None, b"abc", "2000-01-01T00:00:00Z")
    assert warc.parse_record(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
