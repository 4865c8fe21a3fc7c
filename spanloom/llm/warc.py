"""Web archives in ZIP packages: writing, locating and range-reading records.

A package is a ZIP file with two *stored* (uncompressed) members: the records,
each a gzip member of its own, and an index with one line per record.  Because
the members are stored, a record's place in the package is the member's data
offset plus the offset in the index, so a record is read by one range read and
nothing is ever extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import kept, scratch

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"

# Fixed values of the ZIP format: signatures, sizes and the ZIP64 extra field.
END, END64, END64_AT, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, END64_AT_SIZE, ENTRY_SIZE, LOCAL_SIZE, EXTRA64 = 22, 20, 46, 30, 1
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

INDEX_SCHEMA = "path string, package_bytes long, at long, length long, record_id string"
RECORD_SCHEMA = (
    "path string, at long, record_id string, record_type string, target_uri string, refers_to string,"
    " payload_bytes long, payload_digest string, payload binary"
)


def open_file(uri: str):
    """A random-access file on any file system that Arrow can open."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def zip_entries(f) -> list[dict]:
    """Members of a package from its central directory, ZIP64 forms included.

    ``f`` needs ``size()`` and ``read_at(n, offset)``.  Raises ``ValueError`` for
    a file that has no end record or a damaged directory.
    """
    size = f.size()
    tail_at = max(0, size - END_SIZE - FULL16)
    tail = f.read_at(size - tail_at, tail_at)
    found = tail.rfind(END)
    while found >= 0:  # the comment may hold the signature: it must end the file
        if found + END_SIZE <= len(tail) and found + END_SIZE + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
            break
        found = tail.rfind(END, 0, found)
    if found < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, found + 10)
    if FULL16 == count or FULL32 in (length, at):
        locator = f.read_at(END64_AT_SIZE, max(0, tail_at + found - END64_AT_SIZE))
        if locator[:4] != END64_AT:
            raise ValueError("no ZIP64 locator")
        end64 = f.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end record")
        count, length, at = struct.unpack_from("<QQQ", end64, 32)
    directory, p, out = f.read_at(length, at), 0, []
    for _ in range(count):
        if directory[p : p + 4] != ENTRY:
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", directory, p + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
        local_at = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + ENTRY_SIZE : p + ENTRY_SIZE + n_name].decode("utf-8", "replace")
        extra = directory[p + ENTRY_SIZE + n_name : p + ENTRY_SIZE + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == EXTRA64:  # only the fields that overflow are present, in this order
                r = q + 4
                if plain == FULL32:
                    plain, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                if packed == FULL32:
                    packed, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                if local_at == FULL32:
                    local_at = struct.unpack_from("<Q", extra, r)[0]
            q += 4 + n
        out.append({"name": name, "method": method, "bytes": packed, "plain_bytes": plain, "local_at": local_at})
        p += ENTRY_SIZE + n_name + n_extra + n_comment
    return out


def member_data_at(f, entry: dict) -> int:
    """Offset of a member's first data byte (the local header may have its own extra field)."""
    head = f.read_at(LOCAL_SIZE, entry["local_at"])
    if head[:4] != LOCAL:
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return entry["local_at"] + LOCAL_SIZE + n_name + n_extra


def stored_member(f, entries: list[dict], name: str) -> tuple[int, int]:
    entry = next((e for e in entries if e["name"] == name), None)
    if entry is None or entry["method"] != 0:
        raise ValueError(f"no stored member {name}")
    return member_data_at(f, entry), entry["bytes"]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(record_id: str, uri: str | None, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{record_id}>"]
    lines += [f"WARC-Date: {date}"] + ([f"WARC-Target-URI: {_clean(uri)}"] if uri else [])
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; the digest of a response is checked."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    inner = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in http.decode("utf-8").split("\r\n")[1:])}
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    response = fields["warc-type"] == "response"
    if response and (payload_digest(payload) != digest or len(payload) != int(inner["content-length"])):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    ident = lambda x: None if x is None else x.removeprefix("<urn:page:").removesuffix(">")
    return {
        "record_id": ident(fields["warc-record-id"]), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"),
        "refers_to": ident(fields.get("warc-refers-to")), "payload_bytes": int(inner["content-length"]), "payload_digest": digest,
        "payload": payload if response else None,
    }


def _package_writer(folder: str, date: str, level: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.wacz"
        index, at, stack = [], 0, []
        for pdf in batches:
            for ident, uri, refers, html in zip(pdf["record_id"], pdf["uri"], pdf["refers_to"], pdf["payload"], strict=True):
                if not stack:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                    stack = [out, package, package.open(DATA_MEMBER, "w", force_zip64=True)]
                raw = record_bytes(ident, uri, refers, (html or "").encode("utf-8"), date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = packer.compress(raw) + packer.flush()
                stack[2].write(packed)
                index.append(json.dumps({"id": ident, "offset": at, "length": len(packed)}))
                at += len(packed)
        if stack:
            out, package, member = stack
            member.close()
            with package.open(INDEX_MEMBER, "w", force_zip64=True) as member:
                member.write("".join(x + "\n" for x in index).encode())
            package.close()
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(index)]})

    return write


def write_packages(
    pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 1,
) -> DataFrame:
    """Write one record per row into ZIP packages below ``folder``; returns the manifest ``(path, records)``.

    A null payload is an empty one, a null or empty address leaves the header
    out.  Of rows with equal payloads of at least ``min_bytes`` bytes the one
    with the largest id is a response and the others revisit it; repeated rows
    of that id are responses too.  A row with a null id is a response that is
    never referred to (its record id is empty).  Other columns are ignored.  An
    empty table writes no package and gives an empty manifest.

    Payloads are grouped by digest as narrow rows with a pre-aggregated maximum,
    so a payload with a third of all rows is no hot task; payloads themselves
    are only streamed from the scan into the package of their task.  A task
    that is run again writes a package under another name, and the manifest
    names only packages of tasks that ended well.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("payload", "UTF-8"))))
    narrow = rows.select("id", "digest", F.octet_length("payload").alias("bytes"))
    narrow = kept(narrow.filter(f"id is not null and bytes >= {int(min_bytes)}"), "warc-digests")
    groups = narrow.groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = narrow.join(groups, "digest").filter("id < last").select("id", "digest", F.col("last").cast("string").alias("refers_to")).distinct()
    revisits = kept(revisits, "warc-revisits")
    shaped = rows.join(revisits, ["id", "digest"], "left").select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("record_id"), "uri", "refers_to", "payload")
    return kept(shaped.mapInPandas(_package_writer(folder, date, level), "path string, records long"), "warc-manifest")


def _index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path in pdf["path"]:
            with open_file(path) as f:
                entries = zip_entries(f)
                data_at, data_bytes = stored_member(f, entries, DATA_MEMBER)
                index_at, index_bytes = stored_member(f, entries, INDEX_MEMBER)
                rest, p, size = b"", 0, f.size()
                while p < index_bytes:  # the index in pieces: memory doesn't grow with the package
                    piece = f.read_at(min(1 << 20, index_bytes - p), index_at + p)
                    p += len(piece)
                    *lines, rest = (rest + piece).split(b"\n")
                    parsed = [json.loads(x) for x in lines if x]
                    if any(x["offset"] + x["length"] > data_bytes for x in parsed):
                        raise ValueError(f"the index of {path} points outside its records")
                    yield pd.DataFrame(
                        {"path": path, "package_bytes": size, "at": [data_at + x["offset"] for x in parsed], "length": [x["length"] for x in parsed], "record_id": [x["id"] for x in parsed]}
                    )


def read_index(manifest: DataFrame) -> DataFrame:
    """Place of every record, from the central directories and index members of the packages in ``path``."""
    return manifest.select("path").repartition(F.col("path")).mapInPandas(_index_rows, INDEX_SCHEMA)


def _records(with_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, opened = None, None
        for pdf in batches:
            out, held = [], 0
            for path, at, length in zip(pdf["path"], pdf["at"], pdf["length"], strict=True):
                if path != opened:
                    if f is not None:
                        f.close()
                    f, opened = open_file(path), path
                raw = zlib.decompress(f.read_at(length, at), 31)
                row = parse_record(raw) | {"path": path, "at": at}
                if not with_payload:
                    row["payload"] = None
                held += len(row["payload"] or b"")
                out.append(row)
                if held > 32 << 20:
                    yield pd.DataFrame(out)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out)
        if f is not None:
            f.close()

    return read


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Range-read and parse the records that ``index`` places; every payload's digest is checked.

    Index rows are dealt by ranges of (path, at), so that a large package is read
    by many tasks and each reads forward.
    """
    placed = index.repartitionByRange("path", "at").sortWithinPartitions("path", "at")
    schema = RECORD_SCHEMA
    return placed.mapInPandas(_records(with_payload), schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to packages in the shared folder, read them back, one row per page."""
    folder = scratch(pages.sparkSession, "warc")
    records = read_records(read_index(write_packages(pages, folder, min_bytes=min_bytes)), with_payload=False)
    return records.select(
        F.when(F.col("record_id") != "", F.col("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"), F.col("target_uri"),
    )
