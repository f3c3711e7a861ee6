"""Web archives: WARC records in ZIP packages, written by tasks and read back by byte ranges.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``,
one gzip member per record, and ``indexes/index.cdxj``, a line per record with
its place. The reader parses the end record, the ZIP64 records and the central
directory itself, finds where a stored member's bytes lie, and reads records by
range, without unpacking the package.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosefold.llm.common import file_system, stored
from dosefold.session import scratch_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # pages carry no time of capture

# --- ZIP directories -------------------------------------------------------


def _zip64(extra: bytes, wanted: list[int]) -> list[int]:
    """`wanted` (size, packed size, header offset) with 0xFFFFFFFF taken from the ZIP64 field of `extra`."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return [next(values) if v == 0xFFFFFFFF else v for v in wanted]
        at += 4 + length
    return wanted


def directory(read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, header offset, packed size, size) of a ZIP package; `read(offset, length)` gives bytes."""
    tail_at = max(0, size - 65535 - 22 - 20)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        record = read(at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    central, out, at = read(offset, length), {}, 0
    for _ in range(count):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, whole, names, extras, notes = struct.unpack_from("<H8xIIHHH", central, at + 10)
        header = struct.unpack_from("<I", central, at + 42)[0]
        name = central[at + 46 : at + 46 + names].decode()
        whole, packed, header = _zip64(central[at + 46 + names : at + 46 + names + extras], [whole, packed, header])
        out[name] = (method, header, packed, whole)
        at += 46 + names + extras + notes
    return out


def stored_range(read, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """(offset, length) of the bytes of a stored member."""
    method, header, packed, _ = entry
    if method != 0:
        raise ValueError("the member is compressed: it can't be read by ranges")
    local = read(header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    names, extras = struct.unpack_from("<HH", local, 26)
    return header + 30 + names + extras, packed


# --- WARC records ----------------------------------------------------------


def _clean(value: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def record(page_id, url, payload: bytes, sha1_hex: str, refers_to) -> bytes:
    """A response record, or a revisit of `refers_to` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_clean(url)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1_hex)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode().partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one record; a stored payload is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = _fields(lines)
    length = int(warc["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http_head, _, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(_fields(http_head.split(b"\r\n")[1:])["content-length"])
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = warc["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload doesn't match its digest")
    return _page(warc["warc-record-id"]), size, digest, kind, _page(warc.get("warc-refers-to"))


# --- packages --------------------------------------------------------------


class Package:
    """Writes one package; renamed into place when whole, so a lost task leaves no half file under the final name."""

    def __init__(self, folder: str):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.wacz"
        self.path, self.part = f"{base}/{self.name}", f"{base}/.{self.name}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.size = [], 0

    def add(self, page_id, url, payload, digest, refers_to) -> None:
        packed = gzip.compress(record(page_id, url, payload, digest, refers_to), 4, mtime=0)
        self.data.write(packed)
        place = {"offset": self.size, "length": len(packed), "filename": DATA}
        self.index.append(f"{_clean(url)} {DATE} {json.dumps(place)}\n")
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as out:
            for line in sorted(self.index):
                out.write(line.encode())
        self.zip.close()
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.name, len(self.index), self.size


def _writer(folder: str, limit: int):
    schema = pa.schema([("name", pa.string()), ("records", pa.int64()), ("size", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for row in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[row].as_py() for c in columns)
                package = package or Package(folder)
                package.add(page_id, url, (html or "").encode(), digest, refers_to)
                if package.size >= limit:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, package.close()))], schema)
                    package = None
        if package:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, package.close()))], schema)

    return write


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_package(fs, path: str, window: int = 8 << 20) -> Iterator[list[tuple]]:
    """Records of one package, a list per range of about `window` bytes."""
    with fs.open_input_file(path) as source:

        def read(offset: int, length: int) -> bytes:
            return source.read_at(length, offset)

        entries = directory(read, source.size())
        base, _ = stored_range(read, entries[DATA])
        lines = read(*stored_range(read, entries[INDEX])).decode().splitlines()
        places = sorted((p["offset"], p["length"]) for p in (json.loads(x.split(" ", 2)[2]) for x in lines))
        at = 0
        while at < len(places):
            start, end = places[at][0], at
            while end < len(places) and (end == at or places[end][0] + places[end][1] - start <= window):
                end += 1
            data = read(base + start, places[end - 1][0] + places[end - 1][1] - start)
            yield [parse_record(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in places[at:end]]
            at = end


def _reader(folder: str):
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                for rows in read_package(fs, f"{base}/{name}"):
                    columns = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RECORDS)], schema=RECORDS)

    return load


def mark_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, digest, refers_to: of equal payloads the largest page_id is the response, others refer to it.

    Payloads under `least_bytes` are never revisits. A null page_id ranks lowest.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    # only digests that occur twice are joined back, so copies never meet in one group
    copies = (
        rows.where(F.octet_length("html") >= least_bytes)
        .groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "first")
    )
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(copies, "digest", "left").select("page_id", "url", "html", "digest", F.when(later, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, limit: int = 256 << 20) -> DataFrame:
    """Write one record per page to packages of about `limit` bytes in `folder`; returns the list of packages.

    A null html is an empty payload, a null url an empty target. Only packages
    of tasks that ended are in the list; what a lost task wrote is never read.
    """
    rows = mark_revisits(pages, least_bytes)
    return stored(rows.mapInArrow(_writer(folder, limit), "name string, records long, size long"), "packages")


def read_archives(packages: DataFrame, folder: str) -> DataFrame:
    """A row per record of the listed packages, parsed from the record's own bytes."""
    n = packages.sparkSession.sparkContext.defaultParallelism
    return packages.repartition(4 * n).mapInArrow(
        _reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read the records back.

    Empty tables give no packages and no rows; rows that repeat a page_id are
    each recorded; other columns are ignored.
    """
    folder = scratch_folder(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder), folder)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT page_id, html, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""
